import hashlib

from lockfleet.llm import warc

SCHEMA = "url string, page_id long, html string, digest string, n int"


def brute(rows):
    pages = [(i, (h or "").encode()) for _, i, h, *_ in rows]
    keeper = {}
    for i, b in pages:
        if len(b) >= 1000 and i is not None:
            keeper[b] = max(i, keeper.get(b, i))
    out = []
    for i, b in pages:
        k = keeper.get(b)
        revisit = k is not None and k != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", k if revisit else None))
    return sorted(out, key=str)


def check(spark, rows):
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_records_magic_and_copies(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "é" * 700
    rows = [("http://a/\r\nX: y", 1, "short", "x", 1), (None, 2, None, "x", 1), ("u", 3, "", "x", 1), ("u", 4, magic, "x", 1), ("u", 5, "a" + magic * 40 + "\r\n\r\n", "x", 1), ("u", 6, big, "x", 1), ("u", 7, big, "x", 1), ("u", 9, big, None, None), ("u", None, big, "x", 1), ("u", None, "WARC/1.1\r\n", "x", 1), ("u", 10, "x" * 999, "x", 1), ("u", 11, "x" * 999, "x", 1), ("u", 12, "WARC/1.1\r\n" * 5, "x", 1)]
    check(spark, rows)


def test_small_splits_of_large_files(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        magic = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
        check(spark, [(f"u{i}", i, f"<p>{i % 7}</p>" * (i * 13 % 170) + magic * (i % 4), "d", i) for i in range(60)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_empty(spark):
    check(spark, [])


def test_files_cut_short_or_foreign(spark, tmp_path):
    ok = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((ok + ok[:-12]).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + ok).encode())
    (tmp_path / "c.warc").write_bytes((ok + "junk" + ok).encode())
    got = warc.read(spark, str(tmp_path)).collect()
    assert [tuple(r)[:4] for r in got] == [(1, 2, hashlib.sha1(b"hi").hexdigest(), "response")] * 2


def test_older_version_and_compressed_records(spark, tmp_path):
    import gzip

    record = lambda k, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Length: {19 + len(body)}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{body}\r\n\r\n".encode()
    bodies = {1: "hi", 2: "WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", 3: "a WARC/1.", 4: ""}
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(b"".join(record(k, b) for k, b in bodies.items()))
    (tmp_path / "packed/a.warc.gz").write_bytes(b"".join(gzip.compress(record(k, b)) for k, b in bodies.items()))
    (tmp_path / "packed/b.warc.gz").write_bytes(gzip.compress(b"".join(record(k + 10, b) for k, b in bodies.items())))
    want = [(k, len(b), hashlib.sha1(b.encode()).hexdigest(), "response") for k, b in bodies.items()]
    assert sorted(tuple(r)[:4] for r in warc.read(spark, str(tmp_path / "plain")).collect()) == want
    assert sorted(tuple(r)[:4] for r in warc.read(spark, str(tmp_path / "packed")).collect()) == want + [(k + 10, *x) for k, *x in want]


def test_archives_of_other_writers(spark, tmp_path):
    """Records of all types, digests in base32, blocks that aren't HTTP or end within their HTTP header."""
    import base64

    def record(kind, block, *more):
        block = block.encode()
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0-1>", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    sha = hashlib.sha1(b"body")
    http, as_http = "HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n", "Content-Type: application/http; msgtype=response"
    base32 = "WARC-Payload-Digest: sha1:" + base64.b32encode(sha.digest()).decode()
    records = [
        record("warcinfo", "software: x", "Content-Type: application/warc-fields"),
        record("request", "GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", http + "body", as_http, base32),
        record("metadata", "a: b", "Content-Type: application/warc-fields"),
        record("revisit", http, as_http, base32),
        record("revisit", http, as_http, base32.lower().replace("warc-payload-digest", "WARC-Payload-Digest")),
        record("revisit", http, as_http, "WARC-Payload-Digest: SHA1:" + sha.hexdigest().upper()),
        record("revisit", http, as_http, "WARC-Payload-Digest: md5:" + "0" * 32),
        record("revisit", "HTTP/1.1 304 Not Modified\r\n", as_http),
        record("resource", "body\r\n\r\nbody WARC/1.0\r\n", "Content-Type: text/plain"),
        record("response", "60 dns x", "Content-Type: text/dns"),
        record("response", "HTTP/1.1 200 OK\r\nX: y", as_http),
        record("conversion", "WARC/1.0\r\nbody", "Content-Type: text/plain"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    got = warc.read(spark, str(tmp_path)).collect()
    whole = lambda x: (None, len(x), hashlib.sha1(x).hexdigest())
    revisits = [(None, 4, sha.hexdigest(), "revisit", None)] * 3 + [(None, 4, None, "revisit", None), (None, None, None, "revisit", None)]
    want = [(*whole(b"body"), "response", None), *revisits, (*whole(b"body\r\n\r\nbody WARC/1.0\r\n"), "resource", None), (*whole(b"60 dns x"), "response", None), (*whole(b""), "response", None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
