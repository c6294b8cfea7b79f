"""WARC archives written and read with Spark's text source, boundaries verified as chains.

Writing: one record for each page as one string; the text sink's line separator is the blank lines
that end a record, so its part files are plain WARC files.

Reading: the text source splits at the magic, in parallel and within large files too. A row is then a
*candidate*: a record, or a magic that a payload happens to hold. Running sums of row sizes give each
candidate its offset in its file, and its header (if it has one) its successor's offset. Only what a
chain from the file's start reaches is a record. Runs of candidates that follow one another
exactly are contracted first; pointer jumping, doubling each round, goes over the runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lockfleet.llm.graph import skew_join
from lockfleet.llm.scratch import new_path, written

MAGIC = "WARC/1.1\r\n"
#: What records of either version begin with; archives are read in parts between it.
SPLIT = "WARC/1."
END = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Records in a file before the writer begins another.
FILE_RECORDS = 20_000
#: Records that are pages; others (warcinfo, request, metadata, conversion, continuation) tell about them.
PAGES = ["response", "resource", "revisit"]
#: Fixed value: the digits of base32, in which other writers state digests.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """``(record)``: the WARC record of each row of ``pages(page_id, url, html)``, without its ending blank lines.

    Payload: the html in UTF-8 (null: empty). Of records with equal payloads of LEAST bytes or more,
    those with the largest page_id are responses and the others revisits of it; smaller ones are all
    responses. Rows that repeat the largest page_id are all responses. A null page_id is written as
    an empty one and is never referred to; a null url as the page's id. Line breaks are cut from urls.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.select("*", F.octet_length("html").alias("n"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    same = rows.where(F.col("n") >= LEAST).select("page_id", F.concat_ws(":", "digest", "n").alias("same"))
    same = written(same.groupBy("same").agg(F.max("page_id").alias("keeper"), F.count("*").alias("c")).where("c > 1").drop("c"), "payloads")
    key = F.when(F.col("n") >= LEAST, F.concat_ws(":", "digest", "n"))
    rows = skew_join(rows.withColumn("same", key), same, "same") if same.take(1) else rows.withColumn("keeper", F.lit(None).cast("long"))
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), "[\\r\\n]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    lines = [
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn("keeper"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END), F.col("block"),
    ]
    return rows.withColumn("block", block).select(F.concat(*lines).alias("record"))


def write(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Writes :func:`records` of ``pages`` into part files under ``path``."""
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Each stretch of a file up to the next magic, with its place: file, split and order in the split."""
    rows = spark.read.option("lineSep", SPLIT).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("order"))


def _field(header, name: str):
    return F.regexp_extract(header, f"(?i)(?:^|\\r\\n){name}:[ \\t]*([^\\r\\n]*)", 1)


def _hex(digest):
    """A stated SHA-1 (``sha1:`` and hex or base32 digits) as lower-case hex; null for anything else."""
    plain = F.lower(F.regexp_extract(digest, "(?i)^sha1:([0-9a-f]{40})$", 1))
    letters = F.upper(F.regexp_extract(digest, "(?i)^sha1:([a-z2-7]{32})$", 1))
    bits = F.array_join(F.transform(F.split(letters, ""), lambda c: F.lpad(F.bin(F.instr(F.lit(BASE32), c) - 1), 5, "0")), "")
    given = F.concat(*[F.lpad(F.lower(F.conv(F.substring(bits, 1 + 40 * i, 40), 2, 16)), 10, "0") for i in range(4)])
    return F.when(plain != "", plain).when(letters != "", given)


def _parsed(value) -> list:
    """Columns of what a candidate's bytes say, payload digest included if they are whole."""
    raw, header = value.cast("binary"), F.substring_index(value, END, 1)
    size = F.expr("try_cast(nullif(trim(length_), '') as long)")
    # a payload follows the HTTP header, or is the whole block; a block that ends within its HTTP header has none
    after, end = F.octet_length(header) + 4, F.octet_length(header) + 4 + size
    kind = _field(header, "Content-Type")
    http = kind.rlike("(?i)^application/http") | ((kind == "") & F.substring_index(F.substring_index(value, END, 2), END, -1).startswith("HTTP/"))
    start = F.when(http, F.least(F.octet_length(F.substring_index(value, END, 2)) + 4, F.greatest(after, end))).otherwise(after)
    return [
        F.octet_length(value).cast("long").alias("size"),
        F.when(value.rlike("^[01]\\r\\n") & (F.octet_length(header) < F.octet_length(value)) & (size >= 0), F.octet_length(header) + 4 + size).alias("record_size"),
        _field(header, "WARC-Type").alias("record_type"),
        F.regexp_extract(_field(header, "WARC-Record-ID"), "<urn:x-page:(-?[0-9]*)>", 1).alias("id"),
        F.regexp_extract(_field(header, "WARC-Refers-To"), "<urn:x-page:(-?[0-9]*)>", 1).alias("refers"),
        _hex(_field(header, "WARC-Payload-Digest")).alias("stated"),
        F.expr("try_cast(nullif(trim(http_length_), '') as long)").alias("stated_bytes"),
        start.alias("payload_start"),
        (end - start).alias("payload_bytes"),
        F.when(F.octet_length(value) >= end, F.sha1(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")))).alias("digest"),
    ]


def _with_fields(rows: DataFrame, value: str = "value") -> DataFrame:
    header = F.substring_index(value, END, 1)
    http = F.substring_index(F.substring_index(value, END, 2), END, -1)
    rows = rows.withColumn("length_", _field(header, "Content-Length")).withColumn("http_length_", _field(http, "Content-Length"))
    return rows.select(*[c for c in rows.columns if c not in (value, "length_", "http_length_")], *_parsed(F.col(value)))


def _reached(cands: DataFrame) -> DataFrame:
    """``(file, run, entry)``: the runs of candidates that a chain from their file's start enters, and where."""
    runs = cands.groupBy("file", "run").agg(F.max("next").alias("exit"))
    entry = cands.select("file", F.col("run").alias("next_run"), F.col("offset").alias("exit"))
    jump = written(runs.join(entry, ["file", "exit"]).select("file", "run", "next_run", "exit"), "jumps")
    start = cands.where("offset = 0").select("file", "run", F.col("offset").alias("entry"))
    if not jump.take(1):
        return start
    reach, n = written(start.select("file", "run"), "reached"), -1
    leap = jump.select("file", "run", "next_run")
    while True:  # after k rounds: what is within 2**k - 1 runs
        size = reach.count()
        if size == n:
            break
        n = size
        step = reach.join(leap, ["file", "run"]).select("file", F.col("next_run").alias("run"))
        reach = written(reach.unionByName(step).distinct(), "reached")
        leap = written(leap.join(leap.select("file", F.col("run").alias("next_run"), F.col("next_run").alias("far")), ["file", "next_run"]).select("file", "run", F.col("far").alias("next_run")), "leaps")
    into = reach.join(jump, ["file", "run"]).select("file", F.col("next_run").alias("run"), F.col("exit").alias("entry"))
    return start.unionByName(into)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives under ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Pages are records of type response, resource and revisit, whoever wrote them; records of other types are passed over.
    A payload is what follows the HTTP header in a block of type application/http (or of no type, if it begins as one), else the whole block; a block that ends
    before its HTTP header does has an empty payload. Ids that :func:`write` doesn't give (such as ``urn:uuid:``) are null.
    ``payload_digest`` is measured on a response's payload; a revisit has no payload of its own, and its
    size and digest are those that its headers state: SHA-1 in hex or base32, null if stated otherwise or not at all. A last record that is cut short is left out, and so is
    what follows bytes that are no record: the chain ends there. Empty folders give no rows. Versions 1.0 and 1.1 are read, and files
    whose names end in .gz, each record compressed by itself or all as one.
    """
    d = len(SPLIT)
    rows = written(_with_fields(_chunks(spark, path)), "candidates")
    splits = rows.groupBy("file", "split").agg(F.sum(F.col("size") + d).alias("bytes"))
    by_file = Window.partitionBy("file").orderBy("split")
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), (F.sum("bytes").over(Window.partitionBy("file")) - d).alias("file_bytes"))
    in_split = Window.partitionBy("file", "split").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("before", F.coalesce(F.sum(F.col("size") + d).over(in_split), F.lit(0))).join(splits, ["file", "split"])
    at = at.withColumn("offset", F.col("base") + F.col("before") - d).where("offset >= 0")
    at = at.withColumn("next", F.when(F.col("offset") + d + F.col("record_size") + 4 <= F.col("file_bytes"), F.col("offset") + d + F.col("record_size") + 4))
    in_file = Window.partitionBy("file").orderBy("offset")
    broken = F.when(F.lag("next").over(in_file).eqNullSafe(F.col("offset")), 0).otherwise(1)
    cands = at.withColumn("broken", broken).withColumn("run", F.sum("broken").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    cands = written(cands.drop("base", "before", "broken", "file_bytes"), "offsets")
    good = cands.join(_reached(cands), ["file", "run"], "left").withColumn("real", F.coalesce(F.col("offset") >= F.col("entry"), F.lit(False)) & F.col("next").isNotNull())
    real = good.where("real").where(F.col("record_type").isin(PAGES))
    if real.where("digest is null").take(1):
        real = real.where("digest is not null").unionByName(_mended(spark, path, good).where(F.col("record_type").isin(PAGES)))
    revisit = F.col("record_type") == "revisit"
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') as long)")
    return real.select(number("id").alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"), F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", F.when(revisit, number("refers")).alias("refers_to"))


def _mended(spark: SparkSession, path: str, good: DataFrame) -> DataFrame:
    """The real records whose payloads hold the magic, put together again from their stretches."""
    last = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = good.withColumn("owner", F.last(F.when(F.col("real"), F.struct("offset", "digest")), ignorenulls=True).over(last))
    parts = written(owned.where("owner.digest is null and owner.offset is not null").select("file", "split", "order", "offset", F.col("owner.offset").alias("owner")), "parts")
    text = _chunks(spark, path).join(parts, ["file", "split", "order"])
    whole = text.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("x"))
    whole = whole.select("file", F.col("owner").alias("offset"), F.concat_ws(SPLIT, F.col("x.value")).alias("value"))
    fields = _with_fields(whole).select("file", "offset", "digest", "payload_bytes", "stated_bytes")
    return good.where("real and digest is null").drop("digest", "payload_bytes", "stated_bytes").join(fields, ["file", "offset"]).select(*good.columns)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into archives in the shared folder and reads them back (see :func:`read`)."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
