"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in 3 bits or fewer differ in at most one bit of one of their
32-bit halves: half the radius, rounded down. So each fingerprint emits the variants of each half
within half the radius, and any linked pair meets in a variant. Of two halves that differ in one
bit, one has odd parity; it is enough that odd halves emit their 32 neighbours and all halves
themselves: 34 variants for each fingerprint on average, where whole-width balls would need 2,081.

Colliding fingerprints are deduplicated first (copies share a fingerprint), then verified bit by bit.
A variant shared by over ``BUCKET`` fingerprints isn't verified pair by pair: its members emit the
balls of their other half and are linked through ball centres, which is exact and linear in their
number (see :func:`_centres`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import appended, batched, fresh, slices
from lockfleet.llm.graph import components, skew_join
from lockfleet.llm.scratch import written

#: Most fingerprints of a variant that are compared pair by pair.
BUCKET = 256


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text: lower-cased A-Z, ASCII white space, word shingles with repeats.

    Fewer words than a shingle make one shingle; no word, or null, makes zero.
    """
    w = (text or b"").lower().split()
    if not w:
        return 0
    n = min(words, len(w))
    digest = xxhash.xxh64_digest
    if n == 3:
        joined = [digest(b"%b %b %b" % t, seed) for t in zip(w, w[1:], w[2:])]
    else:
        joined = [digest(b" ".join(t), seed) for t in zip(*(w[i:] for i in range(n)))]
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(joined), 65536):
        part = joined[at : at + 65536]
        raw = np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), 8)
        bits += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(joined)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            fp = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fp], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``."""
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with each text's fingerprint as 16 hex digits, and that column's name."""
    name, docs = fresh(docs.columns, "fingerprint"), docs.withColumn("text", F.col("text").cast("string"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield appended(part, **{name: pa.array([f"{fingerprint(t) % 2**64:016x}" for t in texts], pa.string())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` string"])
    return batched(docs).mapInArrow(add, schema), name


def _variants(fps: DataFrame) -> DataFrame:
    """``(half, variant, fp)``: the variants of both halves of each distinct fingerprint."""
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("v")), F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v")))).alias("h")).select("fp", "h.half", "h.v")
    flips = F.array(*[F.lit(1 << i) for i in range(32)])
    near = F.when(F.bit_count("v") % 2 == 1, F.concat(F.array(F.lit(0).cast("long")), flips.cast("array<long>"))).otherwise(F.array(F.lit(0).cast("long")))
    return halves.select("half", "fp", "v", F.explode(near).alias("flip")).select("half", F.col("v").bitwiseXOR(F.col("flip")).alias("variant"), "fp")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifies the members of each variant and yields a chain through each linked set."""
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for members in batch.column(0).to_pylist():
            rest = np.array(sorted(members), dtype=np.int64).view(np.uint64)  # bit counts of signed numbers leave out the sign
            while len(rest):
                queue, rest = [int(rest[0])], rest[1:]
                while queue and len(rest):
                    one = queue.pop()
                    near = np.bitwise_count(rest ^ np.uint64(one)) <= 3
                    for x in rest[near].tolist():
                        a.append(one)
                        b.append(x)
                        queue.append(x)
                    rest = rest[~near]
        ends = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
        yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _centres(hot: DataFrame) -> DataFrame:
    """Links within crowded variants, exact and without comparing pairs.

    A fingerprint that emitted ``variant`` differs from it in d (0 or 1) bits of that half. It emits
    each centre c = (variant, ball of the other half) with its distance r = d + distance to c, for
    r up to 2. Members at distances r and s of a centre differ in r + s bits at most, so a member at
    distance 1 or 0 is linked to all of its centre's members; two at distance 2 aren't by this
    centre alone. And a linked pair has such a centre: on a shortest way between the two that
    passes through the variant, one that lies 1 from either end. So each centre with a
    member at distance 0 or 1 links all its members to the least such member. Distinct fingerprints
    within 2 of a centre number 2,081 at most, however many rows there are.
    """
    mine = F.when(F.col("half") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    other = F.when(F.col("half") == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    ones = [1 << i for i in range(32)]
    near = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(m).cast("long").alias("m")) for r, m in [(0, 0), *((1, x) for x in ones)]])
    twos = F.array(*[F.struct(F.lit(2).alias("r"), F.lit(x | y).cast("long").alias("m")) for i, x in enumerate(ones) for y in ones[:i]])
    at = hot.select("half", "variant", "fp", F.bit_count(mine.bitwiseXOR(F.col("variant"))).alias("d"), other.alias("o"))
    balls = at.select("*", F.explode(near).alias("e")).unionByName(at.where("d = 0").select("*", F.explode(twos).alias("e")))
    balls = balls.select("half", "variant", F.col("o").bitwiseXOR(F.col("e.m")).alias("c"), "fp", (F.col("d") + F.col("e.r")).alias("r")).where("r <= 2")
    low = balls.where("r <= 1").groupBy("half", "variant", "c").agg(F.min("fp").alias("a"))
    return balls.join(low, ["half", "variant", "c"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` between distinct fingerprints ``fps(fp)``: same components as all pairs within 3 bits."""
    keys = _variants(fps)
    counts = keys.groupBy("half", "variant").agg(F.count("*").alias("n"))
    crowded = written(counts.where(F.col("n") > bucket).drop("n"), "crowded")
    any_crowded = bool(crowded.take(1))
    few = keys.join(crowded, ["half", "variant"], "left_anti") if any_crowded else keys
    few = few.groupBy("half", "variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    out = few.select("fps").mapInArrow(_linked, "a long, b long")
    if any_crowded:
        out = out.unionByName(_centres(keys.join(crowded, ["half", "variant"])))
    return out.distinct()


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id`` (see :func:`groups`)."""
    return groups(docs, bucket).drop("root")


def groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id, root``; a component has one root of its own.

    Fingerprints link at 3 or fewer differing bits; ``component_id`` is the smallest doc_id reachable
    by links, the document's own included. Null and blank texts have fingerprint zero and link
    like any other. Repeated rows give repeated rows. A null doc_id is never a component's id: such
    a row has its component's smallest id, or null if there is none. An empty table gives no rows.
    """
    fps = written(fingerprints(docs), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = written(components(links(least.select("fp"))).select(F.col("node").alias("fp"), "root"), "roots")
    tied = written(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "tied")
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = written(skew_join(tied, ids, "root", "inner", rows="n").select("fp", "component_id", "root"), "components")
    return skew_join(fps, ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")
