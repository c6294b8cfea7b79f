"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.suffix_tree import scored

    return scored(table(spark, sf_dir, "documents"))


def _ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), _ranks_path())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.token_histogram import report

    return report(table(spark, sf_dir, "documents"), _ranks_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.substring_dedup import repeated

    return repeated(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.licenses import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.chat import digests

    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.vector_codes import report

    return report(table(spark, sf_dir, "embeddings"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lockfleet.llm.piece_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockfleet.llm.periodic import digests, repeated

    return digests(repeated(table(spark, sf_dir, "documents").select("doc_id", "text")))


_ALL = (
    op1_simhash_near_dedup, op2_benchmark_decontamination, op3_lm_scoring, op4_byte_level_bpe, op5_token_counts, op6_substring_dedup, op7_quality_rules,
    op8_license_scans, op9_warc, op10_chat_formatting, op11_vector_codes, op12_sentencepiece, op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}

_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h),
j AS (SELECT p.page_id, p.h, k.keeper IS NOT NULL AND k.keeper IS DISTINCT FROM p.page_id AS revisit, k.keeper
      FROM p LEFT JOIN k ON p.h = k.h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN keeper END AS refers_to
FROM j
"""

_OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
f AS (SELECT dw.doc_id, dw.i, bw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_OP10_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, row_number() OVER w AS n, row_number() OVER w = 1 AND role = 'system' AS sys, (strlen(text) + 3) // 4 + 8 AS whole
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT *, (768 - first(CASE WHEN sys THEN whole ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n)) // 2 AS room FROM a),
c AS (SELECT *, greatest(8, room) AS s, whole > greatest(8, room) AND NOT sys AND room >= 64 AS long, CASE WHEN strlen(text) = length(text) THEN 4 * (room - 8) ELSE room - 8 END AS size FROM b),
k AS (SELECT * REPLACE (CASE WHEN long THEN substr(text, CAST(piece * size + 1 AS BIGINT), CAST(size AS BIGINT)) ELSE text END AS text)
      FROM (SELECT *, unnest(CASE WHEN long THEN range(0, CAST((length(text) + size - 1) // size AS BIGINT)) ELSE [0] END) AS piece FROM c)),
l AS (SELECT *, (strlen(text) + 3) // 4 + 8 AS t, length(role) + length(regexp_replace(role, '[^~<\\[\\]]', '', 'g')) + length(text) + length(regexp_replace(text, '[^~<\\[\\]]', '', 'g')) + 3 AS chars FROM k),
m AS (SELECT *, CAST(sum(t) OVER (PARTITION BY conv_id ORDER BY n, piece ROWS UNBOUNDED PRECEDING) AS BIGINT) - t AS p FROM l),
d AS (SELECT *, coalesce(lag(t > s) OVER (PARTITION BY conv_id ORDER BY p), false) OR t > s AS cut, p // s AS bin FROM m),
e AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS block FROM d),
f AS (SELECT *, (lag(block) OVER w IS DISTINCT FROM block) OR (lag(bin) OVER w IS DISTINCT FROM bin) AS head,
             sum(CASE WHEN sys THEN 0 ELSE chars END) OVER (PARTITION BY conv_id ORDER BY p RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING) AS back,
             sum(CASE WHEN sys THEN chars ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_sys
      FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY p))
SELECT conv_id, count(*) FILTER (piece = 0) AS n_turns, sha256(string_agg(CASE WHEN piece = 0 THEN role || chr(10) ELSE '' END || text || CASE WHEN last THEN chr(10) ELSE '' END, '' ORDER BY p)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY p), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN head THEN 7 + coalesce(back, 0) + coalesce(lead_sys, 0) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM (SELECT *, lead(n) OVER (PARTITION BY conv_id ORDER BY p) IS DISTINCT FROM n AS last FROM f) GROUP BY conv_id
"""



def _op11_sql(rounds: int = 4) -> str:
    """Codebooks round by round: ``b0`` to ``b4`` are the entries, ``a0`` to ``a4`` the parts with their nearest entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, p, any_value(x.part) AS part, min(k) % 256 AS entry, min(k) // 256 AS d
      FROM (SELECT x.rid, x.p, x.part, CAST(list_inner_product(x.part, x.part) - 2 * list_inner_product(x.part, b.part) + list_inner_product(b.part, b.part) AS BIGINT) * 256 + b.entry AS k
            FROM x JOIN b{r} b ON b.p = x.p) x GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(n.part, b.part) AS part
      FROM b{r} b LEFT JOIN (SELECT p, entry, list(m ORDER BY pos) AS part
                             FROM (SELECT p, entry, pos, floor(sum(v) / count(*)) AS m FROM (SELECT p, entry, unnest(part) AS v, generate_subscripts(part, 1) AS pos FROM a{r}) GROUP BY p, entry, pos)
                             GROUP BY p, entry) n ON n.p = b.p AND n.entry = b.entry)""")
    chain = ",\n".join(steps)
    return f"""
WITH v AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS rid, len(embedding) // 4 AS m FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT rid, p, list_transform(embedding[p * m + 1:(p + 1) * m], lambda x: floor(1024 * CAST(x AS DOUBLE))) AS part FROM (SELECT *, unnest([0, 1, 2, 3]) AS p FROM v)),
b0 AS (SELECT p, rid - 1 AS entry, part FROM x WHERE rid <= 256),
{chain},
s AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, pos)) AS codebooks_sha256 FROM (SELECT p, entry, unnest(part) AS v, generate_subscripts(part, 1) AS pos FROM b{rounds})),
c AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), s
"""


#: SQL with the same result, by query.
ORACLE_SQL: dict[str, str] = {"op2_benchmark_decontamination": _OP2_SQL, "op9_warc": _OP9_SQL, "op10_chat_formatting": _OP10_SQL, "op11_vector_codes": _op11_sql()}
