"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import bpe, clustering, divergence, exact_dedup, jaccard_join, line_dedup, mixing, pu_quality, quality, sstable, substring_dedup, token_counts, warc_zip
from tally.llm.common import materialise

BPE_RANKS, BPE_JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    bitmaps = line_dedup.line_bitmaps(docs, min_chars=40, min_docs=5)
    kept = line_dedup.apply_bitmaps(docs, bitmaps)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer(BPE_RANKS), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts of all prefixes are kept as a table; the digest columns are read from it.
    counts = materialise(token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer(BPE_JSON), budget=1024), "prefix-counts")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "bytes_in_budget")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_archives(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc_zip.read_archives(manifest)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), width=13)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return joined.select(F.col("own_id").alias("doc_id"), "n_shingles", "component_id")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(_table(spark, sf_dir, "documents"), _tokenizer(BPE_JSON), end_id=0)
    return sstable.read_shards(manifest, with_ids=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    p = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return rated.select(F.col("own_id").alias("doc_id"), "n_tokens", *p, "rate")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(_table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, width=32, seed="2:")


def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pu_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select(F.col("own_id").alias("doc_id"), "held_out", "score", "predicted")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc_zip": op5_warc_zip,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sstable": op9_sstable,
    "op10_mixing": op10_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_centroids": op12_centroids,
    "op13_pu_quality": op13_pu_quality,
}

#: DuckDB strings: the ASCII white space that ``trim`` takes off, and as a regular-expression class.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_NONWS = r"[^\x20\x09-\x0D]"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _lloyd_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds one after another, each a pair of tables: the assignment and the moved centroids."""
    nearest = lambda r: f"""a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT v.n, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r} c) s GROUP BY n)"""  # noqa: E731
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS c, x FROM v QUALIFY c < {k})""",
    ]
    for r in range(rounds):
        parts += [
            nearest(r),
            f"""m{r} AS (SELECT cluster, list(m ORDER BY i) AS x FROM (
    SELECT cluster, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT cluster, i, sum(e)::BIGINT AS s, count(*) AS n
      FROM (SELECT a.cluster, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM v JOIN a{r} a ON a.n = v.n) u GROUP BY cluster, i) t) w GROUP BY cluster)""",
            f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.c)""",
        ]
    parts.append(nearest(rounds))
    return f"""WITH {', '.join(parts)}
SELECT v.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON a.n = v.n JOIN c{rounds} c ON c.c = a.cluster"""


ORACLES = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_WS}), {_LOWER}) AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_LOWER})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_warc_zip": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top, sha1(coalesce(html, '')) AS hex
  FROM pages
), bits AS (
  SELECT *, [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)
    FOR i IN range(32)] AS letters
  FROM p
)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits""",
    "op6_substring_dedup": f"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_NONWS}+') AS words FROM documents)
), spans AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS span,
    count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
  FROM w
), repeated AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY md5(span)) AS lo FROM spans WHERE n = 13) WHERE doc_id > lo
), marked AS (
  SELECT w.doc_id, w.pos, w.word,
    max(r.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.pos = r.pos
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_NONWS}+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN [array_to_string(words[i:i + 2], ' ') FOR i IN range(1, len(words) - 1)]
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT d.doc_id, count(shingle) AS n FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN reach r ON r.x = n.doc_id GROUP BY ALL""",
    "op11_source_divergence": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS row
  FROM documents),
w AS (SELECT lang, source, row, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (total::HUGEINT + 5 * v) AS q FROM kept JOIN v USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 5) // (coalesce(o.total, 0)::HUGEINT + 5 * v.v) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) r
QUALIFY part = 'pair' OR rank <= 50""",
    "op12_centroids": _lloyd_sql(40, 5),
}
