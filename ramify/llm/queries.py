"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embed_dedup, html_extract, importance, licenses, linededup, packing, quality, simhash, toxicity, urlfilter, whitening
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.EXACT)
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"), removed="lines_removed")
    return kept.select("doc_id", "text", "lines_removed")


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's distribution of word runs; the others without a rank."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_ann": op3_ann,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_linededup": op7_linededup,
    "op8_embed_dedup": op8_embed_dedup,
    "op9_urlfilter": op9_urlfilter,
    "op10_packing": op10_packing,
    "op11_resample": op11_resample,
    "op12_licenses": op12_licenses,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op7_linededup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS k
            FROM documents WHERE text IS NOT NULL
        ), folded AS (
            SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r\\x0b\\f]+', ' ', 'g'))) AS n FROM lines
        ), classes AS (
            SELECT n, length(n) AS size, min({'d': doc_id, 'k': k}) AS at FROM folded WHERE length(n) >= 20 GROUP BY n
        ), halves AS (
            SELECT *, 0 AS side, (size - 1) // 2 AS m, left(n, (size - 1) // 2) AS half FROM classes
            UNION SELECT *, 0, size // 2, left(n, size // 2) FROM classes
            UNION SELECT *, 1, (size - 1) // 2, right(n, (size - 1) // 2) FROM classes
            UNION SELECT *, 1, size // 2, right(n, size // 2) FROM classes
        ), near AS (
            SELECT DISTINCT a.n FROM halves a JOIN halves b USING (side, m, half)
            WHERE a.at > b.at AND abs(a.size - b.size) <= 1 AND levenshtein(a.n, b.n) <= 1
        ), judged AS (
            SELECT f.doc_id, f.k, f.line,
                   length(f.n) < 20 OR (f.n NOT IN (SELECT n FROM near) AND c.at.d = f.doc_id
                   AND row_number() OVER (PARTITION BY f.doc_id, f.n ORDER BY f.k) = 1) AS stays
            FROM folded f LEFT JOIN classes c USING (n)
        ), kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY k) FILTER (stays) AS text, count(*) FILTER (NOT stays) AS removed
            FROM judged GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
               coalesce(k.removed, 0) AS lines_removed
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
    "op9_urlfilter": """
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw_host,
                   regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM rest
        ), hosts AS (
            SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
        ), ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
            END AS rule
            FROM hosts
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                    WHEN rule IS NOT NULL THEN 'block'
                    WHEN ('.' || host) LIKE '%.spam-farm.example.org' OR ('.' || host) LIKE '%.cheap-pills.example.com' THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op11_resample": """
        WITH RECURSIVE tab(i, c, k) AS (
            SELECT i, i::BIGINT, 0 FROM range(256) r(i)
            UNION ALL
            SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8
        ), texts AS (
            SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
        ), words AS (
            SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
        ), features AS (
            SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
        ), coded AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
                          lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT f FROM features), crc
        ), counted AS (
            SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN coded USING (f) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE
                                           / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM counted
        ), weights AS (
            SELECT id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN coded USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
        ), scored AS (
            SELECT id AS doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM words LEFT JOIN weights USING (id) WHERE side = 0
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
