"""The registered queries of the ``llm`` operators, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieve.llm.ann import nearest_embeddings
from sieve.llm.common import ship_package
from sieve.llm.langid import predicted_languages
from sieve.llm.linededup import line_dedup_documents
from sieve.llm.mixing import mix
from sieve.llm.packing import pack
from sieve.llm.periodic import periodic_documents
from sieve.llm.sharding import shard_documents
from sieve.llm.simhash import simhash_components
from sieve.llm.tokenfile import token_files
from sieve.llm.topk import scaled_topk
from sieve.llm.toxicity import toxicity_scores
from sieve.llm.variants import variant_groups
from sieve.llm.warc import warc_round_trip

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql.strip()
        return fn
    return deco


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@register()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(_read(spark, sf_dir, "documents"))


@register()
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_embeddings(_read(spark, sf_dir, "embeddings"))


@register()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"))


@register(r"""
WITH quality AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
    SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
        -ln((CAST('0x' || substr(md5('11|' || d.doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
            / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS draw
    FROM documents d LEFT JOIN quality USING (doc_id)),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
    FROM docs GROUP BY source),
ordered AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget,
        coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
    FROM sources),
levels AS (SELECT max((budget - capped) / w_left) FILTER (WHERE (budget - capped) / w_left * w <= cap) AS level FROM ordered),
targets AS (SELECT source, source_size, least(cap, coalesce(level, 0) * w) AS target FROM ordered, levels),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
runs AS (
    SELECT d.*, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::BIGINT AS due,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (epochs * size + greatest(0, least(size, due - before)))::BIGINT AS taken
FROM runs
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_read(spark, sf_dir, "documents"), quality=_read(spark, sf_dir, "labels"), read_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_page FROM payloads GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((CAST('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM payloads JOIN firsts USING (h)
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_read(spark, sf_dir, "pages")).drop("target_uri")


@register()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


@register()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents"))


@register("""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
WHERE rank <= 10
""")
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_topk(_read(spark, sf_dir, "embeddings"))


@register()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@register()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_read(spark, sf_dir, "documents"))


@register()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_documents(_read(spark, sf_dir, "documents"))


@register("""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM docs),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (
    SELECT r, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
    FROM keyed WHERE key NOT IN (SELECT key FROM common) GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
""")
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_documents(_read(spark, sf_dir, "documents"))


@register()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(_read(spark, sf_dir, "documents"))
