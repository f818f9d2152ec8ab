"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import decontaminate, exact_dedup, html_extract, language_id, mixing, quality, secrets, simhash, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_read(spark, sf_dir, "documents"))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.occurrences(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.decisions(pages, url_filter.default_entries(pages))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_extract.main_texts(pages, html_extract.fit(pages))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_simhash_near_duplicates, op3_benchmark_decontamination, op4_exact_dedup, op5_toxicity, op6_url_filter, op7_mixing, op8_language_id, op9_quality_classifier, op10_html_extraction)}

_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' ')"
_ENTRIES = ", ".join(f"('{e}', '{d}')" for e, d in url_filter.ENTRIES)

ORACLE_SQL = {
    "op3_benchmark_decontamination": f"""
        WITH items AS (SELECT item_id, string_split({_NORMAL.format("text")}, ' ') AS w FROM benchmark),
        strings AS (
            SELECT DISTINCT item_id, array_to_string(w[k:k + {decontaminate.WINDOW - 1}], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {decontaminate.WINDOW - 2}))) AS k FROM items WHERE w <> [''])
        ),
        docs AS (SELECT doc_id, ' ' || {_NORMAL.format("text")} || ' ' AS t FROM documents)
        SELECT doc_id, item_id, count(*) AS n_strings
        FROM docs JOIN strings ON contains(t, ' ' || s || ' ')
        GROUP BY doc_id, item_id""",
    "op4_exact_dedup": """
        SELECT doc_id, keep_id FROM (
            SELECT doc_id, first_value(doc_id) OVER same AS keep_id, row_number() OVER same AS n
            FROM documents WINDOW same AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
        ) WHERE n > 1""",
    "op6_url_filter": f"""
        WITH entries AS (
            SELECT decision, entry, split_part(entry, '/', 1) AS host, list_filter(string_split(entry, '/')[2:], lambda x: x <> '') AS segments
            FROM (VALUES {_ENTRIES}) AS v(entry, decision)
        ),
        urls AS (
            SELECT page_id, url,
                lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#@]*\\]|[^/?#:@]+)', 1), '.')) AS host,
                list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS segments
            FROM pages
        ),
        found AS (
            SELECT page_id, url, arg_max(struct_pack(d := e.decision, e := e.entry), 1000000 * len(string_split(e.host, '.')) + 10 * len(e.segments) + (e.decision = 'block')::INT) AS best
            FROM urls u JOIN entries e ON ('.' || u.host) LIKE ('%.' || e.host) AND u.segments[1:len(e.segments)] = e.segments
            GROUP BY page_id, url
        )
        SELECT u.page_id, CASE WHEN u.host <> '' THEN coalesce(f.best.d, 'allow') END AS decision, f.best.e AS entry
        FROM urls u LEFT JOIN found f ON u.page_id IS NOT DISTINCT FROM f.page_id AND u.url IS NOT DISTINCT FROM f.url""",
}
