"""Queries over the checks of rows, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import records as R
from kindred.sources.readers import table

SPLITS = ("en", "de", "fr")
ROLES = ("fit", "iteration", "selection", "reserve")


def eligible_rows(spark, sf_dir):
    """Documents with sources as repositories and languages as splits; every seventh hash is spoilt."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), F.col("source"), F.lit("  ")).alias("repository"), F.col("doc_id").alias("stable_key"), F.col("lang").alias("split"), F.when(F.col("doc_id") % 7 == 0, F.upper(h)).otherwise(h).alias("code_sha256"))
    return R.eligibility(d, "repository", "stable_key", "split", SPLITS, ["code_sha256"])


def exact_keys(spark, sf_dir):
    """The rows of every twentieth document, looked up by key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.element_at(F.array(*map(F.lit, ROLES)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("role"))
    return R.exactly(d, d.where("doc_id % 20 = 0").select("doc_id"), "doc_id", "role", ROLES[:3])


def excluded_repositories(spark, sf_dir):
    """Sources of all documents, by language as manifest."""
    return R.excluded_groups(table(spark, sf_dir, "documents").where("source is not null").select("source", F.coalesce("lang", F.lit("")).alias("lang")), "source", "lang")


def repeated_edges(spark, sf_dir):
    """Ids of edges between an order's customer and its priority that stand more than once."""
    o = table(spark, sf_dir, "orders").select(F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("edge_id"))
    return R.repeated(o, "edge_id")


def source_bundles(spark, sf_dir):
    """Whether each source has documents in exactly the languages of the splits."""
    return R.bundles(table(spark, sf_dir, "documents").where("source is not null").select("source", "lang"), "source", "lang", SPLITS)


def inserted_once(spark, sf_dir):
    """Texts inserted in two batches, the odd documents first; what is there already is ignored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    return R.first_inserted([d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")], "content", "doc_id")


_LIST = ", ".join(f"'{s}'" for s in SPLITS)
ORACLES = {
    "eligible_rows": f"WITH d AS (SELECT doc_id, coalesce(trim(source), '') AS repository, doc_id::VARCHAR AS stable_key, coalesce(trim(lang), '') AS split, CASE WHEN doc_id % 7 = 0 THEN upper(sha256(coalesce(text, ''))) ELSE sha256(coalesce(text, '')) END AS code_sha256 FROM documents) SELECT *, CASE WHEN repository = '' OR split NOT IN ({_LIST}) THEN 'identity' WHEN code_sha256 <> lower(code_sha256) THEN 'hash' END AS fault FROM d",
    "exact_keys": f"SELECT doc_id, source, n_chars, '{ROLES[0]}' AS role FROM documents WHERE doc_id % 20 = 0",
    "excluded_repositories": "SELECT trim(source) AS source, count(DISTINCT coalesce(lang, '')) AS manifests, count(*) AS row_count FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "repeated_edges": "SELECT sha256(o_custkey::VARCHAR || '|' || o_orderpriority) AS edge_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "source_bundles": f"WITH g AS (SELECT source, list_distinct(list(lang)) AS has FROM documents WHERE source IS NOT NULL GROUP BY source), x AS (SELECT source, array_to_string(list_filter([{_LIST}], lambda k: NOT list_contains(has, k)), ',') AS lacking, len(list_filter(has, lambda k: k NOT IN ({_LIST})))::BIGINT AS others FROM g) SELECT *, lacking = '' AND others = 0 AS exact FROM x",
    "inserted_once": "SELECT sha256(coalesce(text, '')) AS content, arg_min(doc_id, (doc_id % 2 = 0, doc_id)) AS doc_id, arg_min(lang, (doc_id % 2 = 0, doc_id)) AS lang, min(CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END)::INT AS batch FROM documents GROUP BY 1",
}
