"""Queries over sources, sinks, increments, resolution of evidence and sweeps, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import vectors as V
from kindred.operators import audit as A
from kindred.operators import graph as G
from kindred.operators import ledger as L
from kindred.plans import audit as P
from kindred.plans import queries as Q
from kindred.plans import workflow
from kindred.sources import readers as S
from kindred.sources.readers import table
from kindred.storage import new_folder, staged
from kindred.streaming.increments import process_new_files

RULES = [("EXACT_CONTENT", "AUTO", True), ("SAME_LANGUAGE", "REVIEW_ONLY", False), ("LENGTH_MATCH", "APPROVED_REQUIRED", True)]
BETAS = (0.01, 0.05, 0.1, 0.2, 0.3)


def jsonl_round_trip(spark, sf_dir):
    """Documents written as compressed JSONL and read back under an explicit schema; every row knows its split and that it has a file."""
    path = new_folder(spark, "jsonl")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.option("compression", "gzip").json(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])
    d = S.read_jsonl(spark, path, schema, split="train")
    return d.select("doc_id", "lang", F.sha2("text", 256).alias("h"), "_split", (F.col("_source_file") != "").alias("has_file"))


def keyset_pages(spark, sf_dir):
    """Three pages of a hundred documents by (lang, doc_id), each after the last key of the one before."""
    d, after, out = table(spark, sf_dir, "documents").where("lang is not null").select("lang", "doc_id"), None, None
    for i in range(3):
        page = staged(S.page_after(d, ["lang", "doc_id"], after, 100), "page", few=True)
        last = page.orderBy(F.desc("lang"), F.desc("doc_id")).first()
        if last is None:
            break
        after = tuple(last)
        page = page.withColumn("page", F.lit(i))
        out = page if out is None else out.unionByName(page)
    return out if out is not None else d.limit(0).withColumn("page", F.lit(0))


def written_once(spark, sf_dir):
    """A target that exists is not replaced: what the first write stored is what is read, and the second is refused."""
    path = new_folder(spark, "once")
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    S.write_once(d, path)
    try:
        S.write_once(d.withColumn("n", F.lit(0).cast("long")), path)
        refused = False
    except Exception as e:  # Spark's own error of an existing path
        refused = "exists" in str(e).lower()
    return spark.read.parquet(path).withColumn("second_refused", F.lit(refused))


def cache_misses(spark, sf_dir):
    """Documents that the cache of labels doesn't have yet."""
    return S.missing_from(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def insert_or_conflict(spark, sf_dir):
    """Documents against a store that has every third, every sixth with another payload: what is new, and what conflicts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    store = d.where("doc_id % 3 = 0").withColumn("h", F.when(F.col("doc_id") % 6 == 0, F.lit("other")).otherwise(F.col("h")))
    new, conflicts = L.put_or_conflict(store, d, "doc_id", "h")
    return new.withColumn("kind", F.lit("new")).unionByName(conflicts.withColumn("kind", F.lit("conflict"))).groupBy("kind").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def streamed_increment(spark, sf_dir):
    """Long documents, through a stream that commits each batch and its place together; a second call finds nothing new."""
    out, checkpoint = new_folder(spark, "stream"), new_folder(spark, "commits")
    schema = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        process_new_files(spark, f"{sf_dir}/documents.parque[t]", schema, lambda d: d.where("n_chars > 500").select("doc_id", "n_chars"), out, checkpoint)
    return spark.read.parquet(out)


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pairs of neighbouring documents by kind, and dispositions for some of those that need one."""
    d = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.concat_ws("/", "source", "lang").alias("node"))
    pair = d.alias("x").join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("node").alias("other")), "doc_id")
    c = pair.select(F.col("doc_id").alias("candidate_id"), F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("edge_type"), F.col("node").alias("a"), F.col("other").alias("b"))
    given = c.where("edge_type = 'LENGTH_MATCH' and candidate_id % 4 <> 0").select("candidate_id", F.when(F.col("candidate_id") % 5 == 0, "REJECTED").otherwise("APPROVED").alias("disposition"), F.lit("p1").alias("protocol_sha256"))
    return c, given


def _resolved(spark, sf_dir) -> DataFrame:
    c, given = _candidates(spark, sf_dir)
    return G.resolved_edges(c, given, spark.createDataFrame(RULES, "edge_type string, requirement string, connects boolean"), "p1")


def evidence_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("candidate_id", "edge_type", "a", "b", "review_status", "connecting")


def graph_completeness(spark, sf_dir):
    """Edges by kind: all, approved, rejected, unresolved, connecting."""
    e, n = _resolved(spark, sf_dir), lambda s: F.count_if(F.col("review_status") == s)
    return e.groupBy("edge_type").agg(F.count("*").alias("edges"), n("APPROVED").alias("approved"), n("REJECTED").alias("rejected"), n("UNRESOLVED").alias("unresolved"), n("REVIEW_ONLY").alias("review_only"), F.count_if("connecting").alias("connecting"))


def evidence_outcome(spark, sf_dir):
    """Outcome of the resolved graph: incomplete metadata before open reviews before crossings."""
    e = staged(_resolved(spark, sf_dir), "resolved", few=True)
    open_ = e.where("review_status = 'UNRESOLVED'").count()
    missing = table(spark, sf_dir, "documents").where("source is null").count()
    crossings = e.where(F.col("connecting") & (F.substring_index("a", "/", 1) != F.substring_index("b", "/", 1))).count()
    rows = [("all", G.outcome(missing == 0, open_, crossings)), ("reviewed", G.outcome(True, 0, crossings)), ("alone", G.outcome(True, 0, 0))]
    return spark.createDataFrame(rows, "what string, outcome string")


def workflow_steps(spark, sf_dir):
    """Counting, checking and reporting as steps: a blocked one ends the run, and a second run takes the first one's results over."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    steps = [
        ("count", lambda s: ("COMPLETED", {"documents": docs.count()})),
        ("check", lambda s: ("COMPLETED", {"labels": labels.join(docs, "doc_id", "left_semi").count(), "documents": s["count"]["documents"]})),
        ("review", lambda s: ("BLOCKED", {"unlabelled": s["check"]["documents"] - s["check"]["labels"]})),
        ("report", lambda s: ("COMPLETED", {})),
    ]
    first = workflow.run(steps, {"protocol": "p1"})
    again = workflow.run(steps, {"protocol": "p1"}, first)
    return spark.createDataFrame([(i, a.name, a.status, L.canonical_json(a.output), a.output_sha256 == b.output_sha256) for i, (a, b) in enumerate(zip(first, again, strict=True))], "step int, name string, status string, output string, same boolean")


# vectors


def unit_rows(spark, sf_dir):
    """Rows scaled to length 1, and their length."""
    e = Q._vectors(spark, sf_dir).select("id", V.unit(F.col("v")).alias("u"))
    return e.select("id", F.transform("u", lambda x: F.round(x, 6)).alias("u"), F.round(V.norm(F.col("u")), 6).alias("length"))


def standardised(spark, sf_dir):
    """All components less their mean, in population deviations (1 where that is 0)."""
    e = Q._vectors(spark, sf_dir).select("id", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(Q.DIM)])
    m = e.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(Q.DIM)], *[F.stddev_pop(f"v{i}").alias(f"s{i}") for i in range(Q.DIM)]).first()
    z = [F.round((F.col(f"v{i}") - F.lit(m[f"m{i}"])) / F.lit(m[f"s{i}"] or 1.0), 6) for i in range(Q.DIM)]
    return e.select("id", F.array(*z).alias("z"))


# the sweep: residual mass at five levels and the oracle, over all forms


def evaluation_sweep(spark, sf_dir):
    m = staged(P._mass(spark, sf_dir).select("id", "label", "form", "p", "truth"), "mass", few=True)
    level = F.explode(F.array(*map(F.lit, BETAS))).alias("level")
    mass = m.select("label", "form", "truth", "p", level).withColumn("accepted", (F.col("p") <= F.col("level")) | (F.col("p") >= 1 - F.col("level")))
    mass = mass.select(F.lit("residual_mass").alias("method"), "level", "form", "label", (F.col("p") > 0.5).alias("prediction"), "truth", "accepted", F.when(~F.col("accepted"), "refused_empirical_support_disagreement").alias("reason"))
    t = Q._margins(spark, sf_dir).where("not calibration")
    clear = F.array_min(F.transform("truth", F.abs)) > 0.02
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), q.truth(F.col("truth")).alias("truth")) for n, q in Q.FORMS.items()])).alias("x")
    oracle = t.select("label", clear.alias("accepted"), each).select(F.lit("oracle").alias("method"), F.lit(0.02).alias("level"), "x.form", "label", F.col("x.truth").alias("prediction"), "x.truth", "accepted", F.when(~F.col("accepted"), "refused_close_to_the_threshold").alias("reason"))
    d = A.selective_diagnostics(mass.unionByName(oracle), ["method", "level", "form"], "label")
    return d.select("method", "level", "form", "rows", "accepted", "errors", "refused", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"), F.round("std_risk", 6).alias("std_risk"))


_CAND = "n AS (SELECT doc_id, concat_ws('/', source, lang) AS node FROM documents WHERE source IS NOT NULL), c AS (SELECT x.doc_id AS candidate_id, ['EXACT_CONTENT', 'SAME_LANGUAGE', 'LENGTH_MATCH'][(x.doc_id % 3 + 1)::INT] AS edge_type, least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM n x JOIN n y ON y.doc_id = x.doc_id + 1), e AS (SELECT *, CASE WHEN edge_type = 'EXACT_CONTENT' THEN 'APPROVED' WHEN edge_type = 'SAME_LANGUAGE' THEN 'REVIEW_ONLY' WHEN candidate_id % 4 = 0 THEN 'UNRESOLVED' WHEN candidate_id % 5 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS review_status FROM c), f AS (SELECT *, review_status = 'APPROVED' AS connecting FROM e)"
_V = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"

ORACLES = {
    "jsonl_round_trip": "SELECT doc_id, lang, sha256(text) AS h, 'train' AS _split, true AS has_file FROM documents",
    "keyset_pages": "SELECT lang, doc_id, ((rk - 1) // 100)::INT AS page FROM (SELECT lang, doc_id, row_number() OVER (ORDER BY lang, doc_id) AS rk FROM documents WHERE lang IS NOT NULL) WHERE rk <= 300",
    "written_once": "SELECT lang, count(*) AS n, true AS second_refused FROM documents GROUP BY lang",
    "cache_misses": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "insert_or_conflict": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'new' WHEN doc_id % 6 = 0 THEN 'conflict' END AS kind FROM documents) SELECT kind, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM d WHERE kind IS NOT NULL GROUP BY kind",
    "streamed_increment": "SELECT doc_id, n_chars FROM documents WHERE n_chars > 500",
    "evidence_resolution": f"WITH {_CAND} SELECT candidate_id, edge_type, a, b, review_status, connecting FROM f",
    "graph_completeness": f"WITH {_CAND} SELECT edge_type, count(*) AS edges, count(*) FILTER (review_status = 'APPROVED') AS approved, count(*) FILTER (review_status = 'REJECTED') AS rejected, count(*) FILTER (review_status = 'UNRESOLVED') AS unresolved, count(*) FILTER (review_status = 'REVIEW_ONLY') AS review_only, count(*) FILTER (connecting) AS connecting FROM f GROUP BY 1",
    "evidence_outcome": f"WITH {_CAND}, k AS (SELECT (SELECT count(*) FROM documents WHERE source IS NULL) AS missing, (SELECT count(*) FROM f WHERE review_status = 'UNRESOLVED') AS unresolved, (SELECT count(*) FROM f WHERE connecting AND split_part(a, '/', 1) <> split_part(b, '/', 1)) AS crossings) SELECT 'all' AS what, CASE WHEN missing > 0 THEN 'METADATA_INCOMPLETE' WHEN unresolved > 0 THEN 'REVIEW_REQUIRED' WHEN crossings > 0 THEN 'ROLE_CROSSING_FOUND' ELSE 'NO_ROLE_CROSSING' END AS outcome FROM k UNION ALL SELECT 'reviewed', CASE WHEN crossings > 0 THEN 'ROLE_CROSSING_FOUND' ELSE 'NO_ROLE_CROSSING' END FROM k UNION ALL SELECT 'alone', 'NO_ROLE_CROSSING' FROM k",
    "workflow_steps": "WITH n AS (SELECT count(*) AS d, (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)) AS l FROM documents) SELECT 0 AS step, 'count' AS name, 'COMPLETED' AS status, '{\"documents\":' || d || '}' AS output, true AS same FROM n UNION ALL SELECT 1, 'check', 'COMPLETED', '{\"documents\":' || d || ',\"labels\":' || l || '}', true FROM n UNION ALL SELECT 2, 'review', 'BLOCKED', '{\"unlabelled\":' || (d - l) || '}', true FROM n",
    "unit_rows": f"WITH {_V}, u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM e) SELECT id, list_transform(v, lambda x: round(x / n, 6) + 0) AS u, 1.0::DOUBLE AS length FROM u",
    "standardised": f"WITH {_V}, x AS (SELECT id, i, v[i] AS x FROM e, range(1, 65) r(i)), z AS (SELECT id, i, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) + 0 AS z FROM x WINDOW w AS (PARTITION BY i)) SELECT id, list(z ORDER BY i) AS z FROM z GROUP BY id",
    "evaluation_sweep": f"WITH {P._MASS}, a AS (SELECT 'residual_mass' AS method, level, form, label, prediction, truth, p <= level OR p >= 1 - level AS accepted FROM y, (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BETAS)}]) AS level) UNION ALL SELECT 'oracle', 0.02::DOUBLE, form, label, truth, truth, id IN (SELECT id FROM m WHERE list_min(list_transform(truth, lambda x: abs(x))) > 0.02) FROM y), g AS (SELECT method, level, form, label, count(*) AS n, count(*) FILTER (accepted) AS k, coalesce(sum((prediction <> truth)::INT) FILTER (accepted), 0) AS e FROM a GROUP BY ALL) SELECT method, level, form, sum(n)::BIGINT AS rows, sum(k)::BIGINT AS accepted, sum(e)::BIGINT AS errors, (sum(n) - sum(k))::BIGINT AS refused, round(sum(k) / sum(n), 6) AS coverage, round(CASE WHEN sum(k) > 0 THEN sum(e) / sum(k) END, 6) AS risk, round(stddev_pop(e / k) FILTER (k > 0), 6) AS std_risk FROM g GROUP BY ALL",
}
