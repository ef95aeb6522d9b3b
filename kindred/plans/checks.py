"""Queries over stores and payloads that are not trusted: matrices in checked chunks, a cache that hashes what it reads, rows that a function fails on, forbidden content."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from kindred.operators import firewall
from kindred.operators.isolate import isolated
from kindred.sources.matrix import read_chunks, write_matrix
from kindred.sources.readers import table
from kindred.storage import new_folder, staged
from kindred.streaming.checked_store import CheckedStore, row_digest

#: Parts of keys that payloads must not have, and the longest string that they may.
FORBIDDEN, LONGEST = ("sku",), 6


def matrix_round_trip(spark, sf_dir):
    """Vectors written as chunks of NPY files with digests, and read back by ranges of bytes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = new_folder(spark, "matrix")
    write_matrix(e, "vec_id", "embedding", path, 4096)
    return read_chunks(spark, path).select(F.col("key").alias("vec_id"), F.transform("v", lambda x: F.round(x, 6)).alias("v"))


def _hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))


def broken_cache(spark, sf_dir):
    """A store in which every seventh document's row was spoilt on disk: those are misses, and hits after they were added again."""
    d = staged(_hashed(spark, sf_dir), "hashes")
    store = CheckedStore(spark, new_folder(spark, "cache"), "doc_id", "h")
    spoilt = d.where("doc_id % 7 = 0")
    store.insert(d.where("doc_id % 7 <> 0"), 0)
    store.insert(spoilt, 1)
    other = spoilt.withColumn("digest", row_digest("doc_id", F.col("h"))).withColumn("h", F.reverse("h")).withColumn("bucket", F.lit(0))
    other.write.mode("overwrite").partitionBy("bucket").parquet(f"{store.path}/batches/batch=1")
    before = staged(store.lookup(d).select("doc_id", F.col("hit").alias("before")), "before")
    store.insert(d, 2)
    return before.join(store.lookup(d).select("doc_id", F.col("hit").alias("after")), "doc_id")


def _number(b: pa.RecordBatch) -> pa.RecordBatch:
    found = [json.loads(s).get("k") for s in b.column("props").to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array([None if k is None else int(k) for k in found], pa.int64())], ["k"])


def isolated_failures(spark, sf_dir):
    """A number from each click's properties; clicks whose properties are missing or broken come alone, with what went wrong."""
    c = table(spark, sf_dir, "clicks").select("click_id", "props")
    return isolated(c, _number, "k long", ["props"]).select("click_id", "k", "failed")


def payload_verdicts(spark, sf_dir):
    c = table(spark, sf_dir, "clicks").select("click_id", "props").distinct()
    return firewall.verdicts(c, "click_id", "props", FORBIDDEN, LONGEST)


ORACLES = {
    "matrix_round_trip": "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6) + 0) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL",
    "broken_cache": "SELECT doc_id, doc_id % 7 <> 0 AS before, true AS after FROM documents",
    "isolated_failures": "SELECT click_id, CASE WHEN json_valid(props) THEN TRY_CAST(TRY(props ->> '$.k') AS BIGINT) END AS k, CASE WHEN props IS NULL THEN 'TypeError' WHEN NOT json_valid(props) THEN 'JSONDecodeError' END AS failed FROM clicks",
    "payload_verdicts": f"""WITH c AS (SELECT DISTINCT click_id, props, coalesce(json_valid(props), false) AS fine FROM clicks),
w AS (SELECT click_id, count(*) FILTER (key LIKE '%sku%') AS a, count(*) FILTER (t.type = 'VARCHAR' AND length(atom ->> '$') > {LONGEST}) AS b
  FROM (SELECT click_id, unnest(json_nodes) AS n FROM (SELECT click_id, (SELECT list(struct_pack(key := j.key, type := j.type, atom := j.atom)) FROM json_tree(props) j) AS json_nodes FROM c WHERE fine)) s, LATERAL (SELECT n.key AS key, n.type AS type, n.atom AS atom) t GROUP BY click_id)
SELECT c.click_id, CASE WHEN NOT fine THEN 'not_json' WHEN a > 0 THEN 'forbidden_key' WHEN b > 0 THEN 'long_string' ELSE 'allowed' END AS verdict, CASE WHEN fine THEN coalesce(a, 0) + coalesce(b, 0) ELSE 1 END AS violations FROM c LEFT JOIN w USING (click_id)""",
}
