"""What JSON payloads must not hold: keys with forbidden parts and long strings, at any depth; digests made again from content.

Payloads become VARIANT values, and all objects and arrays of a level are opened by one lateral join, so a level costs one
pass whatever the payloads look like, and there are as many passes as the deepest payload has levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.storage import staged


def violations(rows: DataFrame, key: str, payload: str, forbidden: tuple[str, ...], longest: int) -> DataFrame:
    """``(key, path, reason)`` of everything that is wrong with the JSON text of each row.

    ``forbidden_key``: a key of an object that holds one of the parts, whatever its case; ``long_string``: a string value of
    more than ``longest`` characters; ``not_json``: the text cannot be read. A path joins keys and places (from 0) by dots. A
    null payload is not JSON; an empty table has no violations. What stands below a forbidden key is looked at too.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("_k"), F.lit("").alias("path"), F.try_parse_json(payload).alias("v"))
    found = [level.where("v is null").select("_k", "path", F.lit("not_json").alias("reason"))]
    level = staged(level.where("v is not null"), "payloads")
    while level.limit(1).count():
        kind = F.schema_of_variant("v")
        text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
        found.append(level.where(F.length(text) > longest).select("_k", "path", F.lit("long_string").alias("reason")))
        inner = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select("_k", "path", "v")
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        own = F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.coalesce(F.col("key"), F.col("pos").cast("string")))
        level = staged(opened.select("_k", own.alias("path"), F.lower("key").alias("name"), F.col("value").alias("v")), "payloads")
        bad = reduce(Column.__or__, [F.col("name").contains(p.lower()) for p in forbidden], F.lit(False))
        found.append(level.where(bad).select("_k", "path", F.lit("forbidden_key").alias("reason")))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_k", key)


def verdicts(rows: DataFrame, key: str, payload: str, forbidden: tuple[str, ...], longest: int) -> DataFrame:
    """``(key, verdict, violations)`` of each row: ``not_json`` before ``forbidden_key`` before ``long_string``, else ``allowed``. Keys are unique."""
    order = {"not_json": 0, "forbidden_key": 1, "long_string": 2}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("reason"))
    worst = violations(rows, key, payload, forbidden, longest).groupBy(key).agg(F.min_by("reason", rank).alias("reason"), F.count("*").alias("n"))
    return rows.select(key).join(worst, key, "left").select(key, F.coalesce("reason", F.lit("allowed")).alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


def payload_digest(payload: Column) -> Column:
    """SHA-256 of a JSON text's content: keys in order, no spaces; texts of equal content have equal digests, and null has none."""
    return F.sha2(F.to_json(F.try_parse_json(payload)), 256)


def tampered(rows: DataFrame, payload: str, digest: str) -> DataFrame:
    """Rows whose digest is not the one that their payload gives, missing digests and unreadable payloads too."""
    return rows.where(~payload_digest(F.col(payload)).eqNullSafe(F.col(digest)) | F.col(digest).isNull())
