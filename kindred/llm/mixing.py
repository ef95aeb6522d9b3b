"""Operator 8 [native]: mixing sources to target weights by a low-discrepancy source schedule.

Point i of the schedule is frac(i / golden ratio); mapped through the cumulative target shares it names
the source of slot i. The slots of a source are ranked, and slot k of a source plays block k modulo the
number of its blocks, where the source's documents, shuffled by hash, lie end to end and are cut into
blocks of equally many words. So every prefix of the schedule is close to the target shares, whatever the
number of sources, and a source that is wanted more than once repeats evenly.

Only DataFrame functions. No window runs over a whole source: running sums are taken in buckets of bounded
size (by hash range of documents, by index range of slots), and only one row per source and bucket meets
in a window, where it gets the sum of the buckets before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.storage import staged

WEIGHTS, SHARE, REPEAT, BLOCK = (5, 2, 1), 1.5, 2.0, 64
GOLDEN = (math.sqrt(5) - 1) / 2
#: Cells of the line of shares.
CELLS = 1024
#: Rows of one bucket that a window sorts at once, about.
BUCKET = 4096


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and tab to carriage return; null: 0."""
    # each run becomes one letter, white space goes: what is left has one character per word
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """``(source, rank, source_size, target)`` from ``(source, source_size)``: one row per source.

    Weights go round by code point, null last; targets stop at ``repeat`` times the size, and the excess goes
    to the others by weight until none is above: with t = size * repeat / weight rising, the sources that stop
    are the first ones, as long as the level that the rest would share is above their t.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    rising = W.orderBy(F.col("cap") / F.col("w"), "rank")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rising.rowsBetween(0, W.unboundedFollowing)))
    # the level at the first source that doesn't stop
    final = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "rank", F.col("level").alias("level")))).over(everything)["level"]
    return ranked.withColumn("final", final).select("source", "rank", "source_size", F.coalesce(F.least(F.col("final") * F.col("w"), F.col("cap")), F.col("cap"), F.lit(0.0)).alias("target"))


def _running(rows: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """``rows`` with the sum of value over the rows before each in its groups, ordered by bucket and then by order."""
    inner = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*groups, bucket, F.coalesce(F.sum("_sum").over(W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_before"))
    own = rows.withColumn("_own", F.sum(value).over(inner) - value)
    return own.join(sums, [*groups, bucket]).withColumn(out, F.col("_before") + F.col("_own")).drop("_before", "_own")


def schedule(targets: DataFrame, total: int, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``(slot, rank, nth)``: the source of every slot and how many slots of it come before."""
    spark = targets.sparkSession
    slots = max(1, math.ceil(total / block)) if total > 0 else 0
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, slots // bucket + 1))
    point = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    slot = spark.range(0, slots, 1, parts).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    up = F.sum("target").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) / F.sum("target").over(W.partitionBy())
    shares = targets.where("target > 0").select("rank", up.alias("up"))
    shares = shares.withColumn("low", F.coalesce(F.lag("up").over(W.orderBy("rank")), F.lit(0.0)))
    # the line of shares in cells: a slot meets the sources of its cell only
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("up") * CELLS))))
    placed = slot.withColumn("cell", F.floor(F.col("u") * CELLS)).join(shares, "cell").where("low <= u and u < up")
    placed = placed.select("slot", "rank", F.floor(F.col("slot") / bucket).alias("b"))
    return _running(placed, ["rank"], "b", [F.col("slot")], F.lit(1).cast("long"), "nth").select("slot", "rank", "nth")


def _laid_and_played(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], share: float, repeat: float, block: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Documents in the order of their source (row, k, th, size, source_size, target), and their parts in blocks: row, from and to (words of the document), times."""
    src = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("th"))
    # h: place in the shuffle of its source, from hashes that any engine has
    src = staged(src.withColumn("h", F.sha2(F.coalesce(F.col("k").cast("string"), F.lit("")), 256)), "sizes", like=docs)
    targets = staged(source_targets(src.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat), "targets", few=True)
    facts = targets.agg(F.sum("target").alias("all"), F.sum("source_size").alias("words")).first()
    total = int(round(facts["all"] or 0))
    slots = staged(schedule(targets, total, block, bucket), "schedule")
    count = src.count()
    # buckets of documents by the leading hash digits, so many that each holds about ``bucket`` documents
    digits = max(1, math.ceil(math.log(max(1, count / bucket), 16)))
    named = src.join(targets.select(F.col("source").alias("_s"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    laid = _running(named.withColumn("b", F.substring("h", 1, digits)), ["rank"], "b", [F.col("h"), F.col("size"), F.col("th")], F.col("size"), "at")
    laid = staged(laid.select("k", "th", "size", "source_size", "target", "rank", "at", F.monotonically_increasing_id().alias("row")), "laid")
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / block))
    plays = slots.join(targets.select("rank", "source_size", "target"), "rank")
    # the last words of a target may need no whole slot more, and never more than ``repeat`` rounds
    plays = plays.where(F.col("nth") < F.floor(F.lit(float(repeat))) * blocks).select("rank", (F.col("nth") % blocks).alias("block")).groupBy("rank", "block").agg(F.count("*").alias("times"))
    piece = laid.where("size > 0").select("row", "rank", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    begin, end = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    piece = piece.join(plays, ["rank", "block"]).select("row", (begin - F.col("at")).cast("int").alias("from"), (end - F.col("at")).cast("int").alias("to"), F.col("times").cast("int").alias("times"))
    return laid, piece


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: key, ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (words that the mix takes of it, repeats counted).

    A null text has size 0 and is never taken; null is a source of its own, the last. Rows with equal or null
    keys are separate documents (their hash order is settled by size and text hash; wholly equal rows may
    swap places, which changes nothing). Further columns are ignored; an empty table gives no rows.
    """
    laid, piece = _laid_and_played(docs, key, text, source, weights, share, repeat, block, bucket)
    taken = piece.groupBy("row").agg(F.sum((F.col("to") - F.col("from")).cast("long") * F.col("times")).alias("taken"))
    return laid.join(taken, "row", "left").select(F.col("k").alias(key), "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT, block: int = BLOCK, bucket: int = BUCKET
) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document's words as often as the schedule plays the blocks that they lie in.

    A document whose blocks are all played m times comes m times as it is. Where only some of its blocks have a
    j-th turn, its j-th row holds the words of those alone, joined by a space, with ``n_chars`` (if there is such
    a column) of their length. So each source has exactly the words that its slots took. Rows without words, and
    those none of whose blocks is played, go; null keys and sources, repeated keys and empty tables as in
    ``mix_sources``; wholly equal rows play alike. Columns may have any names.
    """
    laid, piece = _laid_and_played(docs, key, text, source, weights, share, repeat, block, bucket)
    # as many parts as the document has blocks
    turns = piece.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "to", "times"))).alias("parts"), F.max("times").alias("most"), F.min("times").alias("least"), F.sum(F.col("to") - F.col("from")).alias("seen"))
    turns = laid.select("row", F.col("k").alias("mix_key"), F.col("th").alias("mix_hash"), "size").join(turns, "row")
    turns = turns.withColumn("least", F.when(F.col("seen") == F.col("size"), F.col("least")).otherwise(0))
    turns = turns.groupBy("mix_key", "mix_hash").agg(F.max(F.struct("most", "least", "parts")).alias("mix"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[key].alias("doc_key"), F.xxhash64(docs[text]).alias("doc_hash"))
    met = whole.join(turns, (F.col("doc_hash") == F.col("mix_hash")) & F.col("doc_key").eqNullSafe(F.col("mix_key")))
    met = met.select("doc", "mix.*", F.explode(F.sequence(F.lit(1), F.col("mix.most"))).alias("turn"))
    own = F.col("doc").getField(text)
    words = F.filter(F.split(own, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    parts = F.filter("parts", lambda p: p["times"] >= F.col("turn"))
    some = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(w, p["from"] + 1, p["to"] - p["from"]))), " ")), F.lit(0))
    met = met.withColumn("cut", F.when(F.col("turn") > F.col("least"), some))
    new = {text: F.coalesce("cut", own)}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col("cut").isNotNull(), F.length("cut").cast(docs.schema[n_chars].dataType)).otherwise(F.col("doc").getField(n_chars))
    return met.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


#: DuckDB: the same schedule, with targets by the same rising order.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, sha256(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, (CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w, n * 2.0::DOUBLE AS cap, sum(n) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT first(level ORDER BY cap / w, rank) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, rank, n, coalesce(least((SELECT level FROM f) * w, cap), cap) AS target, greatest(1, ceil(n / 64))::BIGINT AS blocks FROM l),
c AS (SELECT *, sum(target) OVER (ORDER BY rank) / sum(target) OVER () AS up FROM t),
i AS (SELECT x, (x + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE AS p FROM unnest(range(0, ceil(round((SELECT sum(target) FROM t)) / 64)::BIGINT)) AS r(x)),
b AS (SELECT rank, up, coalesce(lag(up) OVER (ORDER BY rank), 0) AS low FROM c WHERE target > 0),
y AS (SELECT x, rank, row_number() OVER (PARTITION BY rank ORDER BY x) - 1 AS nth FROM i JOIN b ON low <= p - floor(p) AND p - floor(p) < up),
g AS (SELECT rank, nth % blocks AS block, count(*) AS times FROM y JOIN t USING (rank) WHERE nth < 2 * blocks GROUP BY ALL),
o AS (SELECT doc_id, size, rank, n, target, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT doc_id, sum((least(pos + size, (block + 1) * 64) - greatest(pos, block * 64)) * times)::BIGINT AS taken FROM (SELECT *, unnest(range(pos // 64, (pos + size - 1) // 64 + 1)) AS block FROM o WHERE size > 0) JOIN g USING (rank, block) GROUP BY doc_id)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN k USING (doc_id)
"""
