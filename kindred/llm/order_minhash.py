"""Operator 7 [native]: document fingerprints by Order MinHash.

A text's k-mers are its runs of ``WIDTH`` words; equal k-mers are numbered by occurrence, so that each
numbered k-mer is unique. One hash deals them into ``BINS`` bins and orders them inside their bin. Each bin
selects the two smallest k-mers at or after its start in that order, round the end, so every bin has two
wherever the text has two k-mers (a thin bin borrows from the next one); it puts them back into text order
and hashes the tuple. A repeated or moved passage changes the tuples, so the share of equal tuples follows
edit distance, not only the set of words. One order cut into bins stands for ``BINS`` separate orders.

Everything is an expression over arrays of 64-bit integers: sort, cut into runs, number, sort again. Values
are bound by one-element ``transform``s, so that no expression is evaluated twice; each step is linear or a
sort. A k-mer is packed with its place of 30 bits: a string holds fewer than 2**31 bytes, so fewer than 2**30
words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.storage import staged

WIDTH = 2
BINS = 32
_BITS = 30
_PLACE = (1 << _BITS) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _upto(n: Column, use: Callable[[Column], Column]) -> Column:
    """[use(0), ..., use(n - 1)]"""
    return F.transform(F.sequence(F.lit(0), n - 1), use)


def _run_starts(a: Column, n: Column, bits: int) -> Column:
    """Places where the leading part (all but ``bits``) of a sorted array changes."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.shiftright(F.get(a, i), bits) != F.shiftright(F.get(a, i - 1), bits)))


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """32 tuples, as ``bin << 32 | hash``, ascending by bin; none for a null text or one without words.

    A text of one k-mer (or of fewer words than ``width``, which are one k-mer) has it alone in all tuples.
    """
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w) - (width - 1), F.lit(1))
        packed = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))
        return F.when(F.size(w) > 0, _let(F.sort_array(_upto(n, packed)), lambda s: _let(_run_starts(s, F.size(s), _BITS), lambda r: of_runs(s, r)))).otherwise(F.array().cast("array<bigint>"))

    def of_runs(s: Column, r: Column) -> Column:
        def numbered(i: Column, start: Column) -> Column:
            # 5 bits of bin, 28 of order, 30 of place
            g = F.xxhash64(F.shiftright(F.get(s, i), _BITS), i - start)
            return F.shiftleft(F.shiftrightunsigned(g, 31), _BITS).bitwiseOR(place(F.get(s, i)))

        run = lambda x: F.transform(F.sequence(F.get(r, x), F.coalesce(F.get(r, x + 1), F.size(s)) - 1), lambda i: numbered(i, F.get(r, x)))
        return _let(F.sort_array(F.flatten(_upto(F.size(r), run))), lambda z: _let(_run_starts(z, F.size(z), 58), lambda starts: of_bins(z, starts)))

    def of_bins(z: Column, starts: Column) -> Column:
        first = lambda b: F.coalesce(F.get(F.filter(starts, lambda i: F.shiftright(F.get(z, i), 58) >= b), F.lit(0)), F.lit(0))
        return _upto(F.lit(BINS), lambda b: _let(first(b), lambda i: of_pair(b, F.get(z, i), F.get(z, (i + 1) % F.size(z)))))

    def of_pair(b: Column, x: Column, y: Column) -> Column:
        u, v = F.shiftright(x, _BITS), F.shiftright(y, _BITS)
        h = F.when(place(x) <= place(y), F.xxhash64(u, v)).otherwise(F.xxhash64(v, u))
        return F.shiftleft(b.cast("long"), 32).bitwiseOR(h.bitwiseAND(F.lit((1 << 32) - 1)))

    return _let(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Share of bins whose tuples agree; 1 if neither text has words, 0 if one has none."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.lit(float(BINS)))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def chain(keys: DataFrame, parts: int) -> DataFrame:
    """``(k, n, next, prev, prev_n)`` of unique non-null keys in ascending order, the last before the first, without a window over all rows."""
    placed = staged(keys.repartitionByRange(parts, "k").withColumn("p", F.spark_partition_id()), "order")
    around = W.partitionBy("p").orderBy("k")
    inner = placed.select("k", "n", "p", F.lead("k").over(around).alias("nx"), F.lag("k").over(around).alias("pv"), F.lag("n").over(around).alias("pn"))
    # the ends of every range: one row per partition
    ends = placed.groupBy("p").agg(F.min_by(F.struct("k", "n"), "k").alias("low"), F.max_by(F.struct("k", "n"), "k").alias("high"))
    line = W.orderBy("p")
    every = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("p", F.coalesce(F.lead("low").over(line), F.first("low").over(every)).alias("after"), F.coalesce(F.lag("high").over(line), F.last("high").over(every)).alias("before"))
    out = inner.join(ends, "p")
    return out.select("k", "n", F.coalesce("nx", "after.k").alias("next"), F.coalesce("pv", "before.k").alias("prev"), F.coalesce("pn", "before.n").alias("prev_n"))


def fingerprints_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: key, ``n_chars``, ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document's, by ascending key; after the last comes the first. Of rows that share a key, the smallest text
    counts as the next one's; a null key comes after all, so the first document follows it. A null text is
    empty; an empty fingerprint is "". Further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select("k", "t", F.length("t").alias("n"), fingerprint(F.col("t"), width).alias("fp"))
    lengths = docs.select(F.col(key).alias("k"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    keys = lengths.where("k is not null").groupBy("k").agg(F.max("n").alias("n"))
    links = staged(chain(keys, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chain")
    placed = base.join(links.select("k", "prev", "prev_n"), "k")
    # what a document lends to the one before it: no more than that one can need
    # (all columns of base, so that both uses of its exchange are one)
    least = placed.groupBy("k").agg(F.min(F.struct("t", "n", "fp")).alias("x"), F.first("prev").alias("prev"), F.first("prev_n").alias("prev_n"))
    lent = least.select(F.col("prev").alias("k"), F.expr("substring(x.t, 1, int(prev_n div 2))").alias("head"), F.col("x.fp").alias("fp_next"))
    rows = base.where("k is not null").join(lent, "k")
    if lengths.where("k is null").limit(1).count():
        first = F.broadcast(base.where(F.col("k") == F.lit(keys.agg(F.min("k")).first()[0])).agg(F.min(F.struct("t", "fp")).alias("x")).select(F.lit(1).alias("one"), F.coalesce("x.t", F.lit("")).alias("head"), F.col("x.fp").alias("fp_next")))
        alone = base.where("k is null").withColumn("one", F.lit(1)).join(first, "one", "left")
        own = alone.select("k", "t", "n", "fp", F.coalesce("head", "t").alias("head"), F.coalesce("fp_next", "fp").alias("fp_next"))
        rows = rows.unionByName(own)
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("t", F.lit(1), F.col("n") - half), F.substring("head", F.lit(1), half)))
    rows = rows.select("k", "n", "edited", "fp", "fp_next", fingerprint(F.col("edited"), width).alias("fe"))
    return rows.select(
        F.col("k").alias(key), F.col("n").cast("long").alias("n_chars"), "edited", printed(F.col("fp")).alias("fingerprint"), printed(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fe")).alias("near_edited"), likeness(F.col("fp"), F.col("fp_next")).alias("near_next"),
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints_with_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
