"""Operator 13: as-of join with a tolerance, in shards by key hash and time chunk, by DuckDB inside cogrouped Arrow tasks.

Each row of the left table meets the latest right rows of its key at or before its time and at most ``tolerance`` earlier.
Right rows of one key and time are aggregated beforehand to one (the winner of a stated order, and how many tied), with
partial sums in each map task. Time is cut into chunks of equal width; a shard holds the rows of some (key, chunk) pairs,
by hash, so a key with a third of all rows is spread over as many shards as it has chunks. The halo of a chunk is the one
right row that can still match from before it: the last of its key. That is found chunk by chunk: spans of time as long as
the tolerance take the last row of the span before, and inside a span a window over (key, span) carries it on through its
chunks, one row for each. So a right row is sent to its own chunk and at most once for each chunk that needs it as halo.

The width follows the data: the widest power of two of a unit in which no key has more than ``most`` rows in a chunk.
All rows stay in Spark; the driver gets counts.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kindred.llm.tables import table
from kindred.storage import staged

#: Rows of a key in a chunk at most, and rows of a shard about.
MOST, SHARD_ROWS = 4096, 1 << 16
HOUR = 3_600_000_000
#: Units of which widths are made: the first in which chunks are small enough, or else the last.
UNITS = (HOUR, 1_000_000)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    day = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(at)) * 60 + F.minute(at)) * 60_000_000 + second


def floored(x: Column, width: int) -> Column:
    return x - F.pmod(x, F.lit(width))


def chunk_width(left: DataFrame, right: DataFrame, by: str, time: str, tolerance: int, most: int = MOST) -> int:
    """Width of chunks in microseconds: no key has more than ``most`` rows of both tables in one, but for those of one second; at most the tolerance."""
    both = left.select(by, time).unionByName(right.select(by, time)).where(F.col(by).isNotNull() & F.col(time).isNotNull())
    for unit in UNITS:
        n = both.groupBy(by, F.floor(F.col(time) / unit)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        if n <= most:
            return max(1, min(tolerance, unit << int(math.log2(most / n))))
    return UNITS[-1]


def _in_shard(names: list[str], carried: list[str], by: str, time: str, tolerance: int, schema: StructType):
    cols = ", ".join(f"l.{n}" for n in names)
    near = f"r.{time} >= l.{time} - {tolerance}"
    found = ", ".join(f"CASE WHEN {near} THEN r.{c} END AS {c}" for c in carried)
    sql = (
        f"SELECT {cols}, CASE WHEN {near} THEN l.{time} - r.{time} END AS lag, CASE WHEN {near} THEN r.n_tied ELSE 0 END AS n_tied, {found} "
        f"FROM l ASOF LEFT JOIN r ON l.{by} = r.{by} AND l.chunk = r.chunk AND l.{time} >= r.{time}"
    )
    types = pa.schema([(f.name, _arrow(f)) for f in schema.fields])

    def match(l: pa.Table, r: pa.Table) -> pa.Table:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            con.register("l", l)
            con.register("r", r)
            return con.sql(sql).to_arrow_table().select(types.names).cast(types)

    return match


def _arrow(f: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(f.dataType)


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, first: list[Column], carried: list[str], tolerance: int, most: int = MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``left`` with ``lag``, ``n_tied`` and the columns ``carried`` of the matched row of ``right``.

    ``time`` is a long in both tables. Of right rows with equal ``by`` and ``time`` the one that comes ``first`` in the given
    order is matched, and ``n_tied`` counts them all, repeated rows too. Left rows that match nothing (none near enough, a null
    ``by`` or ``time``, an empty right table) have ``n_tied`` 0 and null for the rest; each left row comes back once, repeated
    ones as often as they are there. Right rows with a null ``by`` or ``time`` never match; an empty left table stays empty.
    ``left`` should be a stored table, as it is read several times. Other columns of ``right`` play no part; columns of ``left``
    that are called like a carried one, ``lag``, ``n_tied``, ``chunk`` or ``shard`` are replaced or left out. Rows of one key and one
    second stay in one task.
    """
    left = left.drop(*({*carried, "lag", "n_tied", "chunk", "shard"} - {by, time}))
    spark, names = left.sparkSession, left.columns
    ok = F.col(by).isNotNull() & F.col(time).isNotNull()
    ties = right.where(ok).groupBy(by, time).agg(F.min_by(F.struct(*carried), F.struct(*first)).alias("best"), F.count("*").alias("n_tied"))
    ties = staged(ties.select(by, time, "n_tied", "best.*"), "ties")
    width = chunk_width(left, ties, by, time, tolerance, most)
    chunk = F.floor(F.col(time) / width).cast("long")
    span_chunks = max(1, -(-tolerance // width))

    # the last tie group of each (key, chunk); a span also starts from the last one of the span before
    each = F.struct(time, "n_tied", *carried)
    span = F.floor(F.col("chunk") / span_chunks).cast("long")
    last = ties.withColumn("chunk", chunk).groupBy(by, "chunk").agg(F.max_by(each, time).alias("last")).withColumn("span", span)
    before = last.groupBy(by, "span").agg(F.max_by("last", "chunk").alias("last")).select(by, (F.col("span") + 1).alias("span"), ((F.col("span") + 1) * span_chunks - 1).alias("chunk"), "last", F.lit(False).alias("asked"))
    asked = left.where(ok).select(by, chunk.alias("chunk")).distinct().select(by, span.alias("span"), "chunk", F.lit(None).cast(last.schema["last"].dataType).alias("last"), F.lit(True).alias("asked"))
    steps = asked.unionByName(before).unionByName(last.select(by, "span", "chunk", "last", F.lit(False).alias("asked")))
    carry = F.last("last", ignorenulls=True).over(W.partitionBy(by, "span").orderBy("chunk").rangeBetween(W.unboundedPreceding, -1))
    near = F.col("last")[time] >= F.col("chunk") * width - tolerance
    halo = steps.withColumn("last", carry).where(F.col("asked") & F.col("last").isNotNull() & near).select(by, "chunk", "last.*")

    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(left.count() + ties.count()) // shard_rows))
    shard = F.pmod(F.xxhash64(by, "chunk"), F.lit(shards)).cast("int")
    sharded = lambda rows: rows.withColumn("shard", shard).groupBy("shard")
    own = [StructField("lag", ties.schema[time].dataType), StructField("n_tied", ties.schema["n_tied"].dataType), *[StructField(c, ties.schema[c].dataType) for c in carried]]
    out = StructType([*left.schema.fields, *own])
    met = sharded(left.where(ok).withColumn("chunk", chunk)).cogroup(sharded(ties.withColumn("chunk", chunk).unionByName(halo))).applyInArrow(_in_shard(names, carried, by, time, tolerance, out), out)
    none = [(F.lit(0) if f.name == "n_tied" else F.lit(None)).cast(f.dataType).alias(f.name) for f in own]
    return met.unionByName(left.where(~ok).select(*names, *none))


#: The contract's numbers.
TOLERANCE = 240 * HOUR


def _used(key: Column, at: Column) -> Column:
    """Times of keys with an odd hash count from the full hour."""
    t = micros(at)
    return F.when(F.crc32(key.cast("string")) % 2 == 1, floored(t, HOUR)).otherwise(t)


def clicks_once(clicks: DataFrame) -> DataFrame:
    """``(click_id, client_id, ts_us)``, a row for each click_id: copies count once, as the row with the smallest time, then client, nulls last; null ids are one click."""
    t, c = _used(F.col("click_id"), F.col("ts")), F.col("client_id")
    one = F.min(F.struct(t.isNull(), t.alias("ts_us"), c.isNull(), c.alias("client_id"))).alias("x")
    return clicks.groupBy("click_id").agg(one).select("click_id", "x.client_id", "x.ts_us")


def orders_twice(sales: DataFrame) -> DataFrame:
    """``(client_id, ts_us, sale_id, priority, total_cents)``: each sale, and its mirror where its hash is not divisible by 3 (a null id has none). Totals that are not finite, or of 10^16 and more, have null cents."""
    h = F.crc32(F.col("sale_id").cast("string"))
    cents = F.when(F.abs("total") < 1e16, F.floor(F.col("total") * 100 + 0.5)).cast("long")
    one = sales.select("client_id", _used(F.col("sale_id"), F.col("sold_at")).alias("ts_us"), "sale_id", F.col("priority").cast("long").alias("priority"), cents.alias("total_cents"), (h % 3 != 0).alias("twice"))
    same = F.struct("sale_id", "priority")
    other = F.struct(F.bitwise_not("sale_id").alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    each = F.explode(F.when(F.col("twice"), F.array(same, other)).otherwise(F.array(same))).alias("x")
    return one.select("client_id", "ts_us", "total_cents", each).select("client_id", "ts_us", "x.sale_id", "x.priority", "total_cents")


def op13_asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = staged(clicks_once(table(spark, sf_dir, "clicks")), "clicks")
    orders = orders_twice(table(spark, sf_dir, "sales"))
    # null priorities and null ids lose
    first = [F.col("priority").isNull().alias("p0"), F.col("priority").alias("p1"), F.col("sale_id").isNull().alias("s0"), F.bitwise_not("sale_id").alias("s1")]
    out = asof_join(clicks, orders, "client_id", "ts_us", first, ["sale_id", "total_cents"], TOLERANCE)
    return out.select("click_id", "client_id", "ts_us", "sale_id", F.col("lag").alias("lag_us"), "total_cents", "n_tied")


_CRC = """list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))"""
_US = "CASE WHEN ({h}) % 2 = 0 THEN epoch_us({t}) // 3600000000 * 3600000000 ELSE epoch_us({t}) END"
# the last inversion of the crc is left out: it turns odd into even, and x into 4294967295 - x, which is divisible by 3 when x is
OP13_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, n)) AS t),
c AS (SELECT DISTINCT click_id, client_id, {_US.format(h=_CRC.format("click_id"), t="ts")} AS ts_us FROM clicks, crc),
s AS (SELECT client_id, {_US.format(h=_CRC.format("sale_id"), t="sold_at")} AS at_us, sale_id, priority, CAST(floor(100 * total + 0.5) AS BIGINT) AS total_cents,
  ({_CRC.format("sale_id")}) % 3 <> 0 AS twice FROM sales, crc),
o AS (SELECT client_id, at_us, sale_id, priority, total_cents FROM s UNION ALL SELECT client_id, at_us, -1 - sale_id, 6 - priority, total_cents FROM s WHERE twice),
r AS (SELECT client_id, at_us, sale_id, total_cents, COUNT(*) OVER (PARTITION BY client_id, at_us) AS n_tied FROM o WHERE client_id IS NOT NULL AND at_us IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, at_us ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST) = 1)
SELECT c.click_id, c.client_id, c.ts_us, CASE WHEN near THEN sale_id END AS sale_id, CASE WHEN near THEN ts_us - at_us END AS lag_us,
  CASE WHEN near THEN total_cents END AS total_cents, CASE WHEN near THEN n_tied ELSE 0 END AS n_tied
FROM (SELECT c.*, r.at_us, r.sale_id, r.total_cents, r.n_tied, r.at_us >= c.ts_us - {TOLERANCE} AS near FROM c ASOF LEFT JOIN r ON c.client_id = r.client_id AND c.ts_us >= r.at_us) c
"""
