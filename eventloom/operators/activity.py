"""Days of activity as bits: a 60-bit word per person and 60 periods, united by OR and read by shifts.

A table of distinct (person, day) has a row for each day on which a person came; a table of words has one for every 60 days, and
a day that comes late is one more bit. Words are plain longs, so they aggregate in place, before the exchange and after it
(``bitmap_construct_agg`` keeps 4 KB per person, whoever came once). 60 of the 64 bits are used, so no word is negative.

``words`` is the roll-up; ``store`` keeps it by person, and reports over a stored table need no exchange by person. Reports equal
those of ``trends``, ``engagement`` and ``retention`` over events. They know whole days only, so bounds must be midnights.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import day_num
from eventloom.operators import retention
from eventloom.operators.engagement import day_text
from eventloom.operators.rollups import is_user_day
from eventloom.operators.scope import drop_sampler

SIZE = 60
FULL = (1 << SIZE) - 1
_DAYS = {"day": 1, "week": 7, "month": 30}       # fixed values: days of a retention period


def _left(bits: Column, n) -> Column:
    """Bits moved up by ``n`` places; those beyond the word are lost."""
    return F.call_function("shiftleft", bits, n if isinstance(n, Column) else F.lit(n)).bitwiseAND(F.lit(FULL))


def _right(bits: Column, n) -> Column:
    return F.call_function("shiftright", bits, n if isinstance(n, Column) else F.lit(n))


def _bit(period: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(period, F.lit(SIZE)).cast("int"))


def _lowest(bits: Column) -> Column:
    """The place of the lowest bit of a word that has one."""
    return F.bit_count((bits - 1).bitwiseAND(F.bitwise_not(bits)))


def _highest(bits: Column) -> Column:
    return F.length(F.bin(bits)) - 1


def words(df: DataFrame, event: str = "", days: int = 1) -> DataFrame:
    """(distinct_id, word, bits) of events or of a ``user_day`` table: bit i of a word is period 60 * word + i since the epoch,
    of ``days`` days each."""
    d = drop_sampler(df, event)
    if event:
        d = d.where(F.col("name") == event)
    period = F.floor((F.col("day") if is_user_day(df) else day_num()) / days)
    return merge(d.select("distinct_id", F.floor(period / SIZE).alias("word"), _bit(period).alias("bits")))


def merge(*tables: DataFrame) -> DataFrame:
    """Words of separate batches as one table; the same rows twice change nothing."""
    all_ = tables[0]
    for t in tables[1:]:
        all_ = all_.unionByName(t)
    return all_.groupBy("distinct_id", "word").agg(F.bit_or("bits").alias("bits"))


def store(table: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """``table`` under ``path``, bucketed by person and known to the catalog as ``name``; a person has few rows, so buckets are even."""
    spark = table.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (table.repartition(buckets, "distinct_id").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "distinct_id").sortBy("distinct_id", "word").saveAsTable(name))
    return spark.table(name)


def by_period(table: DataFrame, days: int) -> DataFrame:
    """Words of days as words of periods of ``days`` days."""
    if days == 1:
        return table
    some = F.filter(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: _right(F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    periods = F.array_distinct(F.transform(some, lambda i: F.floor((F.col("word") * SIZE + i) / days)))
    t = table.select("distinct_id", F.explode(periods).alias("period"))
    return merge(t.select("distinct_id", F.floor(F.col("period") / SIZE).alias("word"), _bit(F.col("period")).alias("bits")))


def per_bit(rows: DataFrame, bits: str, *by: str) -> DataFrame:
    """(*by, at, n): how many rows have each bit; tasks send one row per group."""
    sums = [F.sum(_right(F.col(bits), i).bitwiseAND(F.lit(1))) for i in range(SIZE)]
    return rows.groupBy(*by).agg(F.array(*sums).alias("_c")).select(*by, F.posexplode("_c").alias("at", "n"))


def _midnight(t) -> int:
    at = dt.datetime.fromisoformat(str(t))
    if (at.hour, at.minute, at.second, at.microsecond) != (0, 0, 0, 0):
        raise ValueError(f"words know whole days only: {t}")
    return (at.date() - dt.date(1970, 1, 1)).days


def rolling(table: DataFrame, days: int, start, end) -> DataFrame:
    """(bucket, n): distinct people in the trailing ``days`` days (1 to 60), per day of [start, end)."""
    if not 1 <= days <= SIZE:
        raise ValueError(f"1 to {SIZE} days: {days}")
    lo, hi = _midnight(start), _midnight(end) - 1
    t = table.where((F.col("word") >= (lo - (days - 1)) // SIZE) & (F.col("word") <= hi // SIZE))
    # each bit reaches the days after it, by doubling; what leaves the word goes to the next one
    t = t.select("distinct_id", "word", F.col("bits").alias("a"), F.lit(0).cast("long").alias("b"))
    have = 1
    while have < days:
        step = min(have, days - have)
        t = t.withColumns({"a": F.col("a").bitwiseOR(_left(F.col("a"), step)),
                           "b": F.col("b").bitwiseOR(_left(F.col("b"), step)).bitwiseOR(_right(F.col("a"), SIZE - step))})
        have += step
    pieces = F.filter(F.array(F.struct("word", F.col("a").alias("bits")), F.struct((F.col("word") + 1).alias("word"), F.col("b").alias("bits"))), lambda x: x["bits"] != 0)
    reached = merge(t.select("distinct_id", F.explode(pieces).alias("x")).select("distinct_id", "x.*"))
    n = per_bit(reached, "bits", "word").select((F.col("word") * SIZE + F.col("at")).alias("day"), "n")
    out = table.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "day").join(n, "day", "left")
    return out.select(day_text(F.col("day")).alias("bucket"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def lifecycle(table: DataFrame, days: int = 30) -> DataFrame:
    """Per day up to the last: new, returning, resurrected and dormant people."""
    bits, top = F.col("bits"), _right(F.col("bits"), SIZE - 1)
    # a word's last day is the day before the next word's first, also where the person has no next word
    carried = F.array(F.struct("word", bits.alias("bits"), F.lit(0).cast("long").alias("carry")),
                      F.when(top == 1, F.struct((F.col("word") + 1).alias("word"), F.lit(0).cast("long").alias("bits"), top.alias("carry"))))
    t = table.select("distinct_id", F.explode(F.filter(carried, lambda x: x.isNotNull())).alias("x")).select("distinct_id", "x.*")
    t = t.groupBy("distinct_id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("carry").alias("carry"))
    first = F.min("word").over(W.partitionBy("distinct_id"))
    t = t.select("word", bits, _left(bits, 1).bitwiseOR(F.col("carry")).alias("before"),
                 F.when(F.col("word") == first, bits.bitwiseAND(-bits)).otherwise(0).alias("new"))
    none = F.bitwise_not(F.col("before"))
    kinds = {"new": F.col("new"), "returning": bits.bitwiseAND(F.col("before")), "resurrected": bits.bitwiseAND(none).bitwiseAND(F.bitwise_not(F.col("new"))),
             "dormant": F.col("before").bitwiseAND(F.bitwise_not(bits))}
    cells = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("bits")) for k, c in kinds.items()]), lambda x: x["bits"] != 0)
    n = per_bit(t.select("word", F.explode(cells).alias("x")).select("word", "x.*"), "bits", "kind", "word")
    n = n.groupBy((F.col("word") * SIZE + F.col("at")).alias("day")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in kinds])
    last = table.agg(F.max(F.col("word") * SIZE + _highest(bits)).alias("hi"))
    calendar = last.select(F.explode(F.sequence(F.col("hi") - (days - 1), F.col("hi"))).alias("day"))
    return calendar.join(n, "day", "left").select(day_text(F.col("day")).alias("bucket"), *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in kinds])


def stickiness(table: DataFrame, asof: str) -> DataFrame:
    """Distinct people in the trailing 1, 7 and 30 days and DAU/MAU."""
    day = _midnight(asof)
    last = table.where(F.col("word") >= (day - 30) // SIZE).groupBy("distinct_id").agg(F.max(F.col("word") * SIZE + _highest(F.col("bits"))).alias("last"))
    n = lambda k: F.count(F.when(F.col("last") >= day - k, 1))
    return last.agg(n(1).alias("dau"), n(7).alias("wau"), n(30).alias("mau")).withColumn("dau_over_mau", v.ratio(F.col("dau"), F.col("mau")))


def grid(table: DataFrame, max_periods: int, bucket: str = "day", rolling: bool = False) -> DataFrame:
    """``retention.grid`` from words of days."""
    t = by_period(table, _DAYS[bucket])
    lowest = F.col("word") * SIZE + _lowest(F.col("bits"))
    if rolling:
        u = t.groupBy("distinct_id").agg(F.min(lowest).alias("first"), F.max(F.col("word") * SIZE + _highest(F.col("bits"))).alias("last"))
        return retention.zero_filled(retention.rolling_hits(u, max_periods).groupBy("first", "n").agg(F.count("*").alias("c")), max_periods, bucket)
    u = t.withColumn("first", F.min(lowest).over(W.partitionBy("distinct_id")))
    # a person's periods counted from the first one: each word falls into two of these, whose bits never meet
    u = u.select("first", "bits", (F.col("word") * SIZE - F.col("first")).alias("from"))
    q, r = F.floor(F.col("from") / SIZE), F.pmod("from", F.lit(SIZE)).cast("int")
    low, high = _left(F.col("bits"), r), F.when(r > 0, _right(F.col("bits"), SIZE - r)).otherwise(0)
    pieces = F.filter(F.array(F.struct(q.alias("q"), low.alias("bits")), F.struct((q + 1).alias("q"), high.alias("bits"))), lambda x: (x["bits"] != 0) & (x["q"] <= max_periods // SIZE))
    n = per_bit(u.select("first", F.explode(pieces).alias("x")).select("first", "x.*"), "bits", "first", "q")
    cells = n.select("first", (F.col("q") * SIZE + F.col("at")).alias("n"), F.col("n").alias("c")).where((F.col("n") <= max_periods) & (F.col("c") > 0))
    return retention.zero_filled(cells, max_periods, bucket)


def open_store(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    """A stored table; a session whose catalog doesn't know ``name`` gets it declared over the files."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} (distinct_id STRING, word BIGINT, bits BIGINT) USING parquet CLUSTERED BY (distinct_id) SORTED BY (distinct_id, word) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
