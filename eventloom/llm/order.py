"""Order without a single task: binary search as a Column, and positions in a global sort."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventloom.session import materialize

LOW33 = (1 << 33) - 1


def _literal(p) -> Column:
    return F.struct(*(F.lit(x).cast("long").alias(f"k{i}") for i, x in enumerate(p))) if isinstance(p, tuple) else F.lit(p).cast("long")


def upper_bound(points: list, *key: Column) -> Column:
    """How many of the sorted ``points`` (longs, or tuples of longs for several keys) are at most the key: a binary search."""
    n = len(points)
    if not n:
        return F.lit(0)
    found = F.array(*map(_literal, points))
    x = key[0].cast("long") if len(key) == 1 else F.struct(*(k.cast("long").alias(f"k{i}") for i, k in enumerate(key)))

    def step(at: Column, size: Column) -> Column:
        to = at + size
        return F.when((to <= n) & (F.get(found, F.least(to, F.lit(n)) - 1) <= x), to).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << b) for b in reversed(range(n.bit_length())))), F.lit(0), step)


def positions(df: DataFrame, *keys: Column) -> DataFrame:
    """The rows in a global order: ``_part`` and ``_pos``, the place within it. Written once, so later reads agree."""
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return materialize(s.select("*", F.shiftrightunsigned("_at", 33).alias("_part"), F.col("_at").bitwiseAND(LOW33).alias("_pos")).drop("_at"))


def numbered(placed: DataFrame, name: str, *within: str) -> DataFrame:
    """Gapless numbers from 0 over ``positions``, restarted for each value of ``within`` (leading sort keys).

    The offsets have a row per partition and value that meets it: as few as partitions plus values.
    """
    own = placed.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_from"))
    w = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = own.select(*within, "_part", (F.sum("_n").over(w) - F.col("_n") - F.col("_from")).alias("_shift"))
    both = [*within, "_part"]
    o = offsets.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(both)), "_shift")
    on = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(both)]
    return placed.join(F.broadcast(o), on).withColumn(name, F.col("_pos") + F.col("_shift")).drop("_shift", "_part", "_pos", *(f"_o{i}" for i in range(len(both))))
