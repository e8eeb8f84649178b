"""Ordered per-key work that survives hot keys.

A window partitioned by person puts every row of one person into one task.  Here a key with more
rows than a block may hold is cut into runs of its rows in time ("blocks"), windows run per (key,
block), and what a block needs from its neighbours travels through a table with one row per block of
a hot key.  Blocks are cut by row counts, from a histogram per hour, refined per second and per
microsecond where a cell alone is too large, so a burst is cut as well.  A block is a function of
the timestamp: equal timestamps never straddle a boundary and the block order is the time order.
Only rows of one key within one microsecond cannot be parted.

A block holds ``rows_per_block`` rows at most, or one part in ``MAX_BLOCKS`` of all rows if that is
more, so the hot keys and their blocks are at most a few hundred thousand rows at any table size,
which is the bound that lets both be broadcast.  The rows per key are counted first; where no key
has more than a block holds, there is nothing to cut, and every key is its own block.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.model import attach_row
from eventloom.session import materialize

ROWS_PER_BLOCK = 1_000_000
MAX_BLOCKS = 100_000
CELLS = (3_600_000_000, 1_000_000, 1)      # microseconds of an hour, a second and an instant


def _starts(hot_rows: DataFrame) -> DataFrame:
    """(_hk, _at): where the blocks of the hot keys begin; ``hot_rows`` has _hk, _us, _half."""
    found, rows, outer = None, hot_rows, ["_hk"]
    for level, width in enumerate(CELLS):
        cell = f"_cell{level}"
        rows = rows.withColumn(cell, F.floor(F.col("_us") / width))
        c = rows.groupBy(*outer, "_half", cell).agg(F.count("*").alias("_n"), F.min("_us").alias("_at"))
        w = W.partitionBy(*outer).orderBy(cell)
        before = F.floor((F.sum("_n").over(w) - F.col("_n")) / F.col("_half"))
        c = c.withColumn("_part", before)
        c = c.withColumn("_new", (F.col("_part") != F.lag("_part", 1, -1).over(w)) | (F.col("_n") > F.col("_half")))
        own = c.where("_new").select("_hk", "_at")
        found = own if found is None else found.unionByName(own)
        outer = ["_hk", cell]
        rows = rows.join(c.where("_n > _half").select("_hk", cell), outer, "left_semi")
    return found


def _block(starts: Column, us: Column) -> Column:
    """The last start at or before ``us``, by bisection of the sorted array."""
    n = F.size(starts)
    step = lambda at, size: F.when((at + size <= n) & (F.get(starts, F.least(at + size, n) - 1) <= us), at + size).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(20))]), F.lit(0), step)


def with_blocks(df: DataFrame, key: str = "distinct_id", ts: str = "timestamp", rows_per_block: int | None = None) -> DataFrame:
    """Adds ``_us`` (epoch micros), ``_hot`` and ``_blk``, the number of the block within its key."""
    df = df.withColumn("_us", F.unix_micros(ts))
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    limit = F.greatest(F.lit(rows_per_block or ROWS_PER_BLOCK), F.ceil(F.col("_all") / MAX_BLOCKS))
    hot = materialize(attach_row(counts, df.agg(F.count("*").alias("_all"))).where(F.col("_n") > limit).select(F.col(key).alias("_hk"), F.greatest(F.lit(1), F.floor(limit / 2)).alias("_half")))
    if hot.isEmpty():       # by exact counts no key has more rows than a block holds
        return df.withColumns({"_hot": F.lit(False), "_blk": F.lit(0).cast("bigint")})
    starts = _starts(df.select(key, "_us").join(F.broadcast(hot), F.col(key) == F.col("_hk")).select("_hk", "_us", "_half"))
    starts = starts.groupBy("_hk").agg(F.sort_array(F.collect_set("_at")).alias("_starts"))
    j = df.join(F.broadcast(starts), F.col(key) == F.col("_hk"), "left")
    return (j.withColumn("_hot", F.col("_hk").isNotNull())
            .withColumn("_blk", F.when(F.col("_hot"), _block(F.col("_starts"), F.col("_us"))).otherwise(0).cast("bigint"))
            .drop("_hk", "_starts"))


def block_window(key: str = "distinct_id", *order: str):
    return W.partitionBy(key, "_blk", "_hot").orderBy(*order)


def following(key: str = "distinct_id", *order: str):
    """The rows after the current one, nearest last.

    Read with F.last(x, ignorenulls=True).  The sort is descending so the frame only ever grows:
    a frame that ends at UNBOUNDED FOLLOWING is recomputed for every row and costs n² per person.
    """
    return W.partitionBy(key, "_blk", "_hot").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)


def later_blocks(key: str = "distinct_id"):
    """The blocks after the current one, nearest last; read with F.last(x, ignorenulls=True)."""
    return W.partitionBy(key).orderBy(F.desc("_blk")).rowsBetween(W.unboundedPreceding, -1)


def earlier_blocks(key: str = "distinct_id"):
    return W.partitionBy(key).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)


def block_summary(df: DataFrame, *aggs: Column, key: str = "distinct_id") -> DataFrame:
    """One row per block of the hot keys (the filter reaches below the windows)."""
    return df.where("_hot").groupBy(key, "_blk").agg(*aggs)


def attach(df: DataFrame, carry: DataFrame, key: str = "distinct_id") -> DataFrame:
    """Bring the neighbours' values onto the rows of each block; bounded, so broadcast."""
    return df.join(F.broadcast(carry), [key, "_blk"], "left")


def previous_value(df: DataFrame, value: str, out: str, order: list[str], key: str = "distinct_id") -> DataFrame:
    """lag(value, 1) in ``order`` over the whole key; ``df`` comes from with_blocks()."""
    w = block_window(key, *order)
    d = df.withColumn(out, F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    pos = F.struct(*order, F.col(value).alias("_v"))
    tails = block_summary(df, F.max(pos).alias("_last"), key=key)
    carry = tails.select(key, "_blk", F.lag("_last._v").over(W.partitionBy(key).orderBy("_blk")).alias("_carry"))
    d = attach(d, carry, key)
    return d.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out))).drop("_first", "_carry")


def last_value_so_far(df: DataFrame, value: Column, out: str, order: list[str], key: str = "distinct_id") -> DataFrame:
    """Latest non-null ``value`` at or before each row, over the whole key."""
    w = block_window(key, *order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_v", value)
    tails = block_summary(d, F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, "_v"))).alias("_last"), key=key)
    carry = tails.select(key, "_blk", F.last("_last._v", True).over(earlier_blocks(key)).alias("_carry"))
    d = attach(d.withColumn(out, F.last("_v", True).over(w)), carry, key)
    return d.withColumn(out, F.coalesce(out, "_carry")).drop("_carry", "_v")
