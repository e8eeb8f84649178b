"""What people do, or which page they open, after a starting point."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import scan, values as v
from eventloom.model import attach_row
from eventloom.operators.scope import drop_sampler


def _starts(df: DataFrame, is_start) -> DataFrame:
    return df.where(is_start).groupBy("distinct_id").agg(F.min(F.struct("timestamp", "id")).alias("_start"))


def _from_start(df: DataFrame, starts: DataFrame, inclusive: bool) -> DataFrame:
    at = F.struct("timestamp", "id")
    j = df.join(starts, "distinct_id")
    return j.where(at >= F.col("_start") if inclusive else at > F.col("_start"))


def _levels(steps: DataFrame, starters: DataFrame, depth: int) -> DataFrame:
    # row_number with a bound: Spark limits per map task before the shuffle, so hot people stay small
    rn = F.row_number().over(W.partitionBy("distinct_id").orderBy("timestamp", "id"))
    top = steps.withColumn("depth", rn.cast("bigint")).where(F.col("depth") <= depth)
    n = starters.agg(F.count("*").alias("start_users"))
    return attach_row(top.groupBy("depth", "step").agg(F.count("*").alias("users")), n)


def after(df: DataFrame, start: str, depth: int = 3) -> DataFrame:
    d = drop_sampler(df).select("distinct_id", "timestamp", "id", "name")
    starts = _starts(d, F.col("name") == start)
    steps = _from_start(d, starts, inclusive=False).withColumnRenamed("name", "step")
    return _levels(steps, starts, depth)


def pages(df: DataFrame, start_path: str, depth: int = 3, block_rows: int | None = None) -> DataFrame:
    """Page-to-page flow; consecutive repeats of a page collapse into one."""
    p = F.coalesce(v.text(df, "path"), F.lit(""))
    d = (df.where((F.col("name") == "$pageview") & (p != ""))
         .select("distinct_id", "timestamp", "id", p.alias("step")))
    starts = _starts(d, F.col("step") == start_path)
    rows = _from_start(d, starts, inclusive=True)
    rows = scan.with_blocks(rows.drop("_start"), rows_per_block=block_rows)
    rows = scan.previous_value(rows, "step", "_prev", ["_us", "id"])
    moved = rows.where("_prev is not null and step <> _prev")
    return _levels(moved, starts, depth)
