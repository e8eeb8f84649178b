"""Distinct people from mergeable sketches: one HyperLogLog sketch per day and event, united over any window.

Exact distinct counts need every person of a window again for every window. A sketch has a fixed size, so a report reads days x
events sketches instead, however many people there are, and sketches of late or separate batches unite with those at hand.
An estimate's standard error is 1.04 / sqrt(2 ** lg_k); ``bound`` is three of them. Sets of a few hundred people are kept as
such and come out exact. People without an id are not counted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.model import day_num, lit_ts
from eventloom.operators.scope import drop_sampler

LG_K = 14


def bound(lg_k: int = LG_K, errors: float = 3.0) -> float:
    """The relative error that an estimate exceeds with a probability below 0.3 %."""
    return errors * 1.04 / 2 ** (lg_k / 2)


def within(estimate: Column, exact: Column, lg_k: int = LG_K) -> Column:
    """Whether an estimate is as near as ``bound`` says; estimates are whole numbers."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(0.5), exact * F.lit(bound(lg_k)))


def daily(df: DataFrame, lg_k: int = LG_K, event: str = "") -> DataFrame:
    """(day, name, n, people): ``people`` is a sketch; tasks sketch their own rows, so a row per task, day and event is exchanged."""
    return drop_sampler(df, event).groupBy(day_num().alias("day"), "name").agg(F.count("*").alias("n"), F.hll_sketch_agg("distinct_id", lg_k).alias("people"))


def merge(*tables: DataFrame) -> DataFrame:
    """Sketch tables of separate batches as one; the same rows twice change ``n`` but not ``people``."""
    all_ = tables[0]
    for t in tables[1:]:
        all_ = all_.unionByName(t)
    return all_.groupBy("day", "name").agg(F.sum("n").alias("n"), F.hll_union_agg("people").alias("people"))


def estimate(sketches: DataFrame, *by: str) -> DataFrame:
    """(*by, n, people): events and estimated distinct people of each group of days and events."""
    g = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("people").alias("_s"))
    return g.select(*by, "n", F.hll_sketch_estimate("_s").alias("people"))


def window(sketches: DataFrame, start: str, end: str) -> DataFrame:
    """The sketches of the days in [start, end)."""
    day = lambda t: F.unix_date(F.to_date(lit_ts(t)))
    return sketches.where((F.col("day") >= day(start)) & (F.col("day") < day(end)))


def rolling(sketches: DataFrame, days: int, start: str, end: str) -> DataFrame:
    """(day, people) for each day of [start, end): estimated people active in the ``days`` days up to it; 0 where nobody was.

    Each sketch goes to the days it counts for: days x events x ``days`` small rows, none per person.
    """
    day = lambda t: F.unix_date(F.to_date(lit_ts(t)))
    spark = sketches.sparkSession
    united = sketches.groupBy("day").agg(F.hll_union_agg("people").alias("people"))
    moved = united.select(F.explode(F.sequence(F.col("day"), F.col("day") + (days - 1))).alias("day"), "people").groupBy("day").agg(F.hll_union_agg("people").alias("_s"))
    calendar = spark.range(1).select(F.explode(F.sequence(day(start), day(end) - 1)).alias("_day")).select(F.col("_day").cast("bigint"))
    j = calendar.join(moved, F.col("_day") == F.col("day"), "left")
    return j.select(F.col("_day").alias("day"), F.coalesce(F.hll_sketch_estimate("_s"), F.lit(0).cast("bigint")).alias("people"))
