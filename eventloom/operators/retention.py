"""Cohort retention on epoch-aligned day, 7-day and 30-day periods."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.operators.rollups import is_user_day
from eventloom.operators.scope import drop_sampler

# fixed values: period lengths in seconds, and the summary periods per bucket
BUCKET_SECONDS = {"day": 86400, "week": 7 * 86400, "month": 30 * 86400}
SUMMARY_PERIODS = {"day": (1, 7, 30), "week": (1, 2, 4), "month": (1, 2, 3)}


def activity(df: DataFrame, event: str = "", bucket: str = "day") -> DataFrame:
    """Distinct (distinct_id, period); at most one row per person and period from here on."""
    d = drop_sampler(df)
    if event:
        d = d.where(F.col("name") == event)
    secs = F.col("day") * 86400 if is_user_day(df) else F.unix_seconds("timestamp")     # every period is whole days
    p = F.floor(secs / BUCKET_SECONDS[bucket]).alias("period")
    return d.select("distinct_id", p).distinct()


def rolling_hits(u: DataFrame, max_periods: int) -> DataFrame:
    """(first, n) for every period up to a person's last one."""
    return u.select("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("last") - F.col("first"), F.lit(max_periods)))).alias("n"))


def grid(df: DataFrame, max_periods: int, event: str = "", bucket: str = "day", rolling: bool = False) -> DataFrame:
    """(cohort, cohort_num, n, returned, size), zero-filled for n = 0..max_periods."""
    act = activity(df, event, bucket)
    if rolling:
        u = act.groupBy("distinct_id").agg(F.min("period").alias("first"), F.max("period").alias("last"))
        hits = rolling_hits(u, max_periods)
    else:
        u = act.withColumn("first", F.min("period").over(W.partitionBy("distinct_id")))
        hits = u.select("first", (F.col("period") - F.col("first")).alias("n")).where(F.col("n") <= max_periods)
    return zero_filled(hits.groupBy("first", "n").agg(F.count("*").alias("c")), max_periods, bucket)


def zero_filled(cells: DataFrame, max_periods: int, bucket: str) -> DataFrame:
    """(cohort, cohort_num, n, returned, size) of (first, n, c), with 0 where there is no cell."""
    by_cohort = cells.groupBy("first").agg(
        F.map_from_entries(F.collect_list(F.struct("n", "c"))).alias("m"))   # ≤ max_periods+1 entries
    out = by_cohort.select("first", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max_periods).cast("bigint"))).alias("n"))
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.date_format(F.timestamp_seconds(F.col("first") * BUCKET_SECONDS[bucket]), "yyyy-MM-dd").alias("cohort"),
        F.col("first").alias("cohort_num"), "n",
        F.coalesce(F.element_at("m", F.col("n")), zero).alias("returned"),
        F.coalesce(F.element_at("m", zero), zero).alias("size"))


def observable(g: DataFrame, asof: str, bucket: str = "day") -> DataFrame:
    """NULL instead of a count for periods not fully elapsed at ``asof``."""
    cur = F.floor(F.unix_seconds(F.lit(asof).cast("timestamp")) / BUCKET_SECONDS[bucket])
    ok = (F.col("n") <= 0) | (F.col("cohort_num") + F.col("n") < cur)
    return g.withColumn("returned", F.when(ok, F.col("returned").cast("double")))


def summary(df: DataFrame, asof: str, max_periods: int = 30, event: str = "", bucket: str = "day",
            rolling: bool = False) -> DataFrame:
    """Headline percentages over fully elapsed cohorts only; unobservable periods are left out."""
    g = observable(grid(df, max_periods, event, bucket, rolling), asof, bucket)
    s = (g.where(F.col("n").isin(*SUMMARY_PERIODS[bucket]) & F.col("returned").isNotNull())
         .groupBy("n").agg(F.sum("size").alias("cohort_users"), F.sum("returned").cast("bigint").alias("retained")))
    return s.where("cohort_users > 0").select("n", "retained", "cohort_users",
                                              v.pct(F.col("retained"), F.col("cohort_users")).alias("pct"))
