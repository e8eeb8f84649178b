"""Catalogue, usage totals, recent events and one person's timeline."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.model import between, lit_ts
from eventloom.operators.filters import property_keys
from eventloom.operators.scope import drop_sampler


def scan_range(df: DataFrame, start, end) -> DataFrame:
    """Everything in [start, end); day partitions and row groups outside are never read."""
    return between(df, start, end)


def event_names(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.count("*").alias("events"))


def usage(df: DataFrame, asof: str) -> DataFrame:
    d = drop_sampler(df)
    t = F.col("timestamp")
    return d.agg(F.count("*").alias("events"), F.count(F.when(t >= lit_ts(asof) - F.expr("interval 30 days"), 1)).alias("events_30d"),
                 F.count(F.when(t >= F.date_trunc("month", lit_ts(asof)), 1)).alias("events_month"), F.count_distinct("distinct_id").alias("users"))


def recent(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), "id").limit(limit)


def user_counts(df: DataFrame, distinct_id: str) -> DataFrame:
    return df.where(F.col("distinct_id") == distinct_id).groupBy("name").agg(
        F.count("*").alias("events"), F.unix_micros(F.max("timestamp")).alias("last_us"))


def user_properties(df: DataFrame, distinct_id: str) -> DataFrame:
    """The newest value of each property of one person."""
    kv = property_keys(df.where(F.col("distinct_id") == distinct_id), keep=("timestamp", "id"))
    return kv.groupBy("key").agg(F.max(F.struct("timestamp", "id", "value"))["value"].alias("value"))
