"""Shared roll-ups: daily counts and the distinct (person, day, name) table many reports start from."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.model import day_num
from eventloom.operators.scope import drop_sampler


def daily(df: DataFrame) -> DataFrame:
    return drop_sampler(df).groupBy(day_num().alias("day"), "name").agg(F.count("*").alias("n"))


def user_day(df: DataFrame) -> DataFrame:
    """(distinct_id, day, name, n, first_us, last_us): write it once, read it from every daily report."""
    return drop_sampler(df).groupBy("distinct_id", day_num().alias("day"), "name").agg(
        F.count("*").alias("n"), F.min(F.unix_micros("timestamp")).alias("first_us"),
        F.max(F.unix_micros("timestamp")).alias("last_us"))


def is_user_day(df: DataFrame) -> bool:
    """A user_day table may stand in for the events wherever only days, people and names matter."""
    return "timestamp" not in df.columns and {"distinct_id", "day", "name", "n"} <= set(df.columns)


def user_days(df: DataFrame, event: str = "") -> DataFrame:
    """Distinct (distinct_id, day) of events or of a user_day table; bounded per person by the calendar."""
    d = drop_sampler(df, event)
    if event:
        d = d.where(F.col("name") == event)
    return d.select("distinct_id", F.col("day") if is_user_day(df) else day_num().alias("day")).distinct()


def name_days(df: DataFrame) -> DataFrame:
    """(name, day, c) of events or of a user_day table."""
    if is_user_day(df):
        return df.groupBy("name", "day").agg(F.sum("n").alias("c"))
    return df.groupBy("name", day_num().alias("day")).agg(F.count("*").alias("c"))
