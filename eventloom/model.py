"""The canonical event table.

Every operator takes a DataFrame with the four fixed columns below.  Properties live either in
``properties`` (VARIANT) or, for hot keys, in a promoted typed column of the same name; a NULL in a
promoted column means the key is missing.  Operators ask for a property by name and do not care
where it is stored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FIXED = ("id", "name", "distinct_id", "timestamp")

EVENT_DDL = "id string, name string, distinct_id string, timestamp timestamp, properties variant"


def day(ts: str | Column = "timestamp") -> Column:
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def day_str(ts: str | Column = "timestamp") -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd")


def day_num(ts: str | Column = "timestamp") -> Column:
    """Days since the Unix epoch (UTC)."""
    return F.unix_date(day(ts)).cast("bigint")


def lit_ts(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def between(df: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Rows in the half-open window [start, end); both sides reach the scan as pushed filters."""
    if start is not None:
        df = df.where(F.col(ts) >= lit_ts(str(start)))
    if end is not None:
        df = df.where(F.col(ts) < lit_ts(str(end)))
    return df


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame to every row, as a scalar subquery."""
    s = one.select(F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias("_s")).scalar()
    return df.withColumn("_s", s).select("*", "_s.*").drop("_s")
