"""Deploys joined to events and daily series by time."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def around(rows: DataFrame, deploys: DataFrame, window_days: int) -> DataFrame:
    """Rows within ±window of each deploy(deploy, at), with ``after``.

    Each deploy is listed once per day it touches, so the match is an equi-join on the day.
    """
    span = F.expr(f"interval {window_days} days")
    days = deploys.select("deploy", "at", F.explode(F.sequence(F.to_date(F.col("at") - span), F.to_date(F.col("at") + span))).alias("_day"))
    j = rows.withColumn("_day", F.to_date("timestamp")).join(days, "_day")
    return (j.where((F.col("timestamp") >= F.col("at") - span) & (F.col("timestamp") < F.col("at") + span))
            .withColumn("after", F.col("timestamp") >= F.col("at")).drop("_day"))
