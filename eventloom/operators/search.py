"""Search-console reports over (query, page, position, impressions, clicks) rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def movers(rows: DataFrame, previous: DataFrame, limit: int = 5) -> DataFrame:
    """Queries whose clicks moved most against the previous snapshot."""
    p = previous.select("query", F.col("clicks").alias("_prev"))
    d = rows.join(p, "query", "left").withColumn("delta", F.col("clicks") - F.coalesce("_prev", F.lit(0))).where("delta <> 0")
    return d.orderBy(F.desc(F.abs("delta")), "query").select("query", "clicks", "delta").limit(limit)


def quick_wins(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Positions 4 to 15, most impressions first."""
    return (rows.where("position between 4 and 15").orderBy(F.desc("impressions"), "page", "query")
            .select("page", "query", F.round("position", 6).alias("position"), "impressions", "clicks").limit(limit))


def typical_ctr(position: Column) -> Column:
    """Typical click-through percent by position band."""
    return F.when(position <= 3, 8.0).when(position <= 6, 4.0).when(position <= 10, 2.0).otherwise(1.0)


def ctr_problems(rows: DataFrame, limit: int = 10) -> DataFrame:
    """At least 100 impressions and less than half the typical click-through for the position."""
    ctr = F.col("clicks") / F.col("impressions") * 100
    d = rows.where("impressions >= 100").withColumn("expected_ctr_pct", typical_ctr(F.col("position")))
    d = d.where(ctr < F.col("expected_ctr_pct") / 2).orderBy(F.desc("impressions"), "page", "query").limit(limit)
    return d.select("page", "query", F.round("position", 6).alias("position"), "impressions", round1(ctr).alias("ctr_pct"), "expected_ctr_pct")


def cannibalization(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Queries with clicks on two or more pages, one row per page, most clicks at stake first."""
    hit = rows.where("clicks > 0")
    q = hit.groupBy("query").agg(F.count("*").alias("pages"), F.sum("clicks").alias("total_clicks")).where("pages >= 2")
    top = q.orderBy(F.desc("total_clicks"), "query").limit(limit)
    return hit.join(top, "query").select("query", "pages", "total_clicks", "page", "clicks", F.round("position", 6).alias("position"))
