"""Survey results, every survey in one pass."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import lit_ts
from eventloom.operators.search import round1

SHOWN, RESPONSE = "$survey_shown", "$survey_response"


def _rows(df: DataFrame, asof: str, days: int) -> DataFrame:
    d = df.where(F.col("name").isin(SHOWN, RESPONSE))
    if days:
        d = d.where(F.col("timestamp") >= lit_ts(asof) - F.expr(f"interval {days} days"))
    return d.select("id", "timestamp", "distinct_id", (F.col("name") == RESPONSE).alias("resp"), v.text(d, "survey_id").alias("survey"),
                    v.text(d, "answer").alias("answer"), v.num_lenient(d, "answer").alias("score")).where("survey is not null")


def results(df: DataFrame, asof: str, days: int = 0) -> DataFrame:
    """(survey, shown, responses, rate_pct, promoters, passives, detractors, nps, average)."""
    r = _rows(df, asof, days)
    n = F.coalesce(F.col("score"), F.lit(0.0)).cast("bigint")
    ans = F.col("resp")
    g = r.groupBy("survey").agg(
        F.count_distinct(F.when(~ans, F.col("distinct_id"))).alias("shown"), F.count_distinct(F.when(ans, F.col("distinct_id"))).alias("responses"),
        F.count(F.when(ans & (n >= 9), 1)).alias("promoters"), F.count(F.when(ans & (n >= 7) & (n < 9), 1)).alias("passives"),
        F.count(F.when(ans & (n < 7), 1)).alias("detractors"), F.avg(F.when(ans, F.coalesce("score", F.lit(0.0)))).alias("_avg"))
    total = F.col("promoters") + F.col("passives") + F.col("detractors")
    return g.select("survey", "shown", "responses", F.when(F.col("shown") > 0, round1(F.col("responses") * 100 / F.col("shown"))).otherwise(F.lit(0.0)).alias("rate_pct"),
                    "promoters", "passives", "detractors", F.when(total > 0, F.round((F.col("promoters") - F.col("detractors")) * 100 / total, 0)).alias("nps"),
                    round1(F.col("_avg")).alias("average"))


def choices(df: DataFrame, asof: str, days: int = 0) -> DataFrame:
    return _rows(df, asof, days).where("resp and answer <> ''").groupBy("survey", "answer").agg(F.count("*").alias("n"))


def recent_texts(df: DataFrame, asof: str, days: int = 0, most: int = 20) -> DataFrame:
    """The ``most`` newest written answers per survey."""
    rn = F.row_number().over(W.partitionBy("survey").orderBy(F.desc("timestamp"), F.desc("id")))
    r = _rows(df, asof, days).where("resp and answer <> ''").withColumn("rank", rn.cast("bigint"))
    return r.where(F.col("rank") <= most).select("survey", "rank", "answer")
