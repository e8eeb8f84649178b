"""Guesses at a product's main journey: by event coverage, and by page paths."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.functions.quantiles import exact_quantiles
from eventloom.model import attach_row

# fixed values: page names that usually mean a decision
INTENT_WORDS = ("checkout", "purchase", "payment", "subscribe", "upgrade", "billing", "signup", "sign-up", "register", "join", "trial",
                "get-started", "welcome", "onboard", "install", "connect", "invite", "book", "demo", "contact")


def detect(df: DataFrame, top: int = 4) -> DataFrame:
    """The widest-covered events in order of their median first-touch offset."""
    first = df.groupBy("distinct_id", "name").agg(F.min(F.unix_micros("timestamp")).alias("us"))
    start = df.groupBy("distinct_id").agg(F.min(F.unix_micros("timestamp")).alias("us0"))
    offs = first.join(start, "distinct_id").select("name", ((F.col("us") - F.col("us0")) / 1e6).alias("secs"))
    q = exact_quantiles(offs, ["name"], "secs", {"median_secs": "upper_median"})
    total = start.agg(F.greatest(F.lit(3), F.floor(F.count("*") / 20)).alias("floor"))
    c = attach_row(q, total).where("n >= floor")
    c = c.orderBy(F.desc("n"), "name").limit(top)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("median_secs", F.desc("n"), "name"))
    out = c.select(rank.cast("bigint").alias("step"), F.col("name").alias("event"), F.col("n").alias("coverage"),
                   F.round("median_secs", 6).alias("median_secs"), F.count("*").over(W.partitionBy(F.lit(0))).alias("_k"))
    return out.where("_k >= 2").drop("_k")


def propose_page_funnel(df: DataFrame) -> DataFrame:
    """Entry page, optional middle, and the rarest intent page, with people who reached each in order."""
    p = F.coalesce(v.text(df, "path"), F.lit(""))
    first = (df.where((F.col("name") == "$pageview") & (F.col("distinct_id") != "") & (p != ""))
             .groupBy("distinct_id", p.alias("path")).agg(F.min(F.unix_seconds("timestamp")).alias("t")))
    per_path = first.groupBy("path").agg(F.count("*").alias("n"))
    intent = F.lower("path").rlike("|".join(w.replace("-", "\\-") for w in INTENT_WORDS))
    by_pop = F.struct(F.col("n").alias("n"), F.col("path").alias("path"))
    chosen = per_path.agg(
        F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("entry"),
        F.min(F.when(intent, by_pop)).alias("dest"), F.max(F.when(intent, by_pop)).alias("mid"))
    plan = chosen.select(F.col("entry.path").alias("p0"), F.when(
        (F.col("mid.path") != F.col("entry.path")) & (F.col("mid.path") != F.col("dest.path")) &
        (F.col("mid.n") > F.col("dest.n")), F.col("mid.path")).alias("p1"),
        F.when(F.col("dest.path") != F.col("entry.path"), F.col("dest.path")).alias("p2"))
    at = lambda c: F.min(F.when(F.col("path") == F.col(c), F.col("t"))).alias("t" + c)
    t = attach_row(first, plan).groupBy("distinct_id", "p0", "p1", "p2").agg(at("p0"), at("p1"), at("p2"))
    via = F.when(F.col("p1").isNull(), F.col("tp0")).when(F.col("tp1") >= F.col("tp0"), F.col("tp1"))
    n = t.groupBy("p0", "p1", "p2").agg(
        F.count("*").alias("people"), F.count("tp0").alias("n0"),
        F.count(F.when(F.col("tp1") >= F.col("tp0"), 1)).alias("n1"),
        F.count(F.when(F.col("tp2") >= via, 1)).alias("n2")).where("people >= 10 and p2 is not null")
    narrows = F.when(F.col("p1").isNull(), F.col("n2") < F.col("n0")).otherwise(
        (F.col("n1") < F.col("n0")) & (F.col("n2") < F.col("n1")))
    sure = narrows & (F.col("n2") * 4 <= F.col("n0")) & (F.col("n2") >= 5)
    rows = F.array(F.struct(F.lit(1).alias("i"), F.col("p0").alias("path"), F.col("n0").alias("people")),
                   F.struct(F.lit(2).alias("i"), F.col("p1").alias("path"), F.col("n1").alias("people")),
                   F.struct(F.lit(3).alias("i"), F.col("p2").alias("path"), F.col("n2").alias("people")))
    e = n.select(sure.alias("confident"), F.posexplode(F.filter(rows, lambda r: r["path"].isNotNull())).alias("pos", "r"))
    return e.select((F.col("pos") + 1).cast("bigint").alias("step"), "r.path", "r.people", "confident")
