"""Error grouping by normalised message, and what each group costs the funnel."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, lit_ts
from eventloom.operators import funnel
from eventloom.operators.search import round1

EXCEPTION = "$exception"
# fixed values: what is replaced in a message, in this order
NORMALISE = ((r"https?://[^\s'\"]+", "<url>"), (r"\b[0-9a-fA-F-]{32,}\b", "<id>"), (r"\b(?:0x)?[0-9a-fA-F]{8,}\b", "<id>"),
             (r"'[^']{0,80}'|\"[^\"]{0,80}\"", "<value>"), (r"\b\d+\b", "<n>"), (r"\s+", " "))
MIN_COMPARE = 20


def normalise(msg: Column, chars: int | None = None) -> Column:
    """The message without what varies; ``chars`` cuts it, so that messages with a common beginning are one."""
    s = F.trim(F.coalesce(msg, F.lit("")))
    for pattern, repl in NORMALISE:
        s = F.regexp_replace(s, pattern, repl)
    return F.trim(s) if chars is None else F.substring(F.trim(s), 1, chars)


def _exceptions(df: DataFrame, chars: int | None = None) -> DataFrame:
    d = df.where(F.col("name") == EXCEPTION)
    txt = lambda k: F.coalesce(v.text(d, k), F.lit(""))
    e = d.select("id", "timestamp", "distinct_id", normalise(v.text(d, "message"), chars).alias("title"), txt("source").alias("source"),
                 F.coalesce(v.num_strict(d, "lineno"), F.lit(0)).cast("bigint").alias("line"), txt("path").alias("path"))
    base = F.regexp_replace("source", r"^.*[/\\](?=.)", "")
    key = F.concat_ws("|", "title", F.when(base != "", base), F.when(F.col("line") > 0, F.col("line").cast("string")))
    return e.withColumn("fingerprint", F.substring(F.md5(key), 1, 16))


def groups(df: DataFrame, start: str, end: str, prior_start: str, paths: int = 5, chars: int | None = None) -> DataFrame:
    """(fingerprint, title, source, line, count, users, paths, first, last, new) over [start, end).

    ``paths``: how many of the commonest paths are named; ``chars``: group by so many characters of a message (None: all).
    """
    t = F.col("timestamp")
    inside = (t >= lit_ts(start)) & (t < lit_ts(end))
    e = _exceptions(df.where((t >= lit_ts(prior_start)) & (t < lit_ts(end))), chars)
    g = e.groupBy("fingerprint").agg(
        F.count(F.when(inside, 1)).alias("count"), F.count_distinct(F.when(inside, F.col("distinct_id"))).alias("users"),
        F.count(F.when(~inside, 1)).alias("_before"), F.min(F.when(inside, t)).alias("first"), F.max(F.when(inside, t)).alias("last"),
        F.min(F.when(inside, F.struct("timestamp", "id", "title", "source", "line"))).alias("_f")).where("count > 0")
    per_path = e.where(inside & (F.col("path") != "")).groupBy("fingerprint", "path").agg(F.count("*").alias("n"))
    rn = F.row_number().over(W.partitionBy("fingerprint").orderBy(F.desc("n"), "path"))
    top = per_path.withColumn("_rn", rn).where(F.col("_rn") <= paths).groupBy("fingerprint").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "path"))), lambda x: x["path"]), ",").alias("paths"))
    j = g.join(top, "fingerprint", "left")
    return j.select("fingerprint", "_f.title", "_f.source", "_f.line", "count", "users", F.coalesce("paths", F.lit("")).alias("paths"),
                    F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), (F.col("_before") == 0).alias("is_new"))


def summary(df: DataFrame, start: str, end: str) -> DataFrame:
    """Total errors, people affected and the crash-free percentage of everyone active."""
    t = F.col("timestamp")
    u = df.where((t >= lit_ts(start)) & (t < lit_ts(end))).groupBy("distinct_id").agg(F.count(F.when(F.col("name") == EXCEPTION, 1)).alias("e"))
    a = u.agg(F.sum("e").alias("total"), F.count("*").alias("users"), F.count(F.when(F.col("e") > 0, 1)).alias("affected"))
    return a.withColumn("crash_free_pct", F.when(F.col("users") > 0, round1((F.col("users") - F.col("affected")) * 100 / F.col("users"))))


def funnel_impact(df: DataFrame, steps, window_s: float) -> DataFrame:
    """Conversion of the people who hit each error against everyone who did not.

    The funnel runs once; the clean side is everyone minus the affected.
    """
    people = funnel.outcomes(df, steps, window_s)
    hit = _exceptions(df).groupBy("fingerprint", "distinct_id").agg(F.min("title").alias("title"))
    done = F.col("converted").cast("bigint")
    everyone = people.agg(F.count("*").alias("_n"), F.sum(done).alias("_c"))
    g = hit.join(people, "distinct_id").groupBy("fingerprint").agg(
        F.min("title").alias("title"), F.count("*").alias("affected_users"), F.sum(done).alias("_ac"), F.max("reached").alias("furthest"))
    g = attach_row(g, everyone).withColumn("clean_users", F.col("_n") - F.col("affected_users")).withColumn("_cc", F.col("_c") - F.col("_ac"))
    conv = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(F.lit(0.0))
    gap = (conv("_cc", "clean_users") - conv("_ac", "affected_users")) * 100
    names = F.array(*[F.lit(s.event) for s in funnel.steps_of(*steps)])
    return g.select("fingerprint", "title", "affected_users", "clean_users", round1(conv("_ac", "affected_users") * 100).alias("affected_conv"),
                    round1(conv("_cc", "clean_users") * 100).alias("clean_conv"), F.round(gap, 6).alias("gap_pct"),
                    ((F.col("affected_users") < MIN_COMPARE) | (F.col("clean_users") < MIN_COMPARE)).alias("thin"),
                    F.element_at(names, F.col("furthest").cast("int")).alias("step"))
