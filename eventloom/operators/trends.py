"""Counts, uniques, breakdowns and numeric measures over time."""
from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.functions.quantiles import exact_quantiles, value_counts
from eventloom.model import attach_row, between, lit_ts
from eventloom.operators.filters import property_keys
from eventloom.operators.rollups import is_user_day, user_days
from eventloom.operators.scope import drop_sampler

# fixed values: most buckets shown per grain, recent end kept, unless ``most`` says otherwise (an empty mapping: all)
MAX_BUCKETS = {"day": 4201, "hour": 744, "week": 4000, "month": 4000}
_STEP = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}
_FMT = {"hour": "yyyy-MM-dd HH:mm", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM-dd"}


def select_events(df: DataFrame, event: str = "", start=None, end=None) -> DataFrame:
    d = between(drop_sampler(df, event), start, end)
    return d.where(F.col("name") == event) if event else d


def calendar(spark, counts: DataFrame, grain: str, start=None, end=None, most: dict = MAX_BUCKETS) -> DataFrame:
    """Every bucket of the window; open ends come from the data; only the recent end is kept when ``most`` has the grain."""
    seen = spark.range(1) if start and end else counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    lo = F.date_trunc(grain, lit_ts(start)) if start else F.col("a")
    hi = F.date_trunc(grain, lit_ts(end) - F.expr("interval 1 microsecond")) if end else F.col("b")
    ends = seen.select(lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    step = F.expr(f"interval {_STEP[grain]}")
    all_b = F.sequence("lo", "hi", step)
    if grain in most:
        all_b = F.slice(all_b, F.greatest(F.lit(1), F.size(all_b) - most[grain] + 1), F.lit(most[grain]))
    return ends.select(F.explode(all_b).alias("bucket"))


def _bucket(grain: str) -> Column:
    return F.date_trunc(grain, "timestamp")


def label_bucket(grain: str) -> Column:
    return F.date_format("bucket", _FMT[grain]).alias("bucket")


def trend(df: DataFrame, event: str = "", start=None, end=None, unique: bool = False, grain: str = "day", most: dict = MAX_BUCKETS) -> DataFrame:
    """(bucket, n, total): zero-filled; the total covers the whole window and dedupes people over it."""
    d = select_events(df, event, start, end)
    n = F.count_distinct("distinct_id") if unique else F.count("*")
    counts = d.groupBy(_bucket(grain).alias("bucket")).agg(n.alias("n"))
    total = (d.agg(F.count_distinct("distinct_id").alias("total")) if unique
             else counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    cal = calendar(df.sparkSession, counts, grain, start, end, most)
    out = attach_row(cal.join(counts, "bucket", "left"), total)
    return out.select(label_bucket(grain), F.coalesce("n", F.lit(0)).alias("n"), "total")


def trend_multi(df: DataFrame, events, start, end, grain: str = "day", most: dict = MAX_BUCKETS) -> DataFrame:
    """Any number of events side by side from one scan."""
    events = list(dict.fromkeys(events))
    d = between(df, start, end).where(F.col("name").isin(*events))
    counts = d.groupBy(_bucket(grain).alias("bucket"), "name").agg(F.count("*").alias("n"))
    cal = calendar(df.sparkSession, counts, grain, start, end, most).withColumn("name", F.explode(F.array(*[F.lit(e) for e in events])))
    out = cal.join(counts, ["bucket", "name"], "left")
    return out.select(label_bucket(grain), "name", F.coalesce("n", F.lit(0)).alias("n"))


def trend_breakdown(df: DataFrame, event: str, prop: str, start=None, end=None, unique: bool = False, most: dict = MAX_BUCKETS) -> DataFrame:
    """One daily series per property value on one shared span."""
    d = select_events(df, event, start, end)
    d = d.select("distinct_id", _bucket("day").alias("bucket"), v.label(d, prop).alias("value"))
    n = F.count_distinct("distinct_id") if unique else F.count("*")
    counts = d.groupBy("bucket", "value").agg(n.alias("n"))
    totals = (d if unique else counts).groupBy("value").agg(
        (F.count_distinct("distinct_id") if unique else F.sum("n")).alias("total"))
    cal = calendar(df.sparkSession, counts, "day", start, end, most)
    days = cal.agg(F.array_sort(F.collect_list("bucket")).alias("days"))      # one entry per day
    grid = attach_row(totals, days).select("value", "total", F.explode("days").alias("bucket"))
    out = grid.join(counts, ["bucket", "value"], "left")
    return out.select("value", label_bucket("day"), F.coalesce("n", F.lit(0)).alias("n"), "total")


QUANTILES = {"median": "median", "p90": 0.90, "p95": 0.95, "p99": 0.99}
_SIMPLE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def _measures(d: DataFrame, key: str, whole: str | None = None) -> DataFrame:
    """Every measure of ``x`` per key; ``whole`` adds one more row, under that key, over everything."""
    aggs = [F.count("x").alias("n"), *[f("x").alias(m) for m, f in _SIMPLE.items()]]
    simple, counts = d.groupBy(key).agg(*aggs), value_counts(d, [key], "x")
    if whole is not None:
        w = F.lit(whole).cast(d.schema[key].dataType).alias(key)
        simple = simple.unionByName(d.agg(*aggs).select(w, "n", *_SIMPLE))
        counts = counts.unionByName(counts.groupBy("_v").agg(F.sum("_c").alias("_c")).select(w, "_v", "_c"))
    q = exact_quantiles(counts, [key], "x", QUANTILES, counted=True).drop("n")
    j = simple.alias("s").join(q.alias("q"), F.col(f"s.{key}").eqNullSafe(F.col(f"q.{key}")), "left")
    return j.select("s.*", *[f"q.{c}" for c in QUANTILES])


MEASURES = [*_SIMPLE, *QUANTILES]


def _tidy() -> list[Column]:
    return [F.round(F.coalesce(F.col(m).cast("double"), F.lit(0.0)), 6).alias(m) for m in MEASURES]


def measure(df: DataFrame, event: str, prop: str, start=None, end=None, most: dict = MAX_BUCKETS) -> DataFrame:
    """Per day and for the whole window ('total'): n and every measure of a numeric property."""
    d = select_events(df, event, start, end)
    d = d.select(F.date_format(_bucket("day"), _FMT["day"]).alias("bucket"), v.num_lenient(d, prop).alias("x")).where("x is not null")
    m = _measures(d, "bucket", whole="total")
    seen = d.select(F.to_timestamp("bucket").alias("bucket"))
    cal = calendar(df.sparkSession, seen, "day", start, end, most).select(label_bucket("day"))
    all_rows = cal.unionByName(df.sparkSession.range(1).select(F.lit("total").alias("bucket")))
    return all_rows.join(m, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), *_tidy())


def measure_breakdown(df: DataFrame, event: str, prop: str, by: str, start=None, end=None) -> DataFrame:
    d = select_events(df, event, start, end)
    d = d.select(v.label(d, by).alias("value"), v.num_lenient(d, prop).alias("x")).where("x is not null")
    return _measures(d, "value").select("value", "n", *_tidy())


def numeric_properties(df: DataFrame) -> DataFrame:
    return property_keys(df).where("num is not null").select("key").distinct()


def property_breakdown(df: DataFrame, prop: str, event: str = "", start=None, end=None) -> DataFrame:
    d = between(df, start, end)
    if event:
        d = d.where(F.col("name") == event)
    return d.groupBy(v.label(d, prop).alias("value")).agg(
        F.count("*").alias("events"), F.count_distinct("distinct_id").alias("visitors"))


def active_users(df: DataFrame, window_days: int, start, end, event: str = "", most: dict = MAX_BUCKETS) -> DataFrame:
    """Distinct people in the trailing N days, per day, from +1/-1 steps instead of an N-fold explode."""
    n = max(1, window_days)
    lo = F.unix_date(F.to_date(lit_ts(start))).cast("bigint")
    hi = F.unix_date(F.to_date(lit_ts(end) - F.expr("interval 1 microsecond"))).cast("bigint")
    d = df if is_user_day(df) else between(df, end=end)
    ud = user_days(d, event).where((F.col("day") >= lo - (n - 1)) & (F.col("day") <= hi))
    w = W.partitionBy("distinct_id").orderBy("day")      # one row per person and day
    ud = ud.withColumn("p", F.lag("day").over(w)).withColumn("q", F.lead("day").over(w))
    steps = F.array(F.struct(F.col("day").alias("day"), F.when(F.col("p") >= F.col("day") - (n - 1), 0).otherwise(1).alias("s")),
                    F.struct((F.col("day") + n).alias("day"), F.when(F.col("q") <= F.col("day") + (n - 1), 0).otherwise(-1).alias("s")))
    delta = ud.select(F.explode(steps).alias("x")).groupBy("x.day").agg(F.sum("x.s").alias("s"))
    cal = df.sparkSession.range(1).select(F.explode(F.sequence(
        (F.greatest(lo, hi - (most["day"] - 1)) if "day" in most else lo) - (n - 1), hi)).alias("day"))
    run = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    out = cal.join(delta, "day", "left").withColumn("n", F.sum(F.coalesce("s", F.lit(0))).over(run))
    return out.where(F.col("day") >= lo).select(F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("bucket"), "n")


def hours_of_day(df: DataFrame, event: str = "$pageview") -> DataFrame:
    c = df.where(F.col("name") == event).groupBy(F.hour("timestamp").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(24).withColumnRenamed("id", "hour").join(c, "hour", "left").select(
        "hour", F.coalesce("n", F.lit(0)).alias("n"))


# ---- formulas --------------------------------------------------------------------------------
def _compile(node, names: set[str]) -> Column:
    """Arithmetic over named series, from Python's own expression grammar; anything else is refused."""
    if isinstance(node, ast.Expression):
        return _compile(node.body, names)
    if isinstance(node, ast.BinOp):
        a, b = _compile(node.left, names), _compile(node.right, names)
        ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b)}
        if type(node.op) in ops:
            return ops[type(node.op)]()
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_compile(node.operand, names)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name) and node.id in names:
        return F.col(node.id)
    raise ValueError("a formula may use series names, numbers, + - * / and parentheses")


def formula(series: dict[str, DataFrame], expression: str) -> DataFrame:
    """Combine (bucket, n) series on the buckets all of them have; dividing by zero is undefined, not 0."""
    joined = None
    for name, s in series.items():
        part = s.select("bucket", F.col("n").cast("double").alias(name))
        joined = part if joined is None else joined.join(part, "bucket")
    val = _compile(ast.parse(expression.strip(), mode="eval"), set(series))
    out = joined.select("bucket", F.round(val, 6).alias("value"))
    return out.withColumn("defined", F.col("value").isNotNull()).withColumn(
        "why", F.when(F.col("value").isNull(), F.lit("division by zero")).otherwise(F.lit("")))
