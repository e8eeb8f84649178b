"""Daily aggregates of an event table: building, merging, and expanding them back into events."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import between, lit_ts
from eventloom.operators.scope import scope_production

# fixed values: most values a dimension may have, rows made per task step, days re-read on a sync
MAX_VALUES, CHUNK, OVERLAP_DAYS = 500, 100_000, 3


def daily_counts(df: DataFrame, start: str, end: str) -> DataFrame:
    """(day, name, count, first, last)"""
    d = between(scope_production(df), start, end)
    return d.groupBy(F.to_date("timestamp").alias("day"), "name").agg(F.count("*").alias("count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _dim_rows(df: DataFrame, start: str, end: str, dims) -> DataFrame:
    d = between(scope_production(df), start, end)
    cells = F.array(*[F.struct(F.lit(x).alias("dim"), v.text(d, x).alias("value")) for x in dims])
    return d.select(F.to_date("timestamp").alias("day"), "name", F.explode(cells).alias("c")).select("day", "name", "c.*").where("value <> ''")


def segment_counts(df: DataFrame, start: str, end: str, dims, max_values: int = MAX_VALUES) -> DataFrame:
    """(day, name, dim, value, count); a dimension with too many values of an event is dropped whole."""
    c = _dim_rows(df, start, end, dims).groupBy("day", "name", "dim", "value").agg(F.count("*").alias("count"))
    wide = c.groupBy("name", "dim").agg(F.count_distinct("value").alias("n")).where(F.col("n") > max_values).select("name", "dim")
    return c.join(wide, ["name", "dim"], "left_anti").select("day", "name", "dim", "value", "count")


def dropped_dims(df: DataFrame, start: str, end: str, dims, max_values: int = MAX_VALUES) -> DataFrame:
    c = _dim_rows(df, start, end, dims).groupBy("name", "dim").agg(F.count_distinct("value").alias("values"))
    return c.where(F.col("values") > max_values)


def merge(held: DataFrame, fresh: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fresh buckets replace held ones of the same (day, name); the result is trimmed to [start, end)."""
    cols = [c for c in held.columns if c not in ("day", "name")]
    f = fresh.select("day", "name", *[F.col(c).alias(f"_f_{c}") for c in cols], F.lit(True).alias("_new"))
    j = held.join(f, ["day", "name"], "full")
    out = j.select("day", "name", *[F.when(F.col("_new"), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in cols])
    if start:
        out = out.where(F.col("day") >= F.to_date(lit_ts(start)))
    return out.where(F.col("day") < F.to_date(lit_ts(end))) if end else out


def sync_start(held: DataFrame, overlap_days: int = OVERLAP_DAYS) -> DataFrame:
    """(from_day,): the last held day minus the overlap that catches late events."""
    return held.agg(F.date_sub(F.max("day"), overlap_days).alias("from_day"))


def overwrite_days(fresh: DataFrame, path: str) -> None:
    """Replace only the re-read day partitions of a snapshot table."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


# ---- expansion ---------------------------------------------------------------------------------
def _rows(buckets: DataFrame, chunk: int) -> DataFrame:
    """One row per counted event, made in bounded pieces that are spread before the second step."""
    b = buckets.where(F.col("count") > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / chunk))))
    b = b.repartition("day", "name", "_k")
    return b.withColumn("i", F.explode(F.sequence(F.col("_k") * chunk, F.least(F.col("_k") * chunk + chunk - 1, F.col("count") - 1)))).drop("_k")


def _segments(buckets: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per bucket a map dim → [(upper row, value)] in value order, and the dims that do not fit."""
    tot = segments.groupBy("day", "name", "dim").agg(F.sum("count").alias("t")).join(buckets.select("day", "name", F.col("count").alias("c")), ["day", "name"])
    over = tot.where("t > c").select("day", "name", "dim")
    ok = segments.join(over, ["day", "name", "dim"], "left_anti")
    upto = W.partitionBy("day", "name", "dim").orderBy("value").rowsBetween(W.unboundedPreceding, 0)      # at most MAX_VALUES rows
    laid = ok.withColumn("hi", F.sum("count").over(upto))
    per = laid.groupBy("day", "name", "dim").agg(F.array_sort(F.collect_list(F.struct("hi", "value"))).alias("cuts"))
    return per.groupBy("day", "name").agg(F.map_from_entries(F.collect_list(F.struct("dim", "cuts"))).alias("_seg")), over


def expand(buckets: DataFrame, segments: DataFrame, dims, revenue: DataFrame | None = None, to: str = "", money_days: int = 30, chunk: int = CHUNK) -> DataFrame:
    """Pseudo-events with the buckets' counts: times spread from first to last, values in sorted order."""
    seg, _ = _segments(buckets, segments)
    b = buckets.select("day", "name", "count", F.unix_micros("first").alias("f"), F.unix_micros("last").alias("l")).join(seg, ["day", "name"], "left")
    b = b.withColumn("l", F.greatest("l", "f"))
    if revenue is not None:
        b = _money_plan(b, revenue, to, money_days)
    r = _rows(b, chunk)
    us = F.when(F.col("i") == F.col("count") - 1, F.when(F.col("count") == 1, F.col("f")).otherwise(F.col("l"))).otherwise(
        F.col("f") + F.expr("cast((cast(l - f as decimal(38,0)) * i) div greatest(count - 1, 1) as bigint)"))
    at = lambda d: F.element_at(F.filter(F.element_at("_seg", F.lit(d)), lambda c: c["hi"] > F.col("i")), 1)
    pick = lambda d: F.when(F.size(F.filter(F.element_at("_seg", F.lit(d)), lambda c: c["hi"] > F.col("i"))) > 0, at(d)["value"])
    key = F.concat_ws(":", F.lit("agg"), F.date_format("day", "yyyy-MM-dd"), "name", "i")
    out = r.select(key.alias("id"), "name", key.alias("distinct_id"), F.timestamp_micros(us).alias("timestamp"), *[pick(d).alias(d) for d in dims],
                   *([c for c in ("prop", "total", "rows", "people", "numeric", "seen", "_in0", "_in_before", "_out_before", "_all_out", "_bad", "i") if c in r.columns] if revenue is not None else []))
    return _money_overlay(out) if revenue is not None else out


def overflow(buckets: DataFrame, segments: DataFrame) -> DataFrame:
    """(day, name, dim): breakdowns that add up to more than the day's count and are left out."""
    return _segments(buckets, segments)[1]


def _money_plan(b: DataFrame, revenue: DataFrame, to: str, days: int) -> DataFrame:
    """Per bucket: its first in-window row and how many rows of the event come before it on each side."""
    cut = F.unix_micros(lit_ts(to) - F.expr(f"interval {days} days"))
    span = F.col("l") - F.col("f")
    first_in = F.when(F.col("f") >= cut, 0).when(F.col("l") < cut, F.col("count")).otherwise(F.ceil((cut - F.col("f")).cast("double") * (F.col("count") - 1) / span)).cast("bigint")
    w = W.partitionBy("name").orderBy("day").rowsBetween(W.unboundedPreceding, -1)         # one row per day
    whole = W.partitionBy("name")
    z = F.lit(0).cast("bigint")
    b = b.withColumn("_in0", first_in)
    b = b.withColumn("_in_before", F.coalesce(F.sum(F.col("count") - F.col("_in0")).over(w), z)).withColumn("_out_before", F.coalesce(F.sum("_in0").over(w), z))
    b = b.withColumn("_all_out", F.sum("_in0").over(whole)).withColumn("_all", F.sum("count").over(whole))
    b = b.join(revenue.where("prop <> ''"), "name", "left")
    return b.withColumn("_bad", F.col("prop").isNull() | (F.col("seen") > F.col("_all")) | (F.col("rows") > F.col("_all") - F.col("_all_out"))).drop("_all")


def _money_overlay(r: DataFrame) -> DataFrame:
    """Write the money property so that totals, people and quality counts come out exactly."""
    inside = F.col("i") >= F.col("_in0")
    n = F.col("_in_before") + F.col("i") - F.col("_in0")                        # rank among in-window rows
    spare = F.when(inside, F.col("_all_out") + n - F.col("rows")).otherwise(F.col("_out_before") + F.col("i"))
    valued = ~F.col("_bad") & inside & (n < F.col("rows"))
    filler = ~F.col("_bad") & ~valued
    text = (F.when(valued & (n == 0), F.col("total").cast("string")).when(valued, "0.0").when(filler & (spare < F.col("numeric") - F.col("rows")), "-1.0")
            .when(filler & (spare < F.col("seen") - F.col("rows")), "not-a-number"))
    person = F.concat(F.lit("agg:person:"), "name", F.lit(":"), n % F.greatest(F.col("people"), F.lit(1)))
    return (r.withColumn("distinct_id", F.when(valued, person).otherwise(F.col("distinct_id"))).withColumn("money_prop", F.when(text.isNotNull(), F.col("prop"))).withColumn("money", text)
            .drop("prop", "total", "rows", "people", "numeric", "seen", "_in0", "_in_before", "_out_before", "_all_out", "_bad", "i"))


def revenue_counters(df: DataFrame, start: str, money_start: str, end: str) -> DataFrame:
    """(name, prop, seen, numeric, rows, people, total): what the expansion needs to reproduce money figures."""
    from eventloom.operators.changes import MONEY_NUMERIC, MONEY_PROPS
    d = between(scope_production(df), start, end)
    cells = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(p).alias("prop"), v.present(d, p).alias("has"), v.num_strict(d, p).alias("x")) for i, p in enumerate(MONEY_PROPS)])
    x = d.select("name", "distinct_id", "timestamp", F.explode(cells).alias("m")).select("name", "distinct_id", "timestamp", "m.*").where("has")
    inside = (F.col("timestamp") >= lit_ts(money_start)) & (F.col("x") >= 0)
    per = x.groupBy("name", "prop", "prio", "distinct_id").agg(F.count("*").alias("seen"), F.count("x").alias("numeric"), F.count(F.when(inside, 1)).alias("rows"), F.sum(F.when(inside, F.col("x"))).alias("total"))
    g = per.groupBy("name", "prop", "prio").agg(F.sum("seen").alias("seen"), F.sum("numeric").alias("numeric"), F.sum("rows").alias("rows"),
                                                F.count(F.when(F.col("rows") > 0, 1)).alias("people"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    ok = g.where((F.col("numeric") > 0) & (F.col("numeric") / F.col("seen") >= MONEY_NUMERIC))
    best = ok.groupBy("name").agg(F.min(F.struct((-F.col("numeric")).alias("k"), "prio", "prop", "seen", "numeric", "rows", "people", "total")).alias("b"))
    return best.select("name", "b.prop", "b.seen", "b.numeric", "b.rows", "b.people", "b.total")
