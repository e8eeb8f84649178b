"""Lifecycle, stickiness, account roll-ups and window comparisons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, lit_ts
from eventloom.operators import filters as flt, identity
from eventloom.operators.rollups import user_days
from eventloom.operators.scope import drop_sampler


def day_text(c: Column) -> Column:
    return F.date_format(F.date_from_unix_date(c.cast("int")), "yyyy-MM-dd")


def lifecycle(df: DataFrame, days: int = 30) -> DataFrame:
    """Per day: new, returning, resurrected and dormant people."""
    ud = user_days(df)
    w = W.partitionBy("distinct_id").orderBy("day")
    ud = (ud.withColumn("p", F.lag("day").over(w)).withColumn("q", F.lead("day").over(w)))
    kind = F.when(F.col("p").isNull(), "new").when(F.col("p") == F.col("day") - 1, "returning").otherwise("resurrected")
    marks = F.array(F.struct(F.col("day").alias("day"), kind.alias("kind")),
                    F.when(F.col("q").isNull() | (F.col("q") > F.col("day") + 1),
                           F.struct((F.col("day") + 1).alias("day"), F.lit("dormant").alias("kind"))))
    m = ud.select(F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("m")).select("m.*")
    kinds = ("new", "returning", "resurrected", "dormant")
    c = m.groupBy("day").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])
    last = user_days(df).agg(F.max("day").alias("hi"))
    cal = last.select(F.explode(F.sequence(F.col("hi") - (days - 1), F.col("hi"))).alias("day"))
    out = cal.join(c, "day", "left")
    return out.select(day_text(F.col("day")).alias("bucket"), *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def stickiness(df: DataFrame, asof: str) -> DataFrame:
    """Distinct people in the trailing 1, 7 and 30 days and DAU/MAU."""
    d = drop_sampler(df).where(F.col("timestamp") >= lit_ts(asof) - F.expr("interval 30 days"))
    # last activity decides all three windows, so one pre-aggregated row per person is enough
    last = d.groupBy("distinct_id").agg(F.max("timestamp").alias("t"))
    n = lambda k: F.count(F.when(F.col("t") >= lit_ts(asof) - F.expr(f"interval {k} days"), 1))
    s = last.agg(n(1).alias("dau"), n(7).alias("wau"), n(30).alias("mau"))
    return s.withColumn("dau_over_mau", v.ratio(F.col("dau"), F.col("mau")))


def account_rollup(df: DataFrame, prop: str, asof: str, limit: int = 50) -> DataFrame:
    has = v.present(df, prop)
    g = df.where(has).groupBy(F.coalesce(v.text(df, prop), F.lit("")).alias("value")).agg(
        F.count("*").alias("events"), F.count_distinct("distinct_id").alias("users"), F.max("timestamp").alias("last"))
    active = lambda k: F.count(F.when(F.col("last") >= lit_ts(asof) - F.expr(f"interval {k} days"), 1))
    totals = g.agg(F.count("*").alias("groups"), active(7).alias("active_7d"), active(30).alias("active_30d"))
    top = g.orderBy(F.desc("events"), "value").limit(limit)
    return attach_row(top, totals).select("value", "events", "users", F.unix_micros("last").alias("last_us"),
                                                     "groups", "active_7d", "active_30d")


def _delta_pct(a: Column, b: Column) -> Column:
    """Signed whole percent, half away from zero; NULL without a prior period."""
    return F.when(b > 0, F.round((a - b) / b * 100, 0))


def _visitors(w: str) -> Column:
    """People with a pageview in the window; anyone active where nothing is web-tracked."""
    n = lambda c: F.count(F.when(F.col(f"{w}_{c}") > 0, 1))
    return F.when(F.sum(f"{w}_pv") > 0, n("pv")).otherwise(n("all"))


def compare_windows(df: DataFrame, events, current: tuple[str, str], prior: tuple[str, str], filters=()) -> DataFrame:
    """Event count, pageviews and visitors of two windows, in one pass."""
    d = flt.apply(identity.stamp_for_filters(df, filters), filters) if filters else df
    inside = lambda w: (F.col("timestamp") >= lit_ts(w[0])) & (F.col("timestamp") < lit_ts(w[1]))
    d = d.where(inside(current) | inside(prior)).withColumn("_cur", inside(current))
    pv = F.col("name") == "$pageview"
    per_user = d.groupBy("distinct_id").agg(
        *[F.count(F.when(F.col("_cur") & (F.col("name") == e), 1)).alias(f"c_{i}") for i, e in enumerate(events)],
        *[F.count(F.when(~F.col("_cur") & (F.col("name") == e), 1)).alias(f"p_{i}") for i, e in enumerate(events)],
        F.count(F.when(F.col("_cur") & pv, 1)).alias("c_pv"), F.count(F.when(~F.col("_cur") & pv, 1)).alias("p_pv"),
        F.count(F.when(F.col("_cur"), 1)).alias("c_all"), F.count(F.when(~F.col("_cur"), 1)).alias("p_all"))
    cells = [F.struct(F.lit(e).alias("metric"), F.sum(f"c_{i}").alias("current"), F.sum(f"p_{i}").alias("prior"))
             for i, e in enumerate(events)]
    cells += [F.struct(F.lit("pageviews").alias("metric"), F.sum("c_pv").alias("current"), F.sum("p_pv").alias("prior")),
              F.struct(F.lit("visitors").alias("metric"), _visitors("c").alias("current"), _visitors("p").alias("prior"))]
    r = per_user.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    return r.select("metric", "current", "prior", _delta_pct(F.col("current"), F.col("prior")).alias("delta_pct"))


def segment_vs_segment(df: DataFrame, event: str, a: flt.Filter, b: flt.Filter) -> DataFrame:
    """One event's count for two segments and their intersection.

    Visitor attributes scope people (any matching event), other properties scope events.
    """
    def in_seg(f: flt.Filter, name: str, d: DataFrame) -> DataFrame:
        if f.prop in identity.ACQUISITION_PROPS:
            who = df.groupBy("distinct_id").agg(F.max(flt.predicate(df, f).cast("int")).alias(name))
            return d.join(who, "distinct_id", "left").withColumn(name, F.col(name) == 1)
        return d.withColumn(name, flt.predicate(d, f))

    d = in_seg(b, "_b", in_seg(a, "_a", df.where(F.col("name") == event)))
    return d.agg(F.count(F.when(F.col("_a"), 1)).alias("a"), F.count(F.when(F.col("_b"), 1)).alias("b"),
                 F.count(F.when(F.col("_a") & F.col("_b"), 1)).alias("both"))


def segment_visitors(df: DataFrame, prop: str) -> DataFrame:
    """Visitors per value of an acquisition property, each attributed once by their first pageview."""
    pv = df.where(F.col("name") == "$pageview")
    val = v.text(pv, prop)
    val = v.host(val) if prop == "referrer" else val
    first = pv.groupBy("distinct_id").agg(F.min(F.struct("timestamp", "id", val.alias("v")))["v"].alias("value"))
    return first.groupBy(F.coalesce("value", F.lit("(none)")).alias("value")).agg(F.count("*").alias("visitors"))


def site_pulse(df: DataFrame, prop: str, asof: str, days: int) -> DataFrame:
    """Per site: events and visitors of the current and the prior period, when two named sites report."""
    d = drop_sampler(df)
    cut = lit_ts(asof) - F.expr(f"interval {days} days")
    old = lit_ts(asof) - F.expr(f"interval {2 * days} days")
    d = d.where(F.col("timestamp") >= old).select(
        F.coalesce(v.text(d, prop), F.lit("")).alias("site"), "distinct_id", (F.col("timestamp") >= cut).alias("cur"))
    pu = d.groupBy("site", "distinct_id").agg(F.count(F.when(F.col("cur"), 1)).alias("c"), F.count(F.when(~F.col("cur"), 1)).alias("p"))
    s = pu.groupBy("site").agg(F.sum("c").alias("events"), F.count(F.when(F.col("c") > 0, 1)).alias("visitors"),
                               F.sum("p").alias("prior_events"), F.count(F.when(F.col("p") > 0, 1)).alias("prior_visitors"))
    t = s.agg(F.sum("events").alias("_all"), F.count(F.when(F.col("site") != "", 1)).alias("_named"))
    s = attach_row(s, t).where("_named >= 2 and (site <> '' or (events > 0 and events * 50 >= _all))")
    return s.select(F.when(F.col("site") == "", "(no site)").otherwise(F.col("site")).alias("site"), "events", "visitors",
                    "prior_events", "prior_visitors")
