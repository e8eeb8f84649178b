"""Step changes in daily series, for every event at once, and what stands behind each change.

The raw events are read once for the daily counts; detection, sizing, recovery and replay work on
that small table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import stats, values as v
from eventloom.model import attach_row, day_num, lit_ts
from eventloom.operators.engagement import day_text
from eventloom.operators.filters import property_keys
from eventloom.operators.rollups import is_user_day, name_days
from eventloom.operators.scope import drop_sampler
from eventloom.session import materialize

# fixed values: side length, relative move, daily floor, monthly floor
MIN_SIDE, MIN_MOVE, MIN_DAILY, MIN_PEOPLE = 3, 0.25, 5, 20


def _d(ts: str) -> Column:
    return F.unix_date(F.to_date(lit_ts(ts))).cast("bigint")


def product_events(df: DataFrame) -> DataFrame:
    """What the product sends on purpose: no autocapture, none of the engine's own events."""
    return drop_sampler(df).where(~F.startswith("name", F.lit("$")) & (F.col("name") != ""))


def daily_counts(df: DataFrame) -> DataFrame:
    """(name, day, c), from events or from the user_day roll-up."""
    return name_days(df)


def dense(counts: DataFrame, last: Column, days: int, keys=("name",)) -> DataFrame:
    """One row per key and day from the key's first day in the window to ``last``, zeros filled."""
    keys = list(keys)
    win = counts.where((F.col("day") > last - days) & (F.col("day") <= last))
    span = win.groupBy(*keys).agg(F.min("day").alias("a"), F.max(last).alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(win.select(*keys, "day", "c"), [*keys, "day"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def filled(counts: DataFrame, last: Column, days: int) -> DataFrame:
    """(name, day, c) for every day of the window, leading zeros included."""
    win = counts.where((F.col("day") > last - days) & (F.col("day") <= last))
    grid = win.select("name").distinct().select("name", F.explode(F.sequence(last - (days - 1), last)).alias("day"))
    return grid.join(win.select("name", "day", "c"), ["name", "day"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def impacts(df: DataFrame, deploys: DataFrame, asof: str, days: int = 30, window: int = 3) -> DataFrame:
    """Every event's zero-filled daily series against every deploy."""
    return deploy_impact(filled(daily_counts(drop_sampler(df).where(F.col("timestamp") <= lit_ts(asof))), _d(asof), days), deploys, window)


def step_change(series: DataFrame, keys=("name",)) -> DataFrame:
    """Best single split per series: located by means, reported and judged by medians."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("day")            # a series holds at most the window's days
    whole = W.partitionBy(*keys)
    s = series.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole)).withColumn("t", F.sum("c").over(whole))
    s = s.withColumn("pre", F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    i, n = F.col("i"), F.col("n")
    gap = (F.col("t") - F.col("pre")) / (n - i) - F.col("pre") / i
    s = s.withColumn("score", F.when((n >= 2 * MIN_SIDE) & (i >= MIN_SIDE) & (i <= n - MIN_SIDE), i * (n - i) / n * gap * gap))
    # ties go to the earliest split; scores are compared at nine digits so equal splits really tie
    cut = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.round("score", 9)).alias("s"), "i", "day"))).over(whole)
    s = s.withColumn("cut", cut).where("cut is not null")
    g = s.groupBy(*keys).agg(F.max("cut.day").alias("day"), F.max("n").alias("days"),
                             F.median(F.when(F.col("i") < F.col("cut.i"), F.col("c"))).alias("b"), F.median(F.when(F.col("i") >= F.col("cut.i"), F.col("c"))).alias("a"))
    b, a = F.col("b"), F.col("a")
    pct = F.when((b == 0) & (a == 0), None).when(b == 0, 100.0).otherwise(stats.round_to((a - b) / b * 100, 1))
    found = ~((b == 0) & (a == 0)) & (F.abs(a - b) / F.greatest(b, F.lit(1.0)) >= MIN_MOVE)
    return g.select(*keys, "day", "days", stats.round_to(b, 1).alias("before"), stats.round_to(a, 1).alias("after"), pct.alias("pct"),
                    F.when((b > 0) & (a < b), "drop").otherwise("spike").alias("direction"), found.alias("found"), (found & (a == 0)).alias("stopped"))


def detect(df: DataFrame, asof: str, days: int = 30) -> DataFrame:
    d = product_events(df)
    if not is_user_day(df):
        d = d.where(F.col("timestamp") <= lit_ts(asof))
    return step_change(dense(daily_counts(d), _d(asof), days))


def _judge(steps: DataFrame, keys=("name",)) -> DataFrame:
    people = F.floor(F.abs(F.col("before") - F.col("after")) * 30)
    s = steps.where("found").withColumn("people", people).where((F.col("before") >= MIN_DAILY) & (F.col("people") >= MIN_PEOPLE))
    return s.select(*keys, "day", F.when(F.col("direction") == "drop", "regression").otherwise("surge").alias("kind"), "before", "after", "pct", "people")


def findings(df: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """Step changes large enough to be news: (name, day, kind, before, after, pct, people)."""
    return _judge(detect(df, asof, days))


def below_floor(df: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """Events too small to judge, with their daily rate."""
    t = F.col("timestamp")
    d = product_events(df).where((t >= lit_ts(asof) - F.expr(f"interval {days} days")) & (t < lit_ts(asof)))
    r = d.groupBy("name").agg((F.count("*") / days).alias("rate")).where((F.col("rate") > 0) & (F.col("rate") < MIN_DAILY))
    r = r.join(findings(df, asof, days).select("name"), "name", "left_anti")
    return r.select("name", stats.round_to(F.col("rate"), 1).alias("per_day"), F.lit(MIN_DAILY).cast("bigint").alias("need_per_day"))


# fixed values: recovery window and tolerance
RECOVERY_DAYS, RECOVERY_SHARE = 3, 0.9


def recovery(df: DataFrame, asof: str, found: DataFrame) -> DataFrame:
    """(name, day, before_mean, current_mean, recovered) for regressions old enough to call."""
    us, now = F.unix_micros("timestamp"), F.unix_micros(lit_ts(asof))
    r = found.where("kind = 'regression'").select("name", "day")
    span = RECOVERY_DAYS * 86_400_000_000
    at = F.col("day") * 86_400_000_000
    j = df.select("name", us.alias("us")).join(r, "name")
    m = j.groupBy("name", "day").agg((F.count(F.when((F.col("us") >= at - span) & (F.col("us") < at), 1)) / RECOVERY_DAYS).alias("b"),
                                     (F.count(F.when((F.col("us") >= now - span) & (F.col("us") < now), 1)) / RECOVERY_DAYS).alias("c"))
    old = now - at >= (RECOVERY_DAYS + 1) * 86_400_000_000
    return m.select("name", "day", F.round("b", 6).alias("before_mean"), F.round("c", 6).alias("current_mean"),
                    (old & (F.col("b") > 0) & (F.col("c") >= F.col("b") * RECOVERY_SHARE)).alias("recovered"))


# fixed values: names that mean money, in order; share that must be numeric; events needed
MONEY_PROPS, MONEY_NUMERIC, MONEY_EVENTS = ("amount", "revenue", "value", "price", "total"), 0.8, 20


def revenue_per_person(df: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """(name, prop, per_person, events, people): the most numeric money property of each event."""
    d = product_events(df)
    cells = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(p).alias("prop"), v.present(d, p).alias("has"), v.num_strict(d, p).alias("x"))
                      for i, p in enumerate(MONEY_PROPS)])
    x = d.select("name", "distinct_id", "timestamp", F.explode(cells).alias("m")).select("name", "distinct_id", "timestamp", "m.*").where("has")
    inside = F.col("timestamp") >= lit_ts(asof) - F.expr(f"interval {days} days")
    per = x.groupBy("name", "prop", "prio", "distinct_id").agg(
        F.count("*").alias("seen"), F.count("x").alias("numeric"), F.sum(F.when(inside & (F.col("x") > 0), F.col("x"))).alias("total"),
        F.count(F.when(inside & (F.col("x") >= 0), 1)).alias("n"))
    g = per.groupBy("name", "prop", "prio").agg(F.sum("seen").alias("seen"), F.sum("numeric").alias("numeric"), F.sum("total").alias("total"), F.sum("n").alias("n"),
                                                F.count(F.when(F.col("n") > 0, 1)).alias("people"))
    ok = g.where((F.col("numeric") > 0) & (F.col("numeric") / F.col("seen") >= MONEY_NUMERIC))
    best = ok.groupBy("name").agg(F.min(F.struct((-F.col("numeric")).alias("k"), "prio", "prop", "total", "n", "people")).alias("b"))
    r = best.select("name", "b.prop", "b.total", F.col("b.n").alias("events"), "b.people").where((F.col("events") >= MONEY_EVENTS) & (F.col("people") > 0) & (F.col("total") > 0))
    return r.select("name", "prop", F.round(F.col("total") / F.col("people"), 6).alias("per_person"), "events", "people")


# fixed values: dimensions to blame in checking order, and other tools' names for them
CAUSE_DIMS = {"browser": ("$browser",), "os": ("$os",), "device": ("$device_type", "$device"), "path": ("$pathname", "$current_url"),
              "country": ("$geoip_country_name", "$geoip_country_code"), "referrer": ("$referring_domain", "$referrer")}
COVERAGE, MIN_SHARE, MAX_SPAN = 0.5, 0.55, 7


def dimension(df: DataFrame, dim: str) -> Column:
    names = (dim, *CAUSE_DIMS[dim])
    return F.coalesce(*[F.when(v.text(df, n) != "", v.text(df, n)) for n in names])


def concentration(df: DataFrame, found: DataFrame, discovered: int = 4) -> DataFrame:
    """(name, day, dim, value, share): the first dimension whose worst value carries most of the loss.

    Equal windows either side of the day; built-in dimensions first, then the event's own text
    properties by coverage, the first ``discovered`` of them.
    """
    d = drop_sampler(df)
    f = found.select("name", "day")
    names = d.join(f.select("name").distinct(), "name", "left_semi")
    edge = names.groupBy("name").agg(F.min(F.unix_micros("timestamp")).alias("lo"), F.max(F.unix_micros("timestamp")).alias("hi"))
    at, dd = F.col("day") * 86_400_000_000, 86_400_000_000
    f = f.join(edge, "name").withColumn("span", F.least(F.floor((at - F.col("lo")) / dd), F.floor((F.col("hi") - at) / dd), F.lit(MAX_SPAN))).where("span > 0").select("name", "day", "span")
    us = F.unix_micros("timestamp")
    inside = (us >= (F.col("day") - F.col("span")) * dd) & (us < (F.col("day") + F.col("span")) * dd)
    rows = names.join(f, "name").where(inside)              # only the comparison windows go on
    builtin = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(x).alias("dim"), dimension(rows, x).alias("value")) for i, x in enumerate(CAUSE_DIMS)])
    b = rows.select("name", "day", us.alias("us"), F.explode(builtin).alias("x")).select("name", "day", "us", "x.*").where("value is not null")
    skip = [c for c in (*CAUSE_DIMS, *[a for al in CAUSE_DIMS.values() for a in al], "span") if c in rows.columns]
    own = property_keys(rows.drop(*skip).withColumn("us", us), keep=("name", "day", "us"))
    own = own.where(F.col("is_text") & (F.col("value") != "") & ~F.startswith("key", F.lit("$")) & ~F.col("key").isin(*CAUSE_DIMS))
    own = own.select("name", "day", "us", F.col("key").alias("dim"), "value")
    total = rows.groupBy("name", "day").agg(F.count("*").alias("rows"))
    cover = own.groupBy("name", "day", "dim").agg(F.count("*").alias("n")).join(total, ["name", "day"]).where(F.col("n") >= F.col("rows") * COVERAGE)
    pick = cover.withColumn("_r", F.row_number().over(W.partitionBy("name", "day").orderBy(F.desc("n"), "dim"))).where(F.col("_r") <= discovered)
    own = own.join(pick.select("name", "day", "dim", (F.col("_r") + len(CAUSE_DIMS)).alias("prio")), ["name", "day", "dim"])
    both = b.select("name", "day", "prio", "dim", "value", "us").unionByName(own.select("name", "day", "prio", "dim", "value", "us"))
    c = both.groupBy("name", "day", "prio", "dim", "value").agg(F.sum(F.when(F.col("us") < at, 1).otherwise(-1)).alias("lost"))
    tot = c.groupBy("name", "day", "prio", "dim").agg(F.sum("lost").alias("net"), F.min(F.struct((-F.col("lost")).alias("l"), "value")).alias("w")).where("net > 0 and w.l < 0")
    tot = tot.withColumn("share", F.least(F.lit(1.0), -F.col("w.l") / F.col("net"))).where(F.col("share") >= MIN_SHARE)
    best = tot.groupBy("name", "day").agg(F.min(F.struct("prio", "dim", F.col("w.value").alias("value"), "share")).alias("b"))
    return best.select("name", "day", "b.dim", "b.value", F.round("b.share", 6).alias("share"))


# ---- deploys -----------------------------------------------------------------------------------
def deploy_impact(series: DataFrame, deploys: DataFrame, window: int = 3, threshold: float = 0.25) -> DataFrame:
    """series(name, day, c) × deploys(deploy, at): mean of the days before against the days from the deploy on."""
    w = W.partitionBy("name").orderBy("day")
    pre, post = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    s = series.select("name", "day", F.avg("c").over(pre).alias("before"), F.count("c").over(pre).alias("nb"), F.avg("c").over(post).alias("after"), F.count("c").over(post).alias("na"))
    d = deploys.select("deploy", "at", F.unix_date(F.to_date("at")).cast("bigint").alias("day"))
    j = s.join(d, "day")                               # equi-join on the deploy's day
    delta = F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before")).when((F.col("before") == 0) & (F.col("after") == 0), 0.0)
    j = j.withColumn("_d", delta)
    direction = (F.when(F.col("before").isNull() | F.col("after").isNull(), "unknown").when(F.col("_d").isNull(), "improvement")
                 .when(F.abs("_d") < threshold, "flat").when(F.col("_d") < 0, "regression").otherwise("improvement"))
    full = (F.col("nb") == window) & (F.col("na") == window)
    return j.select("name", "deploy", "at", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("_d", 6).alias("delta"), direction.alias("direction"),
                    (full & F.coalesce(F.abs("_d") >= threshold, F.lit(False))).alias("significant"))


def headline(impacts: DataFrame) -> DataFrame:
    """Per event: the newest significant regression, else the newest significant change."""
    g = impacts.where("significant").groupBy("name").agg(F.max(F.struct((F.col("direction") == "regression").alias("r"), "at", "deploy", "delta", "direction")).alias("h"))
    return g.select("name", "h.deploy", "h.delta", "h.direction")


def ship_near(df: DataFrame, found: DataFrame, deploys: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """Per finding: the significant deploy within 48 hours of the day with the largest move."""
    d = drop_sampler(df).where(F.col("timestamp") >= lit_ts(asof) - F.expr(f"interval {days} days"))
    imp = deploy_impact(daily_counts(d.join(found.select("name").distinct(), "name", "left_semi")), deploys).where("significant")
    gap = F.abs(F.unix_micros("at") - F.col("day") * 86_400_000_000)
    j = found.select("name", "day").join(imp, "name").where(gap <= 48 * 3_600_000_000)
    best = j.groupBy("name", "day").agg(F.max(F.struct(F.abs("delta").alias("m"), "at", "deploy", "delta")).alias("b"))
    return best.select("name", "day", "b.deploy", "b.delta")


# ---- lost instrumentation ----------------------------------------------------------------------
# fixed values of the tracking-break rule
SILENCE_SHARE, SILENCE_MIN, QUIET_DAYS, MIN_AGE, MAX_AGE, WITNESS_HELD, WITNESS_DAYS, PATH_COVER, PATH_DOMINANT = 0.02, 1.0, 3, 2, 21, 0.9, 14, 0.8, 0.6


def tracking_break(df: DataFrame, found: DataFrame, planned: DataFrame, asof: str) -> DataFrame:
    """Regressions that are lost tracking: planned, silent, of the right age, with a witness that held."""
    d = drop_sampler(df)
    us, now, dd = F.unix_micros("timestamp"), F.unix_micros(lit_ts(asof)), 86_400_000_000
    f = found.where("kind = 'regression'").select("name", "day")
    at = F.col("day") * dd
    path = F.regexp_replace(F.regexp_replace(F.coalesce(dimension(d, "path"), F.lit("")), r"[?#].*$", ""), r"^.*?://[^/]*$|^.*?://[^/]*(?=/)", "")
    slim = d.select("name", us.alias("us"), day_num().alias("d"), path.alias("path")).where(F.col("us") < now)
    mine = slim.join(f, "name")
    before, after = (F.col("us") >= at - WITNESS_DAYS * dd) & (F.col("us") < at), F.col("us") >= at
    own = mine.groupBy("name", "day").agg(F.count(F.when(before, 1)).alias("nb"), F.count(F.when(after, 1)).alias("na"), F.count(F.when(before & (F.col("path") != ""), 1)).alias("np"))
    bmean, amean = F.col("nb") / WITNESS_DAYS, F.col("na") / ((now - at) / dd)
    own = own.withColumn("before", bmean).withColumn("after", amean).withColumn("floor", F.greatest(F.lit(SILENCE_MIN), SILENCE_SHARE * bmean))
    # quiet full days: calendar days of the gap minus the days that were louder than the floor
    loud = mine.where(after).groupBy("name", "day", "d").agg(F.count("*").alias("c")).join(own.select("name", "day", "floor"), ["name", "day"])
    loud = loud.where((F.col("c") > F.col("floor")) & (F.col("d") < _d(asof))).groupBy("name", "day").agg(F.count("*").alias("loud"))
    own = own.join(loud, ["name", "day"], "left").withColumn("quiet", _d(asof) - F.col("day") - F.coalesce("loud", F.lit(0)))
    # witnesses: views of the event's dominant page, else every other event
    pc = mine.where(before & (F.col("path") != "")).groupBy("name", "day", "path").agg(F.count("*").alias("n"))
    dom = pc.groupBy("name", "day").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("p"))
    dom = own.select("name", "day", "nb", "np").join(dom, ["name", "day"]).where((F.col("np") >= F.col("nb") * PATH_COVER) & (-F.col("p.n") >= F.col("nb") * PATH_DOMINANT)).select("name", "day", F.col("p.path").alias("path"))
    pv = slim.where("name = '$pageview'").drop("name").join(dom, "path").groupBy("name", "day").agg(
        (F.count(F.when(before, 1)) / WITNESS_DAYS).alias("wb"), (F.count(F.when(after, 1)) / F.max((now - at) / dd)).alias("wa"))
    # all events per (finding day) once, minus the event's own
    per_us = slim.select("us")
    days = f.select("day").distinct()
    totals = days.join(per_us.groupBy(F.floor(F.col("us") / dd).alias("d")).agg(F.count("*").alias("c")), F.col("d") >= F.col("day") - WITNESS_DAYS)
    totals = totals.groupBy("day").agg(F.sum(F.when(F.col("d") < F.col("day"), F.col("c")).otherwise(0)).alias("tb"), F.sum(F.when(F.col("d") >= F.col("day"), F.col("c")).otherwise(0)).alias("ta"))
    j = own.join(totals, "day").join(pv, ["name", "day"], "left").join(planned.select(F.col("event").alias("name"), F.lit(True).alias("_plan")), "name", "left")
    use_pv = F.coalesce(F.col("wb") >= MIN_DAILY, F.lit(False))
    wb = F.when(use_pv, F.col("wb")).otherwise((F.col("tb") - F.col("nb")) / WITNESS_DAYS)
    wa = F.when(use_pv, F.col("wa")).otherwise((F.col("ta") - F.col("na")) / ((now - at) / dd))
    age = F.floor((now - at) / dd)
    verdict = (F.when(F.col("_plan").isNull(), "not_planned").when(F.col("after") > F.col("floor"), "still_arriving").when(age < MIN_AGE, "too_fresh").when(age > MAX_AGE, "too_old")
               .when(F.col("quiet") < QUIET_DAYS, "not_quiet_long").when(wb < MIN_DAILY, "no_witness").when(wa < wb * WITNESS_HELD, "witness_fell").otherwise("tracking_broke"))
    return j.select("name", "day", verdict.alias("verdict"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "quiet",
                    F.when(use_pv, "page").otherwise("other_events").alias("witness"), F.round(wb, 6).alias("witness_before"), F.round(wa, 6).alias("witness_after"))


# ---- ranked investigation and replay -----------------------------------------------------------
def investigate(df: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """Findings with money, recovery and cause, ranked: open first, then money, then urgency, then size."""
    f = materialize(findings(df, asof, days))        # a handful of rows, used four times
    prod = drop_sampler(df)
    j = f.join(revenue_per_person(df, asof, days).select("name", "per_person"), "name", "left").join(recovery(prod, asof, f).select("name", "day", "recovered"), ["name", "day"], "left")
    j = j.join(concentration(df, f), ["name", "day"], "left")
    usd = F.coalesce(stats.round_to(F.col("per_person") * F.col("people"), 2), F.lit(0.0))
    rec = F.coalesce("recovered", F.lit(False))
    j = j.select("name", day_text(F.col("day")).alias("day"), "kind", "before", "after", "pct", "people", usd.alias("usd_per_month"), rec.alias("recovered"),
                 ((F.col("kind") == "regression") & ~rec).alias("needs_you"), F.coalesce("dim", F.lit("")).alias("cause_dim"), F.coalesce("value", F.lit("")).alias("cause_value"), F.coalesce("share", F.lit(0.0)).alias("cause_share"))
    order = W.partitionBy(F.lit(0)).orderBy("recovered", F.desc("usd_per_month"), F.desc("needs_you"), F.desc("people"), "name")   # a handful of findings
    return j.withColumn("rank", F.row_number().over(order).cast("bigint"))


def backtest(df: DataFrame, asof: str, window_days: int = 90, step_days: int = 1, days: int = 30) -> DataFrame:
    """What each day's pass would have found: (kind, name, day, first_seen, lag_days, people).

    As-of dates (day starts) multiply the daily counts, never the events; each as-of sees only
    earlier days, and a change is reported at the first as-of that finds it.
    """
    d = product_events(df)
    c = daily_counts(d if is_user_day(df) else d.where(F.col("timestamp") < lit_ts(asof)))
    end = _d(asof)
    # each daily count is visible to the as-of dates of the following ``days`` days
    reach = F.sequence(F.greatest(F.col("day") + 1, end - window_days), F.least(F.col("day") + days - 1, end))
    c = c.where((F.col("day") + 1 <= end) & (F.col("day") + days - 1 >= end - window_days)).select("name", "day", "c", F.explode(reach).alias("asof_day")).where((F.col("asof_day") - (end - window_days)) % step_days == 0)
    span = c.groupBy("asof_day", "name").agg(F.min("day").alias("a"))
    grid = span.select("asof_day", "name", F.explode(F.sequence("a", "asof_day")).alias("day"))
    s = grid.join(c, ["asof_day", "name", "day"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    f = _judge(step_change(s, ("asof_day", "name")), ("asof_day", "name"))
    g = f.groupBy("kind", "name", "day").agg(F.min(F.struct("asof_day", "people")).alias("m"))
    return g.select("kind", "name", day_text(F.col("day")).alias("day"), day_text(F.col("m.asof_day")).alias("first_seen"),
                    (F.col("m.asof_day") - F.col("day")).alias("lag_days"), F.col("m.people").alias("people"))


# ---- movements ---------------------------------------------------------------------------------
def movements(df: DataFrame, asof: str, days: int = 90, min_people: int = 30, q: float = 0.05) -> DataFrame:
    """Share of active people doing each event, first against second half-window, tested and corrected."""
    from eventloom.operators.experiments import benjamini_hochberg
    d = drop_sampler(df)
    t, end = F.col("timestamp"), lit_ts(asof)
    mid = end - F.expr(f"interval {days // 2} days")
    d = d.where((t >= end - F.expr(f"interval {days} days")) & (t < end)).select("name", "distinct_id", (t >= mid).alias("late"))
    per = d.groupBy("name", "distinct_id").agg(F.max((~F.col("late")).cast("int")).alias("a"), F.max(F.col("late").cast("int")).alias("b"))
    active = per.groupBy("distinct_id").agg(F.max("a").alias("a"), F.max("b").alias("b")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    m = attach_row(per.where(~F.startswith("name", F.lit("$"))).groupBy("name").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb")), active)
    pct = lambda c, n: F.when(F.col(n) > 0, F.floor(F.col(c) * 1000 / F.col(n) + 0.5) / 10).otherwise(F.lit(0.0))
    z = stats.pooled_z(F.col("cb"), F.col("nb"), F.col("ca"), F.col("na"))
    p = F.coalesce(stats.normal_two_sided(F.coalesce("z", F.lit(0.0))), F.lit(1.0))
    m = m.withColumn("before", pct("ca", "na")).withColumn("after", pct("cb", "nb")).withColumn("z", z).withColumn("p", F.floor(p * 1000 + 0.5) / 1000)
    thin = (F.col("na") < min_people) | (F.col("nb") < min_people)
    first = F.when(thin, "cannot_tell").when(p >= q, "unchanged").when(F.col("after") > F.col("before"), "moved_up").otherwise("moved_down")
    m = m.withColumn("_v", first)
    h = m.where(F.col("_v").startswith("moved")).select(F.lit("movements").alias("experiment"), F.lit("after").alias("variant"), F.col("name").alias("metric"), "p")
    kept = benjamini_hochberg(h, q).select(F.col("metric").alias("name"), "rejected")
    j = m.join(kept, "name", "left")
    verdict = F.when(F.col("_v").startswith("moved") & ~F.coalesce("rejected", F.lit(True)), "unchanged").otherwise(F.col("_v"))
    return j.select("name", F.col("cb").alias("people"), "before", "after", F.round("z", 6).alias("z"), F.when(~thin, F.col("p")).alias("p"), verdict.alias("verdict"))
