"""The daily digest: anomalies, week over week, the worst drop-off and who to blame for it."""
from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, lit_ts
from eventloom.operators import aicrawl, aivis, funnel, journeys, retention, web
from eventloom.operators.filters import property_keys
from eventloom.operators.scope import drop_sampler

# fixed values: sample floor, baseline days and how many must carry the event, swing, weekly swing
MIN_SAMPLE, BASE_DAYS, MIN_BASE_DAYS, MIN_PER_DAY, SWING, WEEK_SWING = 20, 7, 5, 3, 0.4, 15
FAILURE_EVENTS = ("$deadclick", "$rageclick", "$exception", "$error")
WEEK_S = 7 * 86400


def top_events(df: DataFrame, limit: int = 6) -> DataFrame:
    return df.groupBy("name").agg(F.count("*").alias("volume")).orderBy(F.desc("volume"), "name").limit(limit)


def severity(rose: Column, name: Column) -> Column:
    """A fall warns, except for events that only record a user failing at something."""
    return F.when(rose == name.isin(*FAILURE_EVENTS), "warn").otherwise("info")


def anomaly_candidates(df: DataFrame, asof: str) -> DataFrame:
    """The busiest events' last 24 hours against their own observed baseline days."""
    d = drop_sampler(df)
    t, now = F.col("timestamp"), lit_ts(asof)
    recent = now - F.expr("interval 24 hours")
    w = d.where((t >= now - F.expr(f"interval {24 * (BASE_DAYS + 1)} hours")) & (t <= now))
    back = F.least(F.floor((F.unix_micros(recent) - F.unix_micros(t)) / 86_400_000_000), F.lit(BASE_DAYS - 1))
    s = w.groupBy("name").agg(F.count(F.when(t >= recent, 1)).alias("last24"), F.count(F.when(t < recent, 1)).alias("base"),
                              F.count_distinct(F.when(t < recent, back)).alias("observed"))
    return swings(s.join(F.broadcast(top_events(d)), "name"))


def swings(s: DataFrame) -> DataFrame:
    """Adds ``daily`` and ``dev`` to events with ``last24``, ``base`` and ``observed`` that have enough of a baseline."""
    j = s.where(F.col("observed") >= MIN_BASE_DAYS)
    j = j.withColumn("daily", F.col("base") / F.col("observed")).where((F.col("base") >= MIN_SAMPLE) & (F.col("daily") >= MIN_PER_DAY))
    return j.withColumn("dev", (F.col("last24") - F.col("daily")) / F.col("daily"))


def anomaly(df: DataFrame, asof: str) -> DataFrame:
    """The single sharpest swing, if any reaches 40 percent."""
    c = anomaly_candidates(df, asof).where(F.abs("dev") >= SWING)
    best = c.orderBy(F.desc(F.abs("dev")), F.desc("volume"), "name").limit(1)
    pct = F.round(F.abs(F.col("dev")) * 100, 0).cast("bigint")
    return best.select(F.col("name").alias("metric"), severity(F.col("dev") > 0, F.col("name")).alias("severity"),
                       F.when(F.col("dev") > 0, pct).otherwise(-pct).alias("rate"), F.col("base").alias("n"), "last24", F.round("daily", 6).alias("daily"))


def alert_anomaly(df: DataFrame, asof: str) -> DataFrame:
    """One row: an alert fires only on a warning."""
    w = anomaly(df, asof).where("severity = 'warn'")
    return w.agg(F.coalesce(F.max("rate"), F.lit(0)).cast("double").alias("value"), (F.count("*") > 0).alias("met"))


def week_over_week(df: DataFrame, asof: str, head: str = "signup") -> DataFrame:
    """The headline event's last 7 days against the 7 before; the busiest event when ``head`` never fired."""
    d = drop_sampler(df)
    names = d.groupBy("name").agg(F.count("*").alias("volume"))
    pick = names.agg(F.max(F.struct((F.col("name") == head).cast("int").alias("h"), "volume", "name"))["name"].alias("_head"))
    age = F.unix_micros(lit_ts(asof)) - F.unix_micros("timestamp")
    week = 7 * 86_400_000_000
    r = attach_row(d.where((age >= 0) & (age < 2 * week)), pick).where("name = _head")
    a = r.groupBy("name").agg(F.count(F.when(age < week, 1)).alias("current"), F.count(F.when(age >= week, 1)).alias("previous")).where(F.col("previous") >= MIN_SAMPLE)
    change = F.round((F.col("current") - F.col("previous")) / F.col("previous") * 100, 0).cast("bigint")
    sev = F.when((severity(change > 0, F.col("name")) == "warn") & (F.abs(change) >= WEEK_SWING), "warn").otherwise("info")
    return a.select(F.col("name").alias("metric"), sev.alias("severity"), change.alias("rate"), F.col("previous").alias("n"), "current")


def journey_steps(df: DataFrame) -> list[str]:
    """The funnel the digest describes: the conventional names when all exist, else the detected journey.

    At most four names come back to the driver.
    """
    usual = ["signup", "activate", "checkout"]
    have = {r[0] for r in df.where(F.col("name").isin(*usual)).select("name").distinct().collect()}
    if have == set(usual):
        return usual
    return [r["event"] for r in journeys.detect(df).orderBy("step").collect()]


def worst_dropoff(df: DataFrame, steps, window_s: float = WEEK_S, order: str = "ordered") -> DataFrame:
    """The step with the largest absolute loss among steps at least 20 people entered."""
    t = funnel.funnel(df, steps, window_s, order)
    names = F.array(*[F.lit(s.event) for s in funnel.steps_of(*steps)])
    c = t.where((F.col("step") > 1) & (F.col("users") + F.col("dropped") >= MIN_SAMPLE) & (F.col("dropped") > 0))
    best = c.agg(F.min(F.struct((-F.col("dropped")).alias("d"), "step", "event", "users", "dropped")).alias("b")).where("b is not null")
    return best.select(F.element_at(names, (F.col("b.step") - 1).cast("int")).alias("from_step"), F.col("b.event").alias("to_step"),
                       v.pct(F.col("b.users"), F.col("b.users") + F.col("b.dropped")).alias("rate"), (F.col("b.users") + F.col("b.dropped")).alias("n"), F.col("b.dropped").alias("dropped"))


# fixed values: properties tried first, acquisition attributes read by first touch, blame ratio, coverage, values
BLAME_PROPS = ("source", "plan", "platform", "device", "channel", "country", "browser")
BLAME_TOUCH = ("source", "channel", "device", "country", "browser", "platform", "os", "referrer")
BLAME_RATIO, BLAME_COVER = 0.7, 0.6


def segment_blame(df: DataFrame, steps, from_idx: int, window_s: float = WEEK_S, most_values: int | None = 10) -> DataFrame:
    """The property value converting at under 70 percent of the overall rate through one funnel step.

    A property is considered if it has two to ``most_values`` (None: any number of) values on the step.

    The funnel runs once; every usable property is an extra key on its per-person outcomes.
    """
    d = drop_sampler(df)
    steps = funnel.steps_of(*steps)
    people = funnel.outcomes(d, steps, window_s)
    touch_kv = property_keys(d, keep=("distinct_id", "timestamp", "id")).where("value <> ''")
    val = F.when(F.col("key") == "referrer", v.host(F.col("value"))).otherwise(F.col("value"))
    touch = touch_kv.groupBy("distinct_id", "key").agg(F.min(F.struct("timestamp", "id", val.alias("value")))["value"].alias("value"))
    # a property is usable on the blamed step when it covers it and has 2 to 10 values there
    frm = d.where(F.col("name") == steps[from_idx].event)
    total = frm.agg(F.count("*").alias("_all"))
    native = property_keys(frm.drop(*[p for p in BLAME_TOUCH if p in frm.columns])).where(~F.col("key").isin(*BLAME_TOUCH)).select("key", "value")
    per_user = frm.groupBy("distinct_id").agg(F.count("*").alias("w"))
    stamped = per_user.join(touch.where(F.col("key").isin(*BLAME_TOUCH)), "distinct_id").groupBy("key", "value").agg(F.sum("w").alias("n"))
    seen = native.groupBy("key", "value").agg(F.count("*").alias("n")).unionByName(stamped)
    use = attach_row(seen.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("k")), total)
    use = use.where((F.col("n") * 10 >= F.col("_all") * BLAME_COVER * 10) & (F.col("k") >= 2) & (F.lit(True) if most_values is None else F.col("k") <= most_values)).select("key")
    reach = lambda i: F.count(F.when(F.col("reached") > i, 1))
    g = touch.join(use, "key", "left_semi").join(people, "distinct_id").groupBy("key", "value").agg(reach(from_idx).alias("entered"), reach(from_idx + 1).alias("done"))
    base = people.agg(reach(from_idx).alias("_e"), reach(from_idx + 1).alias("_d"))
    g = attach_row(g, base).where((F.col("_e") >= MIN_SAMPLE) & (F.col("_d") > 0) & (F.col("entered") >= MIN_SAMPLE))
    rate = F.col("done") / F.col("entered")
    prio = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in BLAME_PROPS]), F.col("key")), F.lit(0))
    c = g.withColumn("r", rate).where(F.col("r") < BLAME_RATIO * F.col("_d") / F.col("_e"))
    best = c.agg(F.min(F.struct("r", F.when(prio == 0, 99).otherwise(prio).alias("p"), "key", (-F.col("entered")).alias("e"), "value", "entered", "_d", "_e")).alias("b")).where("b is not null")
    half = lambda x: F.floor(x * 100 + 0.5).cast("bigint")
    return best.select(F.col("b.key").alias("prop"), F.col("b.value").alias("value"), half(F.col("b.r")).alias("rate"), F.col("b.entered").alias("n"),
                       half(F.col("b._d") / F.col("b._e")).alias("overall"))


def retention_read(df: DataFrame, asof: str) -> DataFrame:
    """Day-1 retention of elapsed cohorts; a note, not a number, when nothing ever identified a person."""
    s = retention.summary(df, asof, 7).where("n = 1 and cohort_users >= %d" % MIN_SAMPLE)
    known = df.agg(F.coalesce(F.max((F.col("name") == "$identify").cast("int")), F.lit(0)).alias("_id"))
    s = attach_row(s, known)
    sev = F.when(F.col("_id") == 0, "note").when(F.col("pct") < 20, "warn").otherwise("info")
    return s.select(F.lit("day1").alias("metric"), sev.alias("severity"), F.when(F.col("_id") == 1, F.col("pct")).otherwise(F.lit(0)).alias("rate"), F.col("cohort_users").alias("n"))


def notable(df: DataFrame, asof: str, steps=None) -> DataFrame:
    """Every digest finding, warnings first: (kind, severity, metric, rate, n)."""
    prod = drop_sampler(df)
    steps = steps or journey_steps(prod)
    row = lambda d, kind, pos: d.select(F.lit(kind).alias("kind"), "severity", F.col("metric").cast("string").alias("metric"),
                                        F.col("rate").cast("bigint").alias("rate"), F.col("n").cast("bigint").alias("n"), F.lit(pos).alias("_pos"))
    parts = [row(anomaly(df, asof), "anomaly", 0),
             row(aicrawl.site_readability(df, asof).withColumn("rate", F.col("words")).withColumn("n", F.lit(0)), "readable", 1),
             row(aicrawl.findings(df, asof).withColumnRenamed("subject", "metric"), "crawl", 2),
             row(aivis.shift(df, asof).select("severity", F.col("engine").alias("metric"), F.col("current_pct").alias("rate"), F.col("runs").alias("n")), "ai_visibility", 3),
             row(aivis.cited_not_recommended(df, asof), "ai_visibility", 3),
             row(week_over_week(df, asof), "trend", 6), row(retention_read(prod, asof), "retention", 7)]
    if len(steps) >= 2:
        drop = worst_dropoff(df, steps)
        auto = all(s.event.startswith("$") for s in funnel.steps_of(*steps))
        parts.append(row(drop.withColumn("severity", F.lit("note" if auto else "warn")).withColumn("metric", F.col("to_step")), "dropoff", 5))
        if not auto:
            first = drop.select("from_step").collect()       # one row
            if first:
                i = [s.event for s in funnel.steps_of(*steps)].index(first[0][0])
                b = segment_blame(df, steps, i)
                parts.append(row(b.withColumn("severity", F.lit("warn")).withColumn("metric", F.concat("prop", F.lit("="), "value")), "segment", 4))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.orderBy(F.when(F.col("severity") == "warn", 0).otherwise(1), "_pos", "metric").drop("_pos")


def fix_evidence(df: DataFrame, steps, asof: str) -> DataFrame:
    """Evidence rows for the drop-off finding: funnel rows, where visits end, and the metric to accept by."""
    t = funnel.funnel(df, steps, WEEK_S)
    ev = t.select(F.lit("evidence").alias("section"), F.concat(F.lpad(F.col("step").cast("string"), 2, "0"), F.lit(" "), "event").alias("label"),
                  F.floor(F.col("from_prev") * 100 + 0.5).cast("bigint").alias("value"), (F.col("users") + F.col("dropped")).alias("n"))
    start = str(dt.datetime.fromisoformat(asof) - dt.timedelta(days=30))
    exits = web.entry_exit(df, start, asof).where("dim = 'exit'").orderBy(F.desc("sessions"), "value").limit(5)
    where = exits.select(F.lit("where").alias("section"), F.col("value").alias("label"), F.col("sessions").alias("value"), F.col("recorded").alias("n"))
    acc = worst_dropoff(df, steps).select(F.lit("acceptance").alias("section"), F.concat("from_step", F.lit(" -> "), "to_step").alias("label"), F.col("rate").alias("value"), "n")
    return ev.unionByName(where).unionByName(acc)
