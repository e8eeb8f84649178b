"""Alerts, evidence behind numbers, tracking-plan health, change records and receipts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, lit_ts
from eventloom.operators.filters import property_keys
from eventloom.operators.search import round1

# ---- alerts ----------------------------------------------------------------------------------
ALERT_DDL = "id string, kind string, event string, against string, op string, threshold double, window_hours int"


def _windowed(df: DataFrame, alerts: DataFrame, asof: str) -> DataFrame:
    """Per alert: the event's count in the window, in the window before, and the other event's count.

    Alerts meet events by name (an equi-join), so one scan serves every alert.
    """
    need = alerts.select("id", "window_hours", F.explode(F.array_distinct(F.array("event", F.coalesce("against", "event")))).alias("name"), "event", "against")
    span = F.col("window_hours") * F.expr("interval 1 hour")
    e = df.select("name", "timestamp").where(F.col("timestamp") < lit_ts(asof))
    j = e.join(need, "name").where(F.col("timestamp") >= lit_ts(asof) - span * 2)
    cur = F.col("timestamp") >= lit_ts(asof) - span
    own, other = F.col("name") == F.col("event"), F.col("name") == F.col("against")
    c = j.groupBy("id").agg(F.count(F.when(cur & own, 1)).alias("cur"), F.count(F.when(~cur & own, 1)).alias("prev"),
                            F.count(F.when(cur & other, 1)).alias("den"))
    z = F.lit(0).cast("bigint")
    return alerts.join(c, "id", "left").withColumns({k: F.coalesce(k, z) for k in ("cur", "prev", "den")})


def evaluate_alerts(df: DataFrame, alerts: DataFrame, asof: str) -> DataFrame:
    """(id, kind, value, met, change_pct) for count, relative and ratio alerts."""
    w = _windowed(df, alerts.where(F.col("kind").isin("count", "relative", "ratio")), asof)
    return judged_alerts(w).select("id", "kind", "value", "met", "change_pct")


def judged_alerts(w: DataFrame) -> DataFrame:
    """Adds ``value``, ``met`` and ``change_pct`` to alerts with their counts ``cur``, ``prev`` and ``den``."""
    gt, th = F.col("op") == "gt", F.col("threshold")
    change = F.when(F.col("prev") > 0, (F.col("cur") - F.col("prev")) / F.col("prev") * 100)
    share = F.when(F.col("den") > 0, F.col("cur") / F.col("den") * 100)
    beyond = lambda x: F.coalesce(F.when(gt, x > th).when(F.col("op") == "lt", x < th), F.lit(False))
    rel = F.coalesce(F.when(gt, change >= th).when(F.col("op") == "lt", change <= -th), F.lit(False))
    kind = F.col("kind")
    return w.select("*", F.round(F.when(kind == "ratio", F.coalesce(share, F.lit(0.0))).otherwise(F.col("cur").cast("double")), 6).alias("value"),
                    F.when(kind == "relative", rel).when(kind == "ratio", beyond(share)).otherwise(beyond(F.col("cur").cast("double"))).alias("met"),
                    F.round(change, 6).alias("change_pct"))


# ---- evidence --------------------------------------------------------------------------------
def row_digest(df: DataFrame) -> DataFrame:
    """One row: total, people, and an order-free content digest of (id, name, distinct_id, timestamp).

    Per-row SHA-256 prefixes are summed exactly, so the digest needs no global order and no task
    ever holds the matched rows; it changes whenever the set of rows changes.
    """
    line = F.concat_ws("\x00", "id", "name", "distinct_id", F.unix_micros("timestamp").cast("string"))
    piece = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("total"), F.count_distinct("distinct_id").alias("users"),
                  F.coalesce(F.sum(piece), F.lit(0)).cast("string").alias("digest"))


def rows_behind(df: DataFrame, match: Column, claimed: float | None = None, unique: bool = False, limit: int = 500) -> DataFrame:
    """The first ``limit`` matching rows in (timestamp, id, name) order, with the proof beside them."""
    m = df.where(match)
    proof = row_digest(m)
    got = (F.col("users") if unique else F.col("total")).cast("double")
    proof = proof.withColumn("recomputed", got).withColumn("matches", F.abs(got - F.lit(claimed if claimed is not None else 0.0)) < 1e-6
                                                           if claimed is not None else F.lit(True))
    listing = m.orderBy("timestamp", "id", "name").limit(limit).select("id", "name", "distinct_id", F.unix_micros("timestamp").alias("us"))
    return attach_row(listing, proof)


def who_behind(df: DataFrame, match: Column, limit: int = 200) -> DataFrame:
    """People with matching events, last seen first, with the uncut total."""
    g = df.where(match).groupBy("distinct_id").agg(F.count("*").alias("events"), F.max("timestamp").alias("last"))
    top = g.orderBy(F.desc("last"), "distinct_id").limit(limit)
    return attach_row(top.select("distinct_id", "events", F.unix_micros("last").alias("last_us")), g.agg(F.count("*").alias("total_users")))


# ---- tracking plan ---------------------------------------------------------------------------
def instrumentation_health(df: DataFrame, plan: DataFrame) -> DataFrame:
    """plan(event, properties[]) against what arrives: MISSING, flowing, missing properties, unplanned."""
    seen = df.groupBy("name").agg(F.count("*").alias("count"), F.max("timestamp").alias("last"))
    keys = property_keys(df, keep=("name",)).select("name", "key").distinct()
    want = plan.select("event", F.explode_outer("properties").alias("key"))
    lost = (want.join(keys, (want["event"] == keys["name"]) & (want["key"] == keys["key"]), "left_anti").where("key is not null")
            .groupBy("event").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("missing")))
    j = plan.select("event").join(seen.withColumnRenamed("name", "event"), "event", "full").join(lost, "event", "left")
    j = j.join(plan.select("event", F.lit(True).alias("_p")), "event", "left")
    planned = F.col("_p").isNotNull()
    out = j.where(planned | ~F.startswith("event", F.lit("$")))
    status = F.when(~planned, "unplanned").when(F.col("count").isNull(), "MISSING").otherwise("flowing")
    return out.select("event", status.alias("status"), F.coalesce("count", F.lit(0)).alias("count"),
                      F.when(status == "flowing", F.coalesce("missing", F.lit(""))).otherwise(F.lit("")).alias("missing_properties"))


# ---- change records --------------------------------------------------------------------------
# fixed values: what marks a change as non-product, as a chore, or as user-facing
NON_PRODUCT = (r"(?i)^\.github/", r"(?i)(^|/)(docs?|examples?|fixtures?|testdata)/", r"(?i)\.(md|mdx|txt|lock|sum|mod)$",
               r"(?i)_test\.(go|ts|tsx|js|jsx|py|rb)$", r"(?i)(^|/)(test|tests|spec|__tests__)/",
               r"(?i)(^|/)(Dockerfile|Makefile|\.gitignore|\.editorconfig)$", r"(?i)\.(yml|yaml|toml|ini|cfg)$")
CHORE_TITLE = r"(?i)^\s*(chore|build|ci|docs|test|refactor|style|revert|deps|bump)(\(|:|\s)"
CHORE_WORDS = r"(?i)\b(bump|upgrade|downgrade|dependabot|renovate|typo|lint|format|rename|move|extract|cleanup|clean up|dead code)\b"
USER_FACING = r"(?i)\b(onboard|signup|sign-up|checkout|paywall|pricing|upgrade|trial|cta|button|banner|modal|flow|funnel|conversion|activation|retention|nudge|prompt|empty state|landing)\b"


def claim_verdicts(prs: DataFrame) -> DataFrame:
    """prs(pr, title, body, files[], instrumented[], events[]) → (pr, verdict, metric)."""
    def product(f: Column) -> Column:
        out = F.lit(True)
        for p in NON_PRODUCT:
            out = out & ~f.rlike(p)
        return out
    said = F.concat("title", F.lit("\n"), "body")
    verdict = (F.when(F.col("title").rlike(CHORE_TITLE), "no_measurable_intent")
               .when((F.size("files") > 0) & ~F.exists("files", product), "no_measurable_intent")
               .when(F.size("events") > 0, "claimable").when(F.size("instrumented") > 0, "touches_instrumented")
               .when(said.rlike(CHORE_WORDS), "no_measurable_intent").when(said.rlike(USER_FACING), "unclear").otherwise("no_measurable_intent"))
    d = prs.select("pr", verdict.alias("verdict"), "events")
    return d.select("pr", "verdict", F.when(F.col("verdict") == "claimable", F.col("events")[0]).otherwise(F.lit("")).alias("metric"))


def claim_yield(prs: DataFrame) -> DataFrame:
    kinds = ("claimable", "touches_instrumented", "unclear", "no_measurable_intent")
    a = claim_verdicts(prs).agg(F.count("*").alias("total"), *[F.count(F.when(F.col("verdict") == k, 1)).alias(k) for k in kinds])
    n = F.col("total")
    share = lambda x: F.when(n > 0, round1(x * 100 / n)).otherwise(F.lit(0.0))
    broad = F.col("claimable") + F.col("touches_instrumented")
    return a.select("*", share(F.col("claimable")).alias("strict_pct"), share(broad).alias("broad_pct"), share(broad + F.col("unclear")).alias("ceiling_pct"))


# ---- receipts --------------------------------------------------------------------------------
REVERTED, PR_OPENED = "$experiment_reverted", "$tracking_pr_opened"


def action_log(df: DataFrame, asof: str, days: int = 30, limit: int | None = 10) -> DataFrame:
    """The ``limit`` (None: all) newest receipts of automatic acts: reverts naming a flag, tracking fixes with a link."""
    d = df.where(F.col("name").isin(REVERTED, PR_OPENED) & (F.col("timestamp") >= lit_ts(asof) - F.expr(f"interval {days} days")))
    txt = lambda k: F.trim(F.coalesce(v.text(d, k), F.lit("")))
    rev = F.col("name") == REVERTED
    ok = F.when(rev, txt("flag") != "").otherwise((txt("event") != "") & txt("pr_url").rlike("^https?://"))
    rows = d.where(ok).select("id", F.when(rev, "guardrail_revert").otherwise("tracking_pr").alias("kind"), F.when(rev, txt("flag")).otherwise(txt("event")).alias("subject"),
                              F.when(rev, txt("guardrail")).otherwise(txt("pr_url")).alias("detail"), F.unix_micros("timestamp").alias("us"))
    return rows if limit is None else rows.orderBy(F.desc("us"), "id").limit(limit)
