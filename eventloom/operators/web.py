"""Web analytics: pages, first-touch dimensions, entries and exits, engagement, channels, one-page stats."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, between, lit_ts
from eventloom.operators import identity

PAGEVIEW = "$pageview"
# fixed values: AI assistants people click out of
AI_HOSTS = ("chatgpt.com", "chat.openai.com", "claude.ai", "perplexity.ai", "gemini.google.com",
            "copilot.microsoft.com", "you.com", "poe.com", "phind.com", "kagi.com")
# fixed values: visitor dimensions and how many rows each list shows
FIRST_TOUCH_DIMS = {"referrer": 10, "utm_source": 10, "utm_medium": 10, "utm_campaign": 10, "device": 4,
                    "browser": 8, "os": 8, "country": 10}


def calendar_days(days: int, asof: str) -> tuple[str, str]:
    """[start of the day N-1 days back, asof): today so far plus N-1 whole days."""
    end = dt.datetime.fromisoformat(asof)
    start = dt.datetime(end.year, end.month, end.day) - dt.timedelta(days=days - 1)
    return str(start), str(end)


def pageviews(df: DataFrame, start=None, end=None) -> DataFrame:
    return between(df, start, end).where(F.col("name") == PAGEVIEW)


def overview(df: DataFrame, start, end) -> DataFrame:
    d = pageviews(df, start, end)
    days = F.greatest(F.lit(1), F.ceil((F.unix_micros(lit_ts(end)) - F.unix_micros(lit_ts(start))) / 86_400_000_000))
    return d.agg(F.count("*").alias("pageviews"), F.count_distinct("distinct_id").alias("visitors")).withColumn("period_days", days)


def top(df: DataFrame, prop: str, start, end, limit: int = 10) -> DataFrame:
    """Pageviews and visitors per page (or title)."""
    d = pageviews(df, start, end)
    val = v.text(d, prop)
    g = d.where(val != "").groupBy(val.alias("value")).agg(F.count("*").alias("count"), F.count_distinct("distinct_id").alias("visitors"))
    return g.orderBy(F.desc("count"), "value").limit(limit)


def _first_pageview(df: DataFrame, start, end) -> DataFrame:
    """One row per visitor: every dimension of the earliest pageview, from one aggregate."""
    d = pageviews(df, start, end)
    host = v.referrer_host(v.text(d, "referrer"))
    dims = [(host if p == "referrer" else v.text(d, p)).alias(p) for p in FIRST_TOUCH_DIMS]
    first = d.groupBy("distinct_id").agg(F.min(F.struct("timestamp", "id", *dims)).alias("f"))
    return first.select("distinct_id", *[F.col(f"f.{p}").alias(p) for p in FIRST_TOUCH_DIMS])


def first_touch_dims(df: DataFrame, start, end) -> DataFrame:
    """(dim, value, visitors, recorded): each visitor once per dimension; recorded is the uncut total."""
    f = _first_pageview(df, start, end)
    cells = F.array(*[F.struct(F.lit(p).alias("dim"), F.col(p).alias("value")) for p in FIRST_TOUCH_DIMS])
    g = (f.select(F.explode(cells).alias("x")).select("x.*").where("value <> ''")
         .groupBy("dim", "value").agg(F.count("*").alias("visitors")))
    return ranked(g, "dim", "visitors", FIRST_TOUCH_DIMS)


def ranked(g: DataFrame, dim: str, count: str, limits: dict) -> DataFrame:
    """Top rows per dimension with the untruncated total beside them.

    The total is an aggregate joined back and the rank is bounded, so a dimension with very many
    values is limited before its rows meet in one task.
    """
    total = g.groupBy(dim).agg(F.sum(count).alias("recorded"))
    lim = F.element_at(F.create_map(*[x for k, n in limits.items() for x in (F.lit(k), F.lit(n))]), F.col(dim))
    rn = F.row_number().over(W.partitionBy(dim).orderBy(F.desc(count), "value"))
    t = g.withColumn("_rn", rn).where(F.col("_rn") <= max(limits.values())).where(F.col("_rn") <= lim)
    return t.join(total, dim).drop("_rn")


def entry_exit(df: DataFrame, start, end, limit: int = 10) -> DataFrame:
    """(dim, value, sessions, visitors, recorded): first and last page of each session."""
    d = pageviews(df, start, end)
    sess = v.text(d, "session_id")
    key = F.when(sess != "", sess).otherwise(F.concat("distinct_id", F.lit("·"), F.date_format("timestamp", "yyyy-MM-dd")))
    at = F.struct("timestamp", "id", F.coalesce(v.text(d, "path"), F.lit("")).alias("path"), "distinct_id")
    s = d.groupBy(key.alias("s")).agg(F.min(at).alias("entry"), F.max(at).alias("exit"))
    cells = F.array(*[F.struct(F.lit(x).alias("dim"), F.col(f"{x}.path").alias("value"), F.col(f"{x}.distinct_id").alias("u"))
                      for x in ("entry", "exit")])
    g = (s.select(F.explode(cells).alias("x")).select("x.*").where("value <> ''").groupBy("dim", "value")
         .agg(F.count("*").alias("sessions"), F.count_distinct("u").alias("visitors")))
    return ranked(g, "dim", "sessions", {"entry": limit, "exit": limit})


def recorded_totals(df: DataFrame, start, end) -> DataFrame:
    """(dim, recorded) behind every ranked list, before any cut."""
    f = _first_pageview(df, start, end)
    n = f.agg(*[F.count(F.when(F.col(p) != "", 1)).alias(p) for p in FIRST_TOUCH_DIMS])
    d = pageviews(df, start, end)
    pages = d.agg(*[F.count(F.when(v.text(d, p) != "", 1)).alias(p) for p in ("path", "title")])
    rows = lambda t, cols: t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("recorded"))
                                                        for c in cols])).alias("x")).select("x.*")
    return rows(n, FIRST_TOUCH_DIMS).unionByName(rows(pages, ("path", "title")))


def engagement(df: DataFrame, start, end) -> DataFrame:
    """Mean engaged seconds per engaged visitor, and bounce: one pageview and under ten engaged seconds."""
    d = between(df, start, end).where(F.col("name").isin(PAGEVIEW, "$engagement"))
    ms = v.num_strict(d, "engaged_ms")
    u = d.groupBy("distinct_id").agg(
        F.sum(F.when((F.col("name") == "$engagement") & (ms > 0), ms)).alias("ms"),
        F.count(F.when(F.col("name") == PAGEVIEW, 1)).alias("pv"))
    bounced = (F.col("pv") == 1) & (F.coalesce("ms", F.lit(0.0)) < 10_000)
    a = u.agg(F.count("ms").alias("engaged"), F.sum("ms").alias("total"), F.count(F.when(F.col("pv") > 0, 1)).alias("n"),
              F.count(F.when(bounced, 1)).alias("b"))
    return a.where("engaged > 0").select(F.floor(F.col("total") / F.col("engaged") / 1000).alias("avg_engaged_secs"),
                                         v.pct(F.col("b"), F.col("n")).alias("bounce_rate_pct"))


def live_now(df: DataFrame, asof: str, start=None, end=None) -> DataFrame:
    """Distinct visitors of the five minutes up to ``asof``, within the selected window."""
    d = pageviews(df, start, end)
    t = F.col("timestamp")
    return d.where((t >= lit_ts(asof) - F.expr("interval 5 minutes")) & (t <= lit_ts(asof))).agg(
        F.count_distinct("distinct_id").alias("live"))


def ai_referrals(df: DataFrame, start, end, limit: int = 6) -> DataFrame:
    """Visitors whose first pageview came from an AI assistant, by host."""
    f = _first_pageview(df, start, end)
    utm = v.referrer_host(F.col("utm_source"))
    host = F.when(F.col("referrer").isin(*AI_HOSTS), F.col("referrer")).when(utm.isin(*AI_HOSTS), utm)
    g = f.where(host.isNotNull()).groupBy(host.alias("value")).agg(F.count("*").alias("visitors"))
    return g.orderBy(F.desc("visitors"), "value").limit(limit)


def channel_conversion(df: DataFrame, conversion: str) -> DataFrame:
    """First-touch channel per person: people, converted, rate and which channel converts best."""
    first = df.groupBy("distinct_id").agg(
        F.min(F.struct("timestamp", "id", identity.channel(df).alias("c")))["c"].alias("channel"),
        F.max((F.col("name") == conversion).cast("int")).alias("conv"))
    g = first.groupBy("channel").agg(F.count("*").alias("users"), F.sum("conv").alias("converted"))
    g = g.withColumn("rate", v.ratio(F.col("converted"), F.col("users")))
    best = g.where("converted > 0").agg(F.max(F.struct((F.col("converted") / F.col("users")).alias("r"), "users", "channel"))["channel"].alias("_b"))
    return attach_row(g, best).withColumn("best", F.coalesce(F.col("channel") == F.col("_b"), F.lit(False))).drop("_b")


def geo(df: DataFrame, start=None, end=None) -> DataFrame:
    """Visitors and views per country; unresolved codes are one row."""
    d = pageviews(df, start, end)
    cc = v.text(d, "country")
    return d.where(cc != "").groupBy(F.when(cc.isin("ZZ", "XX"), "(unresolved)").otherwise(cc).alias("country")).agg(
        F.count_distinct("distinct_id").alias("visitors"), F.count("*").alias("views"))


def page_stats(df: DataFrame, path: str, start=None, end=None) -> DataFrame:
    d = pageviews(df, start, end)
    return d.where(v.text(d, "path") == path).agg(F.count("*").alias("pageviews"), F.count_distinct("distinct_id").alias("visitors"))
