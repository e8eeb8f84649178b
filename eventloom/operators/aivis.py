"""How AI assistants answer about a product: sampled checks rolled up by engine, prompt, week and deploy."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, lit_ts
from eventloom.operators.deploys import around
from eventloom.operators.search import round1

CHECK = "$geo_check"
US = "you"
SHARE_MAX = 8


def checks(df: DataFrame, days: int, asof: str) -> DataFrame:
    t = F.col("timestamp")
    d = df.where((F.col("name") == CHECK) & (t >= lit_ts(asof) - F.expr(f"interval {days} days")) & (t <= lit_ts(asof)))
    return fields(d)


def fields(d: DataFrame) -> DataFrame:
    txt = lambda k: F.trim(F.coalesce(v.text(d, k), F.lit("")))
    flag = lambda k: F.coalesce(v.text(d, k) == "true", F.lit(False))
    return d.select("id", "timestamp", F.when(txt("engine") == "", "unknown").otherwise(txt("engine")).alias("engine"), txt("prompt").alias("prompt"),
                    flag("mentioned").alias("mentioned"), flag("recommended").alias("recommended"),
                    F.coalesce(v.num_strict(d, "rank"), F.lit(0.0)).alias("rank"), txt("verbatim").alias("verbatim"),
                    txt("model_version").alias("model"), txt("competitors").alias("competitors"), txt("sentiment").alias("sentiment"),
                    flag("cited_domain").alias("cited"), F.date_format(F.date_trunc("week", "timestamp"), "yyyy-MM-dd").alias("week"))


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _rates() -> list[Column]:
    return [F.count("*").alias("runs"), _n(F.col("mentioned")).alias("mentioned"), _n(F.col("recommended")).alias("recommended")]


def _with_pct(g: DataFrame) -> DataFrame:
    return (g.withColumn("mentioned_pct", v.pct(F.col("mentioned"), F.col("runs")))
            .withColumn("recommended_pct", v.pct(F.col("recommended"), F.col("runs"))))


def engines(df: DataFrame, days: int, asof: str) -> DataFrame:
    g = checks(df, days, asof).groupBy("engine").agg(
        *_rates(), _n(F.col("rank") >= 1).alias("ranked"), F.sum(F.when(F.col("rank") >= 1, F.col("rank"))).alias("_sum"),
        F.max(F.struct("timestamp", "id", "verbatim", "model")).alias("_l"))
    g = _with_pct(g).withColumn("avg_rank", F.when(F.col("ranked") > 0, round1(F.col("_sum") / F.col("ranked"))).otherwise(F.lit(0.0)))
    return g.withColumn("latest_verbatim", F.col("_l.verbatim")).withColumn("latest_model", F.col("_l.model")).drop("_l", "_sum")


def prompts(df: DataFrame, days: int, asof: str) -> DataFrame:
    return _with_pct(checks(df, days, asof).where("prompt <> ''").groupBy("prompt").agg(*_rates()))


def trend(df: DataFrame, days: int, asof: str) -> DataFrame:
    return _with_pct(checks(df, days, asof).groupBy("week").agg(*_rates()))


def share_of_voice(df: DataFrame, days: int, asof: str) -> DataFrame:
    """(brand, week, mentions, total, share_pct): us and the loudest competitors; the tail is summed."""
    d = checks(df, days, asof)
    others = F.filter(F.transform(F.split("competitors", ","), lambda x: F.trim(x)), lambda x: x != "")
    us = F.when(F.col("mentioned"), F.array(F.lit(US))).otherwise(F.array().cast("array<string>"))
    m = d.select("week", F.explode(F.concat(us, others)).alias("brand")).groupBy("brand", "week").agg(F.count("*").alias("n"))
    brands = m.groupBy("brand").agg(F.sum("n").alias("total"))
    all_m = brands.agg(F.sum("total").alias("_all"), F.count("*").alias("_k"))
    brands = attach_row(brands, all_m).withColumn("share", v.pct(F.col("total"), F.col("_all")))
    order = [F.desc(F.col("brand") == US), F.desc("total"), "brand"]
    lead = brands.orderBy(*order).limit(SHARE_MAX + 1)       # at most nine rows
    lead = (lead.withColumn("_r", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
            .where(F.expr(f"_k <= {SHARE_MAX + 1} or _r <= {SHARE_MAX}")).select(F.col("brand").alias("_lead")))
    b = brands.join(F.broadcast(lead), F.col("brand") == F.col("_lead"), "left")
    b = b.withColumn("line", F.coalesce("_lead", F.concat(F.col("_k") - SHARE_MAX, F.lit(" others"))))
    per_line = b.groupBy("line").agg(F.sum("total").alias("total"), F.sum("share").alias("share_pct"))
    weekly = m.join(b.select("brand", "line"), "brand").groupBy("line", "week").agg(F.sum("n").alias("mentions"))
    return weekly.join(per_line, "line").select(F.col("line").alias("brand"), "week", "mentions", "total", "share_pct")


def sentiment(df: DataFrame, days: int, asof: str) -> DataFrame:
    d = checks(df, days, asof)
    kinds = ("positive", "neutral", "negative", "absent")
    return d.agg(*[_n(F.col("sentiment") == k).alias(k) for k in kinds], _n(F.col("sentiment").isin(*kinds)).alias("rated"))


def rank_distribution(df: DataFrame, days: int, asof: str) -> DataFrame:
    r = F.least(F.floor("rank"), F.lit(4))
    g = checks(df, days, asof).where("rank >= 1").groupBy(F.element_at(F.array(*[F.lit(x) for x in ("1st", "2nd", "3rd", "4+")]), r.cast("int")).alias("label")).agg(F.count("*").alias("runs"))
    g = attach_row(g, g.agg(F.sum("runs").alias("_all")))
    return g.select("label", "runs", v.pct(F.col("runs"), F.col("_all")).alias("pct"))


def citation(df: DataFrame, days: int, asof: str) -> DataFrame:
    d = checks(df, days, asof).where(F.col("engine").endswith("-grounded"))
    a = d.agg(_n(F.col("cited")).alias("cited_runs"), F.count("*").alias("ground_runs"), _n(F.col("cited") & F.col("recommended")).alias("cited_recommended"))
    return a.select("*", v.pct(F.col("cited_runs"), F.col("ground_runs")).alias("cited_rate"),
                    (F.col("cited_runs") - F.col("cited_recommended")).alias("cited_not_recommended"))


# fixed values: runs each side of a deploy needs, and the points a rate must move
DEPLOY_MIN_RUNS, DEPLOY_MIN_SHIFT = 20, 15


def by_deploy(df: DataFrame, deploys: DataFrame, asof: str, window: int = 7, limit: int = 12) -> DataFrame:
    """Mention and recommendation rates and crawl counts either side of each deploy."""
    d = df.where(F.col("name").isin(CHECK, "$ai_crawl"))
    flag = lambda k: F.coalesce(v.text(d, k) == "true", F.lit(False))
    rows = d.select("timestamp", (F.col("name") == CHECK).alias("check"), flag("mentioned").alias("m"), flag("recommended").alias("r"))
    deps = deploys.where(F.col("at") <= lit_ts(asof) - F.expr(f"interval {window} days"))
    j = around(rows, deps, window)
    side = {"before": ~F.col("after"), "after": F.col("after")}
    aggs = []
    for s, c in side.items():
        aggs += [_n(c & F.col("check")).alias(f"runs_{s}"), _n(c & F.col("check") & F.col("m")).alias(f"_m_{s}"),
                 _n(c & F.col("check") & F.col("r")).alias(f"_r_{s}"), _n(c & ~F.col("check")).alias(f"crawl_{s}")]
    g = j.groupBy("deploy", "at").agg(*aggs)
    for s in side:
        g = g.withColumn(f"mentioned_{s}", v.pct(F.col(f"_m_{s}"), F.col(f"runs_{s}"))).withColumn(f"recommended_{s}", v.pct(F.col(f"_r_{s}"), F.col(f"runs_{s}")))
    md, rd = F.col("mentioned_after") - F.col("mentioned_before"), F.col("recommended_after") - F.col("recommended_before")
    thin = (F.col("runs_before") < DEPLOY_MIN_RUNS) | (F.col("runs_after") < DEPLOY_MIN_RUNS)
    flat = (F.abs(rd) < DEPLOY_MIN_SHIFT) & (F.abs(md) < DEPLOY_MIN_SHIFT)
    lead = F.when(F.abs(md) > F.abs(rd), md).otherwise(rd)
    out = g.select("deploy", "runs_before", "runs_after", "crawl_before", "crawl_after", "mentioned_before", "mentioned_after",
                   "recommended_before", "recommended_after", (~thin & ~flat).alias("significant"),
                   F.when(thin, "unknown").when(flat, "flat").when(lead > 0, "improvement").otherwise("regression").alias("direction"), "at")
    return out.orderBy(F.desc("at"), "deploy").limit(limit).drop("at")


# fixed values: floors of the week-over-week visibility shift
SHIFT_MIN_RUNS, SHIFT_MIN_DAYS, SHIFT_RUN_RATIO, SHIFT_MIN_PP, DESIGN_EFFECT = 20, 3, 2, 15, 2.3


def noise_band(x1: Column, n1: Column, x2: Column, n2: Column, design: float = DESIGN_EFFECT) -> Column:
    """Two standard errors of the rate difference, smoothed, with the variance inflated for clustering."""
    p1, p2 = (x1 + 1) / (n1 + 2), (x2 + 1) / (n2 + 2)
    return 2 * F.sqrt((p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) * design)


def shift(df: DataFrame, asof: str) -> DataFrame:
    """Largest believable week-over-week move per engine, one row at most."""
    week = F.expr("interval 7 days")
    t, now = F.col("timestamp"), lit_ts(asof)
    d = df.where((F.col("name") == CHECK) & (t >= now - F.expr("interval 14 days")) & (t <= now))
    f = fields(d)
    both = []
    for tag, lo, hi in (("c", now - week, now), ("p", now - F.expr("interval 14 days"), now - week)):
        inside = (t >= lo) & (t <= hi)
        both += [_n(inside).alias(f"{tag}_runs"), _n(inside & F.col("mentioned")).alias(f"{tag}_m"), _n(inside & F.col("recommended")).alias(f"{tag}_r"),
                 F.count_distinct(F.when(inside, F.to_date(t))).alias(f"{tag}_days")]
    g = f.where("engine <> 'unknown'").groupBy("engine").agg(*both)
    g = g.where((F.least("c_runs", "p_runs") >= SHIFT_MIN_RUNS) & (F.least("c_days", "p_days") >= SHIFT_MIN_DAYS) &
                (F.greatest("c_runs", "p_runs") <= SHIFT_RUN_RATIO * F.least("c_runs", "p_runs")))
    mv = lambda k: F.abs(F.col(f"c_{k}") / F.col("c_runs") - F.col(f"p_{k}") / F.col("p_runs"))
    use_m = mv("m") > mv("r")
    cur, old = F.when(use_m, F.col("c_m")).otherwise(F.col("c_r")), F.when(use_m, F.col("p_m")).otherwise(F.col("p_r"))
    g = g.select("engine", F.when(use_m, "mentions").otherwise("recommends").alias("metric"), cur.alias("cur"), old.alias("old"), "c_runs", "p_runs",
                 F.greatest(mv("m"), mv("r")).alias("move"))
    band = noise_band(F.col("cur"), F.col("c_runs"), F.col("old"), F.col("p_runs"))
    g = g.where((F.col("move") * 100 >= SHIFT_MIN_PP) & (F.col("move") >= band))
    g = g.select("engine", "metric", v.pct(F.col("cur"), F.col("c_runs")).alias("current_pct"), v.pct(F.col("old"), F.col("p_runs")).alias("previous_pct"),
                 F.col("c_runs").alias("runs"), F.col("p_runs").alias("previous_runs"), "move")
    g = g.withColumn("severity", F.when(F.col("current_pct") < F.col("previous_pct"), "warn").otherwise("info"))
    return g.orderBy(F.desc("move"), F.desc("runs"), "engine").limit(1).drop("move")


# fixed values: cited runs needed, and the share not recommended
MIN_CITED, NOT_PICKED_PCT = 8, 70


def cited_not_recommended(df: DataFrame, asof: str) -> DataFrame:
    """Read by the assistants but not picked: one row when that is most of the cited runs."""
    c = citation(df, 30, asof)
    lost, runs = F.col("cited_not_recommended"), F.col("cited_runs")
    return c.where((runs >= MIN_CITED) & (lost * 100 >= runs * NOT_PICKED_PCT)).select(
        F.lit("warn").alias("severity"), F.lit("cited_not_recommended").alias("metric"), v.pct(lost, runs).alias("rate"), runs.alias("n"))
