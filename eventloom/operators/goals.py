"""Goal reports for many goals in one pass, and click heatmaps."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, lit_ts


@dataclass(frozen=True)
class Goal:
    name: str
    kind: str       # event | path
    value: str      # event name, or a path glob


def glob_regex(pattern: str) -> str:
    """Path glob as a regex: * and ? stay within one segment, [...] is a character class."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in pattern[i + 1:]:
            j = pattern.index("]", i + 1)
            out += "[" + pattern[i + 1:j].replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(ch)
        i += 1
    return f"^{out}$"


def _hit(df: DataFrame, g: Goal) -> Column:
    if g.kind == "event":
        return F.col("name") == g.value
    return (F.col("name") == "$pageview") & F.coalesce(v.text(df, "path"), F.lit("")).rlike(glob_regex(g.value))


def _people(df: DataFrame, goals, asof: str, days: int) -> DataFrame:
    t = F.col("timestamp")
    d = df.where((t >= lit_ts(asof) - F.expr(f"interval {days} days")) & (t <= lit_ts(asof)))   # inclusive on both sides
    first = F.min(F.struct("timestamp", "id", v.host(v.text(d, "referrer")).alias("ref"), v.text(d, "utm_source").alias("utm")))
    return d.groupBy("distinct_id").agg(first.alias("f"), *[F.max(_hit(d, g).cast("int")).alias(f"g{i}") for i, g in enumerate(goals)])


def report(df: DataFrame, goals, asof: str, days: int = 30) -> DataFrame:
    """(goal, conversions, visitors, pct) for every goal."""
    goals = list(goals)
    a = _people(df, goals, asof, days).agg(F.count("*").alias("visitors"), *[F.coalesce(F.sum(f"g{i}"), F.lit(0)).alias(f"g{i}") for i in range(len(goals))])
    rows = F.array(*[F.struct(F.lit(g.name).alias("goal"), F.col(f"g{i}").alias("conversions")) for i, g in enumerate(goals)])
    return a.select("visitors", F.explode(rows).alias("r")).select(
        "r.goal", "r.conversions", "visitors", v.pct(F.col("r.conversions"), F.col("visitors")).alias("conversion_pct"))


def attribution(df: DataFrame, goals, asof: str, days: int = 30, limit: int = 10) -> DataFrame:
    """(goal, dim, value, users): first-touch referrer and campaign of the converters."""
    goals = list(goals)
    p = _people(df, goals, asof, days)
    done = F.filter(F.array(*[F.when(F.col(f"g{i}") == 1, F.lit(g.name)) for i, g in enumerate(goals)]), lambda x: x.isNotNull())
    dims = F.array(F.struct(F.lit("referrer").alias("dim"), F.coalesce(F.when(F.col("f.ref") != "", F.col("f.ref")), F.lit("direct")).alias("value")),
                   F.struct(F.lit("utm_source").alias("dim"), F.col("f.utm").alias("value")))
    x = p.select(F.explode(done).alias("goal"), dims.alias("d")).select("goal", F.explode("d").alias("d")).select("goal", "d.*")
    c = x.where("value <> ''").groupBy("goal", "dim", "value").agg(F.count("*").alias("users"))
    rn = F.row_number().over(W.partitionBy("goal", "dim").orderBy(F.desc("users"), "value"))
    return c.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")


# fixed values: heatmap grid
DEFAULT_COLS, DEFAULT_ROW_PX = 40, 20


def _viewport(vw: Column) -> Column:
    return F.when(vw < 768, "mobile").when(vw <= 1024, "tablet").otherwise("desktop")


def _positioned(df: DataFrame, path: str, viewport: str, cols: int, row_px: int, max_y: int | None = 50_000) -> DataFrame:
    d = df.where((F.col("name") == "$click") & (v.text(df, "path") == path))
    num = lambda k: F.coalesce(v.num_strict(d, k), F.lit(0)).cast("bigint")
    txt = lambda k: F.coalesce(v.text(d, k), F.lit(""))
    lbl = (F.when(txt("text") != "", txt("text")).when(txt("id") != "", F.concat(txt("tag"), F.lit("#"), txt("id")))
           .when(txt("href") != "", F.concat(txt("tag"), F.lit(" "), txt("href"))).otherwise(txt("tag")))
    d = d.select(num("vw").alias("vw"), num("x").alias("x"), num("y").alias("y"), num("sy").alias("sy"), lbl.alias("label")).where("vw > 0")
    if viewport.lower() in ("mobile", "tablet", "desktop"):
        d = d.where(_viewport(F.col("vw")) == viewport.lower())
    cols = cols if cols > 0 else DEFAULT_COLS
    row_px = row_px if row_px > 0 else DEFAULT_ROW_PX
    y = F.greatest(F.col("y") + F.col("sy"), F.lit(0))
    y = y if max_y is None else F.least(y, F.lit(max_y))
    col = F.least(F.greatest(F.expr(f"(x * {cols}) div vw"), F.lit(0)), F.lit(cols - 1))
    return d.select(F.floor(y / row_px).alias("row"), col.cast("bigint").alias("col"), "label")


def heatmap(df: DataFrame, path: str, viewport: str = "all", cols: int = 0, row_px: int = 0, max_y: int | None = 50_000) -> DataFrame:
    """Clicks per cell; those below ``max_y`` pixels (None: no bound) count in its last row."""
    g = _positioned(df, path, viewport, cols, row_px, max_y).groupBy("row", "col").agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("clicks"), F.max("n").alias("hottest"), F.max("row").alias("max_row"))
    return attach_row(g, t)


def heatmap_targets(df: DataFrame, path: str, viewport: str = "all", limit: int | None = 12) -> DataFrame:
    """The ``limit`` (None: all) most clicked targets."""
    g = _positioned(df, path, viewport, 0, 0).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"))
    return g if limit is None else g.orderBy(F.desc("n"), "label").limit(limit)
