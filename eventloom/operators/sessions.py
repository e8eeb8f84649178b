"""Sessions split on 30 idle minutes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import scan, values as v
from eventloom.model import attach_row
from eventloom.operators.scope import drop_sampler

GAP_US = 30 * 60 * 1_000_000


def with_session(df: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Adds ``session_us``, the start of the session each row belongs to (epoch micros)."""
    d = df.where("distinct_id <> ''")
    d = scan.with_blocks(d, rows_per_block=block_rows)
    d = scan.previous_value(d, "_us", "_prev", ["_us", "id"])
    opens = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > GAP_US)
    return scan.last_value_so_far(d, F.when(opens, F.col("_us")), "session_us", ["_us", "id"]).drop("_prev")


def sessions(df: DataFrame, start=None, block_rows: int | None = None) -> DataFrame:
    d = drop_sampler(df)
    if start is not None:
        d = d.where(F.col("timestamp") >= F.lit(str(start)).cast("timestamp"))
    path = v.text(d, "path")
    s = with_session(d.select("id", "name", "distinct_id", "timestamp", F.when(path != "", path).alias("_path")), block_rows)
    seen = F.when(F.col("_path").isNotNull(), F.struct("_us", "id", "_path"))
    g = s.groupBy("distinct_id", "session_us").agg(
        F.max("_us").alias("end_us"), F.count("*").alias("events"), F.count_distinct("_path").alias("pages"),
        F.count(F.when(F.col("name") == "$rageclick", 1)).alias("rage_clicks"),
        F.min(seen).alias("_in"), F.max(seen).alias("_out"))
    return g.select("distinct_id", F.col("session_us").alias("start_us"), "end_us",
                    F.floor((F.col("end_us") - F.col("session_us")) / 1_000_000).alias("duration_s"),
                    "events", "pages", "rage_clicks", F.coalesce("_in._path", F.lit("")).alias("entry_path"),
                    F.coalesce("_out._path", F.lit("")).alias("exit_path"))


def recent(df: DataFrame, start=None, limit: int = 100) -> DataFrame:
    """Newest first, top ``limit``."""
    return sessions(df, start).orderBy(F.desc("start_us"), "distinct_id").limit(limit)


def timeline(df: DataFrame, distinct_id: str, start_unix: int) -> DataFrame:
    """Playback of one person's session, from the event at ``start_unix`` on."""
    mine = df.where(F.col("distinct_id") == distinct_id)
    txt = lambda k: F.coalesce(v.text(mine, k), F.lit(""))
    num = lambda k: F.coalesce(v.num_strict(mine, k), F.lit(0)).cast("bigint")
    rows = mine.select("id", "name", "distinct_id", "timestamp", txt("path").alias("path"), num("x").alias("x"),
                       num("y").alias("y"), num("vw").alias("vw"), txt("text").alias("text"))
    s = with_session(rows)
    handle = (s.where(F.floor(F.col("_us") / 1_000_000) == start_unix)
              .agg(F.min(F.struct("_us", "session_us")).alias("h")))
    j = attach_row(s, handle).where((F.col("session_us") == F.col("h.session_us")) & (F.col("_us") >= F.col("h._us")))
    return j.select(F.floor((F.col("_us") - F.col("h._us")) / 1000).alias("t_ms"), "name", "path", "x", "y", "vw", "text")
