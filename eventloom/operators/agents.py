"""Agent observability: tool calls, conversations, labels and samples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import scan, values as v
from eventloom.functions.quantiles import exact_quantiles
from eventloom.model import attach_row, between

TOOL_CALL, TURN, LABEL = "agent_tool_call", "agent_turn", "agent_label"


def _is_error(d: DataFrame) -> Column:
    t = F.lower(F.coalesce(v.text(d, "error"), F.lit("")))
    return ~t.isin("", "false", "0")


def _calls(df: DataFrame, start, end) -> DataFrame:
    d = between(df.where(F.col("name") == TOOL_CALL), start, end)
    return d.select(v.label(d, "tool").alias("tool"), v.label(d, "client").alias("client"), _is_error(d).alias("bad"),
                    v.num_lenient(d, "latency_ms").alias("latency"), v.label(d, "error_type").alias("error_type"))


def tool_health(df: DataFrame, start=None, end=None) -> DataFrame:
    c = _calls(df, start, end)
    g = c.groupBy("tool").agg(F.count("*").alias("calls"), F.count(F.when(F.col("bad"), 1)).alias("errors"))
    q = exact_quantiles(c, ["tool"], "latency", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("n")
    j = g.join(q, "tool", "left")
    p = [F.round(F.coalesce(x, F.lit(0.0)), 6).alias(x) for x in ("p50", "p90", "p99")]
    return j.select("tool", "calls", "errors", v.ratio(F.col("errors"), F.col("calls")).alias("error_rate"), *p)


def tool_clients(df: DataFrame, start=None, end=None) -> DataFrame:
    return _calls(df, start, end).groupBy("tool", "client").agg(F.count("*").alias("calls"))


def error_taxonomy(df: DataFrame, tool: str = "", start=None, end=None) -> DataFrame:
    c = _calls(df, start, end).where("bad")
    if tool:
        c = c.where(F.col("tool") == tool)
    return c.groupBy("error_type").agg(F.count("*").alias("count"))


def _turns(df: DataFrame, start, end) -> DataFrame:
    d = between(df.where(F.col("name") == TURN), start, end)
    res = F.lower(v.text(d, "resolved"))
    return d.select("id", "timestamp", v.label(d, "conversation_id").alias("conversation_id"), F.coalesce(v.text(d, "role"), F.lit("")).alias("role"),
                    v.num_lenient(d, "ttft_ms").alias("ttft"), F.when(res.isin("true", "false"), res == "true").alias("resolved"), v.text(d, "text").alias("text"))


def conversations(df: DataFrame, start=None, end=None, block_rows: int | None = None) -> DataFrame:
    """One row: turns, medians, re-ask and abandon rates, first-token percentiles, resolution rate."""
    t = _turns(df, start, end)
    s = scan.with_blocks(t, "conversation_id", rows_per_block=block_rows)
    s = scan.previous_value(s, "role", "_prev", ["_us", "id"], key="conversation_id")
    c = s.groupBy("conversation_id").agg(
        F.count("*").alias("turns"), F.max(((F.col("role") == "user") & (F.col("_prev") == "user")).cast("int")).alias("reask"),
        F.max(F.struct("_us", "id", "role"))["role"].alias("last"), F.max((F.coalesce("resolved", F.lit(False))).cast("int")).alias("res"),
        F.count("resolved").alias("saw"))
    a = c.agg(F.count("*").alias("conversations"), F.sum("turns").alias("turns"), F.sum(F.coalesce("reask", F.lit(0))).alias("_reask"),
              F.count(F.when(F.col("last") == "user", 1)).alias("_abandon"), F.sum("res").alias("_res"), F.sum("saw").alias("_saw"))
    q1 = exact_quantiles(c, [], "turns", {"median_turns": "median", "p90_turns": 0.9}).drop("n")
    q2 = exact_quantiles(t, [], "ttft", {"ttft_p50": 0.5, "ttft_p90": 0.9, "ttft_p99": 0.99}).drop("n")
    r = attach_row(attach_row(a, q1), q2)
    n = F.col("conversations")
    z = lambda x: F.round(F.coalesce(F.col(x), F.lit(0.0)), 6).alias(x)
    return r.select("conversations", "turns", z("median_turns"), z("p90_turns"), v.ratio(F.col("_reask"), n).alias("reask_rate"),
                    v.ratio(F.col("_abandon"), n).alias("abandon_rate"), z("ttft_p50"), z("ttft_p90"), z("ttft_p99"),
                    F.when(F.col("_saw") > 0, F.round(F.col("_res") / n, 6)).alias("resolution_rate"))


def sample(df: DataFrame, start=None, end=None, limit: int = 20, turns: int | None = 40, chars: int | None = 500) -> DataFrame:
    """The newest conversations with their first ``turns`` turns, oldest first, and the first ``chars`` characters of each (None: all)."""
    t = _turns(df, start, end)
    c = t.groupBy("conversation_id").agg(F.count("*").alias("turn_count"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    c = c.orderBy(F.desc("end"), "conversation_id").limit(limit)
    lab = df.where(F.col("name") == LABEL)
    lab = lab.select(F.coalesce(v.text(lab, "conversation_id"), F.lit("")).alias("conversation_id")).where("conversation_id <> ''").distinct()
    rn = F.row_number().over(W.partitionBy("conversation_id").orderBy("timestamp", "id"))
    kept = t.join(c.select("conversation_id"), "conversation_id", "left_semi").withColumn("_rn", rn)
    if turns is not None:
        kept = kept.where(F.col("_rn") <= turns)
    said = F.concat("role", F.lit(": "), F.coalesce(F.col("text") if chars is None else F.substring("text", 1, chars), F.lit("")))
    lines = kept.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("_rn", said.alias("line")))).alias("_l"),
                                                F.count(F.when(F.coalesce("text", F.lit("")) != "", 1)).alias("with_text"))
    j = c.join(lines, "conversation_id").join(lab.withColumn("_lab", F.lit(True)), "conversation_id", "left")
    return j.select("conversation_id", "turn_count", (F.lit(0).cast("bigint") if turns is None else F.greatest(F.col("turn_count") - turns, F.lit(0))).alias("turns_omitted"),
                    F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "with_text",
                    F.coalesce("_lab", F.lit(False)).alias("labeled"),
                    F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("transcript"))


def label_breakdown(df: DataFrame, label: str, start=None, end=None) -> DataFrame:
    """(value, conversations, total, labeled): the newest write per conversation counts."""
    convs = _turns(df, start, end).select("conversation_id").distinct()
    d = df.where(F.col("name") == LABEL)
    w = d.select("id", "timestamp", F.coalesce(v.text(d, "conversation_id"), F.lit("")).alias("conversation_id"), v.text(d, label).alias("value"), v.present(d, label).alias("_has"))
    w = w.where("_has and conversation_id <> ''").groupBy("conversation_id").agg(
        F.max(F.struct("timestamp", "id", F.coalesce("value", F.lit("")).alias("value")))["value"].alias("value"))
    win = convs.join(w, "conversation_id")
    g = win.groupBy("value").agg(F.count("*").alias("conversations"))
    g = attach_row(g, convs.agg(F.count("*").alias("total")))
    return attach_row(g, win.agg(F.count("*").alias("labeled")))
