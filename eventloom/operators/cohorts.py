"""Behavioural cohorts: membership and ordered sequences."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import scan
from eventloom.operators import filters as flt, funnel


@dataclass(frozen=True)
class SequenceStep:
    event: str
    filters: tuple = ()
    count: int = 1


def membership(df: DataFrame, events, match: str = "any", filters=()) -> DataFrame:
    """People who did any (or all) of the events, after the property filters."""
    names = list(dict.fromkeys(events))
    hit = flt.apply(df, filters).where(F.col("name").isin(*names))
    if match != "all":
        return hit.select("distinct_id").distinct()
    did = [F.max(F.when(F.col("name") == n, 1).otherwise(0)) for n in names]
    total = did[0]
    for x in did[1:]:
        total = total + x
    return hit.groupBy("distinct_id").agg(total.alias("n")).where(F.col("n") == len(names)).select("distinct_id")


def sequence(df: DataFrame, steps, within_ms: int = 0, within_first_ms: int = 0, exclude=(), filters=(),
             block_rows: int | None = None) -> DataFrame:
    """People whose events contain the steps in order.

    Every first-step event is tried; the rest match greedily and the span is tested afterwards.
    """
    steps = [s if isinstance(s, SequenceStep) else SequenceStep(s) for s in steps]
    d = flt.apply(df, filters)
    match = lambda frame, s: (F.col("name") == s.event) & flt.matches(frame, s.filters)
    k = len(steps)
    rows = funnel.prepare(d, steps, exclude, matcher=match)
    a = funnel.with_chains(scan.with_blocks(rows, rows_per_block=block_rows), k).where(F.size("_chain") == k)
    last = F.element_at("_chain", -1)["_us"]
    ok = ~F.col("_x") & F.coalesce(F.col("_next_x._us") > last, F.lit(True))
    if within_ms:
        ok = ok & (last - F.col("_us") <= within_ms * 1000)
    people = a.where(ok).select("distinct_id", last.alias("last_us"))
    if within_first_ms:
        first = d.groupBy("distinct_id").agg(F.min(F.unix_micros("timestamp")).alias("first_us"))
        people = people.join(first, "distinct_id").where(F.col("last_us") - F.col("first_us") <= within_first_ms * 1000)
    people = people.select("distinct_id").distinct()
    if any(s.count > 1 for s in steps):
        need = [F.count(F.when(F.col(f"_m{i}"), 1)).alias(f"n{i}") for i in range(k)]
        enough = " and ".join(f"n{i} >= {max(1, s.count)}" for i, s in enumerate(steps))
        gate = rows.groupBy("distinct_id").agg(*need).where(enough).select("distinct_id")
        people = people.join(gate, "distinct_id", "left_semi")
    return people


def keep_members(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select("distinct_id"), "distinct_id", "left_semi")
