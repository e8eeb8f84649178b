"""Funnels: ordered, strict and unordered, with windows, exclusions and per-step filters.

The per-person greedy match is a backward chain of windows: on a row matching step i the chain is
that row plus the nearest following chain of step i+1.  All windows share one sort and grow-only frames.  Hot people are cut
into time blocks (see functions.scan) and their chains are continued through the block table.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import scan, values as v
from eventloom.functions.quantiles import exact_quantiles
from eventloom.operators.filters import as_text
from eventloom.operators.scope import drop_sampler


@dataclass(frozen=True)
class Step:
    event: str
    where: dict = field(default_factory=dict)   # property -> wanted value, compared as text


def steps_of(*names) -> list[Step]:
    return [n if isinstance(n, Step) else Step(n) for n in names]


def step_match(df: DataFrame, step: Step) -> Column:
    m = F.col("name") == step.event
    for k, want in step.where.items():
        m = m & v.present(df, k) & (F.coalesce(v.text(df, k), F.lit("")) == as_text(want))
    return m


def step_rank(steps: list[Step]) -> Column:
    """Tie-break among equal timestamps: the step listed first, other events last."""
    out, seen = None, set()
    for i, s in enumerate(steps):
        if s.event not in seen:
            seen.add(s.event)
            out = (F.when if out is None else out.when)(F.col("name") == s.event, F.lit(i))
    return out.otherwise(F.lit(len(steps)))


ORDER = ["_us", "_rank", "id", "name"]


def _pos() -> Column:
    return F.struct(*ORDER)


def prepare(df: DataFrame, steps: list[Step], exclude=(), every_event: bool = False,
            matcher=step_match, carry=()) -> DataFrame:
    names = {s.event for s in steps} | {x for x in exclude if x}
    rows = df if every_event else df.where(F.col("name").isin(*sorted(names)))
    return rows.select("id", "name", "distinct_id", "timestamp", *carry, step_rank(steps).alias("_rank"),
                       *[matcher(df, s).alias(f"_m{i}") for i, s in enumerate(steps)],
                       (F.col("name").isin(*[x for x in exclude if x]) if any(exclude) else F.lit(False)).alias("_x"))


def with_chains(rows: DataFrame, k: int, first: int = 0) -> DataFrame:
    """Adds ``_chain`` (positions matched from step ``first`` on) and ``_next_x`` to step rows."""
    w = scan.following("distinct_id", *ORDER)
    d = rows.withColumn("_pos", _pos())
    empty = F.array().cast("array<struct<_us:bigint,_rank:int,id:string,name:string>>")
    for i in range(k - 1, first - 1, -1):
        rest = F.last(f"_c{i + 1}", True).over(w) if i < k - 1 else empty
        d = d.withColumn(f"_c{i}", F.when(F.col(f"_m{i}"), F.concat(F.array("_pos"), F.coalesce(rest, empty))))
    d = d.withColumn("_nx", F.last(F.when(F.col("_x"), F.col("_pos")), True).over(w))
    heads = [F.min(F.when(F.col(f"_m{i}"), F.struct(F.col("_pos").alias("p"), F.col(f"_c{i}").alias("c")))).alias(f"_e{i}")
             for i in range(first + 1, k)]
    blocks = scan.block_summary(d, F.min(F.when(F.col("_x"), F.col("_pos"))).alias("_x0"), *heads)
    later = scan.later_blocks()
    for i in range(k - 1, first, -1):   # complete each block's entry chain from the blocks after it
        tail = empty
        for j in range(k - 1, i, -1):
            tail = F.when(F.size(f"_e{i}.c") + i == j, F.coalesce(F.col(f"_n{j}"), empty)).otherwise(tail)
        blocks = blocks.withColumn(f"_f{i}", F.when(F.col(f"_e{i}").isNotNull(), F.concat(F.col(f"_e{i}.c"), tail)))
        blocks = blocks.withColumn(f"_n{i}", F.last(f"_f{i}", True).over(later))
    blocks = blocks.withColumn("_nx_later", F.last("_x0", True).over(later))
    carry = blocks.select("distinct_id", "_blk", "_nx_later", *[f"_n{i}" for i in range(first + 1, k)])
    a = scan.attach(d.where(F.col(f"_m{first}")), carry)
    more = empty
    for j in range(k - 1, first, -1):
        more = F.when(F.size(f"_c{first}") + first == j, F.coalesce(F.col(f"_n{j}"), empty)).otherwise(more)
    return (a.withColumn("_chain", F.concat(F.col(f"_c{first}"), more))
            .withColumn("_next_x", F.coalesce("_nx", "_nx_later")))


def _ordered_anchors(rows: DataFrame, k: int, window_us: int, block_rows: int | None) -> DataFrame:
    a = with_chains(scan.with_blocks(rows, rows_per_block=block_rows), k)
    within = F.filter("_chain", lambda p: p["_us"] - F.col("_us") <= window_us) if window_us else F.col("_chain")
    a = a.withColumn("_in", within)
    full = F.size("_in") == k
    early = F.col("_next_x") <= F.element_at("_in", -1)
    in_reach = (F.col("_next_x._us") - F.col("_us") <= window_us) if window_us else F.lit(True)
    bad = F.col("_next_x").isNotNull() & F.when(full, early).otherwise(in_reach)
    if k == 1:
        bad = F.lit(False)
    return a.where(~bad).select("distinct_id", *ORDER, F.size("_in").alias("reached"),
                                (F.element_at("_in", -1)["_us"] - F.col("_us")).alias("dur_us"))


def _unordered_anchors(rows: DataFrame, k: int, window_us: int, block_rows: int | None) -> DataFrame:
    d = scan.with_blocks(rows, rows_per_block=block_rows).withColumn("_pos", _pos())
    w = scan.following("distinct_id", *ORDER)
    later = scan.later_blocks()
    sig = {f"_n{i}": F.col(f"_m{i}") for i in range(k)} | {"_nx": F.col("_x")}
    heads = scan.block_summary(d, *[F.min(F.when(m, F.col("_pos"))).alias(n + "h") for n, m in sig.items()])
    carry = heads.select("distinct_id", "_blk", *[F.last(n + "h", True).over(later).alias(n + "l") for n in sig])
    for n, m in sig.items():
        d = d.withColumn(n, F.last(F.when(m, F.col("_pos")), True).over(w))
    any_step = reduce(lambda a, b: a | b, [F.col(f"_m{i}") for i in range(k)])
    own = reduce(lambda acc, i: F.when(F.col(f"_m{i}"), F.lit(i)).otherwise(acc), range(k - 1, -1, -1), F.lit(-1))
    d = d.where(any_step).withColumn("_own", own)
    d = scan.attach(d, carry)
    for n in sig:
        d = d.withColumn(n, F.coalesce(n, n + "l"))
    ok = {}
    for i in range(k):
        near = F.col(f"_n{i}").isNotNull()
        if window_us:
            near = near & (F.col(f"_n{i}._us") - F.col("_us") <= window_us)
        ok[i] = (F.col("_own") == i) | F.coalesce(near, F.lit(False))
    full = reduce(lambda a, b: a & b, ok.values())
    last = F.greatest(*[F.when(F.col("_own") == i, F.col("_pos")).otherwise(F.col(f"_n{i}")) for i in range(k)]) \
        if k > 1 else F.col("_pos")
    in_reach = (F.col("_nx._us") - F.col("_us") <= window_us) if window_us else F.lit(True)
    bad = F.col("_nx").isNotNull() & F.when(full, F.col("_nx") <= last).otherwise(in_reach)
    depth = reduce(lambda acc, i: F.when(ok[i], acc).otherwise(F.lit(i)), range(k - 1, -1, -1), F.lit(k))
    return d.where(~bad if k > 1 else F.lit(True)).select(
        "distinct_id", *ORDER, depth.alias("reached"),
        F.when(full, last["_us"] - F.col("_us")).otherwise(F.lit(0)).alias("dur_us"))


def _strict_anchors(rows: DataFrame, k: int, window_us: int, block_rows: int | None) -> DataFrame:
    d = scan.with_blocks(rows, rows_per_block=block_rows)
    cell = F.struct("_us", "_x", F.array(*[F.col(f"_m{i}") for i in range(k)]).alias("m"))

    def leads(frame: DataFrame, w) -> DataFrame:
        return frame.select("*", *[F.lead(cell, i).over(w).alias(f"_l{i}") for i in range(1, k)])

    def result(frame: DataFrame) -> DataFrame:
        reached, bad, dur = F.lit(k), F.lit(False), (F.col(f"_l{k - 1}._us") - F.col("_us") if k > 1 else F.lit(0))
        for i in range(k - 1, 0, -1):
            c = F.col(f"_l{i}")
            stop = c.isNull()
            if window_us:
                stop = stop | (c["_us"] - F.col("_us") > window_us)
            hit = c["_x"]
            match = c["m"][i]
            prev = F.col(f"_l{i - 1}._us") - F.col("_us") if i > 1 else F.lit(0)
            reached = F.when(stop, i).when(hit | match, reached).otherwise(i)
            bad = F.when(stop, False).when(hit, True).when(match, bad).otherwise(False)
            dur = F.when(stop | ~match, prev).otherwise(dur)
        return (frame.where("_m0").withColumn("_bad", bad).where("not _bad")
                .select("distinct_id", *ORDER, reached.alias("reached"), dur.cast("bigint").alias("dur_us")))

    if k == 1:
        return result(d)
    w = scan.block_window("distinct_id", *ORDER)
    d = (d.withColumn("_tail", F.col("_hot") & F.lead(F.lit(1), k - 1).over(w).isNull())
         .withColumn("_head", F.col("_hot") & F.lag(F.lit(1), k).over(w).isNull()))
    inner = leads(d, w).where("not _tail")
    # a tail row's next rows are block heads and tails only: at most 2k rows per block, one small window
    edge = leads(d.where("_head or _tail"), W.partitionBy("distinct_id").orderBy(*ORDER)).where("_tail")
    return result(inner.unionByName(edge))


def outcomes(df: DataFrame, steps, window_s: float = 0, order: str = "ordered", exclude=(),
             block_rows: int | None = None) -> DataFrame:
    """(distinct_id, reached, converted, dur_us) for everyone who entered the funnel."""
    steps = steps_of(*steps)
    k = len(steps)
    if order == "unordered" and len({(s.event, tuple(sorted(s.where.items()))) for s in steps}) < k:
        raise ValueError("an unordered funnel needs distinct steps")
    rows = prepare(drop_sampler(df), steps, exclude, every_event=order == "strict")
    window_us = int(window_s * 1_000_000)
    find = {"ordered": _ordered_anchors, "strict": _strict_anchors, "unordered": _unordered_anchors}[order]
    a = find(rows, k, window_us, block_rows)
    best = a.groupBy("distinct_id").agg(F.min(F.struct((-F.col("reached")).alias("r"), *ORDER, "dur_us")).alias("b"))
    out = best.select("distinct_id", (-F.col("b.r")).cast("bigint").alias("reached"), F.col("b.dur_us").alias("dur_us"))
    return out.where("reached > 0").withColumn("converted", F.col("reached") == k)


def step_table(people: DataFrame, steps, by=()) -> DataFrame:
    """One row per step (and segment) from per-person outcomes."""
    steps = steps_of(*steps)
    k = len(steps)
    by = list(by)
    agg = people.groupBy(*by).agg(*[F.count(F.when(F.col("reached") > i, 1)).alias(f"c{i}") for i in range(k)])
    rows = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(s.event).alias("event"),
                              F.col(f"c{i}").alias("users"), F.col("c0").alias("top"),
                              (F.col(f"c{i - 1}") if i else F.col("c0")).alias("prev"))
                     for i, s in enumerate(steps)])
    t = agg.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return t.select(*by, "step", "event", "users",
                    v.ratio(F.col("users"), F.col("top")).alias("from_top"),
                    v.ratio(F.col("users"), F.col("prev")).alias("from_prev"),
                    (F.col("prev") - F.col("users")).alias("dropped"))


def funnel(df: DataFrame, steps, window_s: float = 0, order: str = "ordered", exclude=()) -> DataFrame:
    return step_table(outcomes(df, steps, window_s, order, exclude), steps)


def funnel_timing(df: DataFrame, steps, window_s: float = 0, order: str = "ordered", exclude=()) -> DataFrame:
    """Converters' first-to-last seconds: count, median, nearest-rank p25/p75/p90."""
    people = outcomes(df, steps, window_s, order, exclude).where("converted")
    q = exact_quantiles(people.withColumn("secs", F.col("dur_us") / 1e6), [], "secs",
                        {"median_secs": "median", "p25_secs": 0.25, "p75_secs": 0.75, "p90_secs": 0.90})
    r = q.select(F.col("n").alias("converted"), *[F.round(c, 6).alias(c) for c in
                                                  ("median_secs", "p25_secs", "p75_secs", "p90_secs")])
    return r.withColumn("anecdote", F.col("converted") < 5)


def entry_segment(df: DataFrame, steps, prop: str) -> DataFrame:
    """(distinct_id, segment): the property on the first event that passes step 0."""
    s0 = steps_of(*steps)[0]
    hit = drop_sampler(df).where(step_match(df, s0))
    val = F.when(v.present(df, prop), F.coalesce(v.text(df, prop), F.lit(""))).otherwise(F.lit("(none)"))
    first = hit.groupBy("distinct_id").agg(F.min(F.struct("timestamp", "id", val.alias("seg"))).alias("f"))
    return first.select("distinct_id", F.col("f.seg").alias("segment"))


def funnel_breakdown(df: DataFrame, steps, prop: str, window_s: float = 0, order: str = "ordered",
                     exclude=(), limit: int = 0) -> DataFrame:
    people = outcomes(df, steps, window_s, order, exclude).join(entry_segment(df, steps, prop), "distinct_id")
    t = step_table(people, steps, by=["segment"])
    if limit:
        top = (t.where("step = 1").orderBy(F.desc("users"), "segment").limit(limit).select("segment"))
        t = t.join(F.broadcast(top), "segment", "left_semi")
    return t


def users_at(df: DataFrame, steps, step: int, state: str, window_s: float = 0, order: str = "ordered",
             exclude=()) -> DataFrame:
    """Drill-down at a 1-based step: reached it, dropped there, or converted the whole funnel."""
    o = outcomes(df, steps, window_s, order, exclude)
    keep = {"reached": F.col("reached") >= step, "converted": F.col("converted"),
            "dropped": (F.col("reached") == step) & ~F.col("converted")}[state]
    return o.where(keep).select("distinct_id", "reached", "converted")
