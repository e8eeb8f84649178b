"""Sharding by histogram sort: probe byte counts below candidate keys, refine until the splitters fit, exchange once.

Rows are ordered by a hash of the text, then a hash of ``doc_id``. A shard is the rows between two splitters; each holds the
same number of bytes within ``tolerance``. Equal texts are neighbours and stay together unless only a cut through them keeps
the sizes equal. Rows with equal text and equal ``doc_id`` are never parted.

A null text counts no bytes, and every row counts one more. Empty input gives no rows. Null ``doc_id`` is a value like any
other; extra columns pass through; names that start with an underscore are the operator's.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import order
from eventloom.session import materialize

LOW, HIGH = -(1 << 62), 1 << 62   # hashes without their last bit: differences fit a long
PROBES = 1 << 14                  # counts that reach the driver in a round, over all splitters


def size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keys(text: Column, doc_id: Column) -> tuple[Column, Column]:
    return F.shiftright(F.xxhash64(text), 1), F.shiftright(F.xxhash64(doc_id), 1)


@dataclass(frozen=True)
class Span:
    """Where a splitter lies: in [lo, hi), with so many bytes below each end."""
    target: float
    lo: int
    hi: int
    below_lo: int
    below_hi: int

    def best(self) -> tuple[int, int]:
        return min((self.lo, self.below_lo), (self.hi, self.below_hi), key=lambda e: abs(e[1] - self.target))


def _narrow(rows: DataFrame, key: str, spans: list[Span], allowed: float) -> list[Span]:
    """Rounds of exact counts below evenly spaced probes, until each span has a fitting end or is one key wide."""
    while True:
        open_ = sorted({(s.lo, s.hi, s.below_lo) for s in spans if abs(s.best()[1] - s.target) > allowed and s.hi - s.lo > 1})
        if not open_:
            return spans
        k = F.col(key)
        ends = sorted({e for lo, hi, _ in open_ for e in (lo, hi)})
        at = {lo: i for i, lo in enumerate(ends)}
        per = max(2, PROBES // len(open_))
        step = {lo: -(-(hi - lo) // per) for lo, hi, _ in open_}
        slot = order.upper_bound(ends, k) - 1
        lows = F.array(*(F.lit(e).cast("long") for e in ends))
        steps = F.array(*(F.lit(step.get(e)).cast("long") for e in ends))
        inside = rows.withColumn("_slot", slot).where((F.col("_slot") >= 0) & F.get(steps, F.col("_slot")).isNotNull())
        counts = inside.groupBy("_slot", F.call_function("div", k - F.get(lows, F.col("_slot")), F.get(steps, F.col("_slot"))).alias("_probe")).agg(F.sum("_size").alias("bytes")).collect()
        found: dict[int, list[tuple[int, int]]] = {}
        for r in counts:
            found.setdefault(r["_slot"], []).append((r["_probe"], r["bytes"]))
        after = []
        for s in spans:
            if (s.lo, s.hi, s.below_lo) not in open_:
                after.append(s)
                continue
            below, w = s.below_lo, step[s.lo]
            lo, hi, below_hi = s.lo, s.hi, s.below_hi
            for probe, b in sorted(found.get(at[s.lo], [])):
                left, right = s.lo + probe * w, min(s.hi, s.lo + (probe + 1) * w)
                if below + b >= s.target:
                    lo, hi, below_hi = left, right, below + b
                    break
                below += b
            after.append(replace(s, lo=lo, hi=hi, below_lo=below, below_hi=below_hi))
        spans = after


def splitters(docs: DataFrame, shards: int, tolerance: float = 0.002) -> list[tuple[int, int]]:
    """``shards - 1`` key pairs. ``tolerance`` is a share of a shard; only counts reach the driver."""
    a, b = keys(F.col("text"), F.col("doc_id"))
    rows = materialize(docs.select(a.alias("_a"), b.alias("_b"), size(F.col("text")).alias("_size")))
    total = rows.select(F.sum("_size")).first()[0] or 0
    if not total:
        return [(HIGH, LOW)] * (shards - 1)
    allowed = tolerance * total / shards
    spans = _narrow(rows, "_a", [Span(total * i / shards, LOW, HIGH, 0, total) for i in range(1, shards)], allowed)
    cut: dict[int, list[int]] = {}
    for i, s in enumerate(spans):
        if abs(s.best()[1] - s.target) > allowed:
            cut.setdefault(s.lo, []).append(i)    # one text's copies hold the target: part them by doc_id
    result = [(s.best()[0], LOW) for s in spans]
    for group, members in cut.items():
        inner = _narrow(rows.where(F.col("_a") == group), "_b", [replace(spans[i], lo=LOW, hi=HIGH) for i in members], allowed)
        for i, s in zip(members, inner):
            result[i] = (group, s.best()[0])
    return result


def assign(docs: DataFrame, shards: int, tolerance: float = 0.002) -> DataFrame:
    """Adds ``shard``: comparisons with the splitters, no join and no shuffle."""
    a, b = keys(F.col("text"), F.col("doc_id"))
    return docs.withColumn("shard", order.upper_bound(splitters(docs, shards, tolerance), a, b).cast("int"))


def layout(sharded: DataFrame) -> DataFrame:
    """The one exchange: rows sorted by shard and key over as many tasks as wanted; adds ``slot``, gapless from 0 in each shard."""
    a, b = keys(F.col("text"), F.col("doc_id"))
    keyed = sharded.withColumns({"_a": a, "_b": b})
    return order.numbered(order.positions(keyed, F.col("shard"), F.col("_a"), F.col("_b")), "slot", "shard").drop("_a", "_b")
