"""Benchmark decontamination by greedy string tiling.

Documents and test items are word sequences (lower-cased, split at ASCII white space). Runs of ``least`` words that a
document shares with an item make the pair a candidate. For each candidate, running Karp-Rabin tiling repeatedly marks the
longest common run that overlaps no earlier one, from long runs down to ``least`` words; the item's coverage is its share of
marked words, so passages in another order count as well. A document is contaminated if it covers ``coverage`` of some item.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES`` of text, one narrow pass over the documents for each
block, so a larger benchmark takes more passes and never more memory; documents are not shuffled.

Null and empty texts match nothing; an item of fewer than ``least`` words counts as one run. Repeated documents are judged alike;
ties between items go to the one met first by id. An empty benchmark marks nothing. Extra columns pass through, and the
operator's own (n_words, n_items, item_id, coverage, contaminated) replace those of the input.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.arrays import buffers, shingles, slices, words
from eventloom.llm.columns import hidden
from eventloom.llm.shared import shared

BLOCK_BYTES = 8 << 20
OWN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType())])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tile(text: np.ndarray, item: np.ndarray, least: int) -> int:
    """Words of ``item`` covered by tiles, the longest first."""
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    least = min(least, len(item))
    n = max(least, min(len(item), len(text)))
    while True:
        seen: dict[int, list[int]] = {}
        whole = lambda free: np.convolve(free, np.ones(n, int), "valid") == n
        if n <= len(text) and n <= len(item):
            for i, h in zip(np.flatnonzero(whole(free_i)).tolist(), _hashes(item, n)[whole(free_i)].tolist()):
                seen.setdefault(h, []).append(i)
            ht, free = _hashes(text, n), whole(free_t)
            at = np.flatnonzero(free & np.isin(ht, np.fromiter(seen, np.uint64, len(seen)))) if seen else []
            found = []
            for t in at:
                for i in seen[int(ht[t])]:
                    if not np.array_equal(text[t:t + n], item[i:i + n]):
                        continue
                    k = n
                    while t + k < len(text) and i + k < len(item) and free_t[t + k] and free_i[i + k] and text[t + k] == item[i + k]:
                        k += 1
                    found.append((-k, int(t), i))
            # a run whose end was covered meanwhile goes back with its free head; what is left of a covered head has its own entry
            heapq.heapify(found)
            while found:
                k, t, i = heapq.heappop(found)
                free = free_t[t:t - k] & free_i[i:i - k]
                if free.all():
                    free_t[t:t - k] = free_i[i:i - k] = False
                elif (k := int(free.argmin())) >= n:
                    heapq.heappush(found, (-k, t, i))
        if n <= least or free_i.sum() < least:
            return int((~free_i).sum())
        n = max(least, n // 2)


def _hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` words: each longer hash is made from two shorter ones."""
    h, size, power = w, 1, np.asarray([_BASE])   # arrays wrap around without a warning
    while 2 * size <= n:
        h = h[:len(h) - size] * power + h[size:]
        power, size = np.multiply(power, power), 2 * size
    if size < n:
        h = h[:len(w) - n + 1] * power + h[n - size:]
    return h


class Block:
    """Items as word hashes, and their runs in sorted order."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.ids = least, [i for i, _ in items]
        w, first = words(*buffers(pc.utf8_lower(pa.array([t for _, t in items], pa.string()))))
        self.items = [w[a:b] for a, b in zip(first[:-1], first[1:])]
        seeds, begin = shingles(w, first, least)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], np.repeat(np.arange(len(items)), np.diff(begin))[order]
        self.short = {len(x) for x in self.items if 0 < len(x) < least}
        self.short_seeds = {n: [(i, x) for i, x in enumerate(self.items) if len(x) == n] for n in self.short}

    def candidates(self, w: np.ndarray, first: np.ndarray) -> dict[int, set[int]]:
        """Items that share a run with each document."""
        out: dict[int, set[int]] = {}
        if not len(self.seeds):
            return out
        runs, begin = shingles(w, first, self.least, whole=False)
        lo = np.searchsorted(self.seeds, runs)
        hit = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == runs)
        hi = np.searchsorted(self.seeds, runs[hit], "right")
        for d, a, b in zip((np.searchsorted(begin, hit, "right") - 1).tolist(), lo[hit].tolist(), hi.tolist()):
            out.setdefault(d, set()).update(self.owner[a:b].tolist())
        for n, items in self.short_seeds.items():
            for i, x in items:
                for at in np.flatnonzero(w == x[0]).tolist():
                    d = int(np.searchsorted(first, at, "right")) - 1
                    if at + n <= first[d + 1] and np.array_equal(w[at:at + n], x):
                        out.setdefault(d, set()).add(i)
        return out


def _blocks(benchmark: DataFrame, least: int):
    """The benchmark in blocks of bounded size, drawn by a hash of the item."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = b.select(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_BYTES))
    for i in range(n if total else 0):
        own = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield Block(sorted({(r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in own}), least)


def annotate(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """The documents with ``n_words``, ``n_items`` (candidates), the best ``item_id``, its ``coverage`` and ``contaminated``."""
    kept = [c for c in docs.columns if c not in (*OWN.names, "contaminated")]
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"))
    schema = T.StructType([docs.schema[c] for c in kept] + OWN.fields)
    for block in _blocks(benchmark, least):
        out = out.mapInArrow(_judge(shared(docs.sparkSession, block), kept), schema)
    return out.withColumn("contaminated", F.col("coverage") >= coverage)


def _judge(sent, kept: list[str]):
    def judged(batches):
        block = sent()
        for b in batches:
            data, at = buffers(pc.utf8_lower(b.column("text")))
            n_words = np.zeros(b.num_rows, np.int64)
            n_items, best, most = (b.column(c).to_pylist() for c in ("n_items", "item_id", "coverage"))
            for lo, hi in slices(at):
                w, first = words(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                n_words[lo:hi] = np.diff(first)
                for d, items in block.candidates(w, first).items():
                    n_items[lo + d] += len(items)
                    for i in sorted(items):
                        share = tile(w[first[d]:first[d + 1]], block.items[i], block.least) / len(block.items[i])
                        if share > most[lo + d]:
                            most[lo + d], best[lo + d] = share, block.ids[i]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(n_words), pa.array(n_items, pa.int64()), pa.array(best, pa.int64()), pa.array(most, pa.float64())], names=[*kept, *OWN.names])
    return judged


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """The documents that are not contaminated, in their own columns."""
    docs, back = hidden(docs, (*OWN.names, "contaminated"))
    return back(annotate(docs, benchmark, least, coverage).where(~F.col("contaminated")))
