"""Spelling variants: words that differ by one code point, found with a bit-sliced position index.

Words are runs of letters of whole texts, A-Z lower-cased. Two words are near if they differ by exactly one inserted, deleted
or replaced code point. A pair whose longer word has ``m`` letters agrees in its first ceil(m / 2) or its last floor(m / 2)
letters, so each word joins four groups (as the longer or the shorter word, by prefix and by suffix) and meets all its near
words there. Within a group, every (position, letter) has a bitset over 64 words at a time. A query word walks its letters
and keeps four sets: words without an error so far, and words with one replaced, one extra or one missing letter, which read
the bitsets at its own, the next and the last position. The set without errors after the prefix tells which pairs a prefix
group has found already, so each pair counts once.

The words of a group are ordered by count, so a word's commonest near word is the lowest bit set; no pair is written. Groups
of more than ``BLOCK`` words are dealt over blocks, and their words ask every block.

A null text has no words. A null ``doc_id`` counts as an empty one where runs are edited. Equal counts go to the word that is
smaller by code point. Empty input gives no rows; other columns are not read.
"""
from __future__ import annotations

import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialize

#: Words of an index block, about.
BLOCK = 1 << 15
#: Distinct words that a task counts before it sends them on.
HELD = 400_000
#: Rows, and pairs of a query and 64 words, that are worked on at once.
ROWS, UNITS = 1 << 16, 1 << 19
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, edit_every: int | None = None) -> DataFrame:
    """``word, n``: the runs of at least ``least_length`` code points and ``least_count`` occurrences in ``text``.

    With ``edit_every``, a run whose crc32 (of ``<doc_id>:<run>``) it divides loses the code point at crc32 % length: planted
    slips, the same in every run of the job.
    """
    def counted(batches):
        n: Counter[str] = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, times in Counter(_RUN.findall(text or "")).items():
                    run = run.lower() if run.isascii() else run.translate(_LOWER)
                    if edit_every:
                        h = zlib.crc32(run.encode(), seed)
                        if not h % edit_every:
                            run = run[:h % len(run)] + run[h % len(run) + 1:]
                    if len(run) >= least_length:
                        n[run] += times
                if len(n) >= HELD:
                    yield sent()
                    n.clear()
        if n:
            yield sent()

    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _dealt(vocabulary: DataFrame, block: int) -> DataFrame:
    """A row per word, group and block it asks; ``role`` 0 where it is also part of the index."""
    def groups(m):
        to, back = F.ceil(m / 2).cast("int"), F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), F.lit(0).alias("side"), F.xxhash64(F.substr("word", F.lit(1), to)).alias("part")),
                F.struct(m.alias("m"), F.lit(1).alias("side"), F.xxhash64(F.substr("word", n - back + 1, back)).alias("part"))]

    n = F.char_length("word")
    key = ("m", "side", "part")
    e = vocabulary.select("word", "n", F.explode(F.array(*groups(n), *groups(n + 1))).alias("g")).select("word", "n", "g.*")
    large = e.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    e = e.join(large, list(key), "left").fillna(1, ["blocks"])
    e = e.withColumn("own", F.pmod(F.xxhash64("word", F.lit("block")), F.col("blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return e.select(*key, "block", (F.col("block") != F.col("own")).cast("int").alias("role"), "n", "word")


def _expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as ``count`` says, with running numbers from ``first``."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Index:
    """(chunk of 64 words, position, letter) → the words of the chunk with that letter there, as one 64-bit number."""

    def __init__(self, chunk: np.ndarray, bit: np.ndarray, letters: np.ndarray, first: np.ndarray, size: np.ndarray):
        row, at = _expanded(first, size)
        place = at - first[row]
        self.alphabet, self.long = np.unique(letters[at]), int(size.max(initial=0)) + 2
        key = self._key(chunk[row], place, np.searchsorted(self.alphabet, letters[at]))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        self.keys = key[new]
        self.bits = np.bitwise_or.reduceat((np.uint64(1) << bit[row[order]].astype(np.uint64)), new) if len(new) else np.zeros(0, np.uint64)

    def _key(self, chunk, place, letter):
        return (chunk * self.long + place) * (len(self.alphabet) + 1) + letter

    def coded(self, letters: np.ndarray) -> np.ndarray:
        """Letters as their numbers in the alphabet; one past its end if no word has them."""
        at = np.searchsorted(self.alphabet, letters)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == letters[known]
        return np.where(known, at, len(self.alphabet))

    def look(self, chunk: np.ndarray, place: int, letter: np.ndarray) -> np.ndarray:
        key = self._key(chunk, place, letter)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.bits[at], np.uint64(0))


def _walk(index: Index, chunk, start, size, coded, longer, half, full, of_m, of_less, suffix) -> np.ndarray:
    """The near words of each (query, chunk), sorted by falling query length, that this kind of group answers for."""
    out = np.zeros(len(chunk), np.uint64)
    some = np.arange(len(chunk))
    none = full[chunk]
    shared = np.zeros(len(chunk), np.uint64)
    replaced, extra, missing = (np.zeros(len(chunk), np.uint64) for _ in range(3))

    def done(lo):
        i = some[lo:]
        near = np.where(longer[i], (replaced[lo:] & of_m[chunk[i]]) | (missing[lo:] & of_less[chunk[i]]), (extra[lo:] | none[lo:]) & of_m[chunk[i]])
        out[i] = near & np.where(suffix[i], ~shared[lo:], shared[lo:])

    j = 0
    while len(some):
        live = int(np.searchsorted(-size[some], -j, "left"))     # queries with a letter at j
        if live < len(some):
            done(live)
            some, none, shared, replaced, extra, missing = (x[:live] for x in (some, none, shared, replaced, extra, missing))
            continue
        c, letter = chunk[some], coded[start[some] + j]
        here, ahead = index.look(c, j, letter), index.look(c, j + 1, letter)
        replaced = (replaced & here) | (none & ~here)
        extra = (extra | none) & ahead
        missing = (missing & index.look(c, j - 1, letter) if j else missing) | none
        none = none & here
        shared = np.where(half[some] == j + 1, none, shared)
        j += 1
        left = np.flatnonzero(none | replaced | extra | missing)
        if len(left) < len(some):
            some, none, shared, replaced, extra, missing = (x[left] for x in (some, none, shared, replaced, extra, missing))
    return out


def near_words(unit: np.ndarray, m: np.ndarray, side: np.ndarray, role: np.ndarray, ask: np.ndarray, text: list[str], units: int = UNITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of whole units, in order: (row, number of near words, row of the first of them) for rows that ``ask`` and have any.

    A unit's words of role 0 come first, commonest first, and make its index.
    """
    letters = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, text), np.int64, len(text))
    first = np.cumsum(size) - size
    own = np.flatnonzero(role == 0)
    begin = np.flatnonzero(np.diff(unit, prepend=-1))
    number = np.cumsum(np.diff(unit, prepend=-1) != 0) - 1
    held = np.bincount(number[own], minlength=len(begin))
    chunks = -(-held // 64)
    base = np.cumsum(chunks) - chunks
    rank = own - begin[number[own]]
    chunk, bit = base[number[own]] + rank // 64, rank % 64
    index = Index(chunk, bit, letters, first[own], size[own])
    mask = np.uint64(1) << bit.astype(np.uint64)
    full, of_m, of_less = (np.zeros(int(chunks.sum()), np.uint64) for _ in range(3))
    for to, which in ((full, slice(None)), (of_m, size[own] == m[own]), (of_less, size[own] == m[own] - 1)):
        np.bitwise_or.at(to, chunk[which], mask[which])
    coded = index.coded(letters)
    rows = np.flatnonzero(ask & (chunks[number] > 0))
    found, counts, best = [], [], []
    ends = np.concatenate([[0], np.cumsum(chunks[number[rows]])])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + units, "right")) - 1)
        r = rows[lo:hi]
        r = r[np.argsort(-size[r], kind="stable")]
        q, c = _expanded(base[number[r]], chunks[number[r]])
        of = r[q]
        near = _walk(index, c, first[of], size[of], coded, size[of] == m[of], (m[of] + 1) // 2, full, of_m, of_less, side[of] == 1)
        some = np.flatnonzero(near)
        if len(some):
            new = np.flatnonzero(np.diff(q[some], prepend=-1))
            low = near[some[new]]
            place = (c[some[new]] - base[number[of[some[new]]]]) * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
            found.append(of[some[new]])
            counts.append(np.add.reduceat(np.bitwise_count(near[some]).astype(np.int64), new))
            best.append(begin[number[of[some[new]]]] + place)
        lo = hi
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (found, counts, best))


def _found(rows_at_once: int, units: int):
    """Rows in the order of their units; a unit's index stays while its further queries pass."""
    names = ["m", "side", "part", "block", "role", "n", "word"]

    def answer(t: pa.Table, asked: int):
        key = [t.column(c).to_numpy() for c in names[:4]]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        word = t.column("word").combine_chunks()
        row, count, best = near_words(np.cumsum(new), key[0].astype(np.int64), key[1], t.column("role").to_numpy(), np.arange(t.num_rows) >= asked, word.to_pylist(), units)
        row, best = pa.array(row), pa.array(best)
        return pa.RecordBatch.from_arrays([word.take(row), pa.array(count), word.take(best), t.column("n").combine_chunks().take(best)], names=["word", "n_near", "near", "near_n"])

    def found(batches):
        held, rows, asked = [], 0, 0          # the first ``asked`` rows are answered and stay as an index only
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows - asked < rows_at_once:
                continue
            t = pa.Table.from_batches(held)
            last = np.all([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in names[:4]], axis=0)
            cut = int(np.argmax(last))
            if cut:                            # whole units first; the last one may go on
                yield answer(t.slice(0, cut), asked)
                t, asked = t.slice(cut), max(0, asked - cut)
            role = t.column("role").to_numpy()
            if t.num_rows - asked >= rows_at_once and role[-1]:   # one large unit, whose index is complete
                yield answer(t, asked)
                asked = int((role == 0).sum())
                t = t.slice(0, asked)
            held, rows = t.to_batches(), t.num_rows
        if rows > asked:
            yield answer(pa.Table.from_batches(held), asked)

    return found


def variants(vocabulary: DataFrame, block: int = BLOCK, rows_at_once: int = ROWS, units: int = UNITS) -> DataFrame:
    """``word, n`` → with ``n_near`` (0 if none), ``form`` and ``form_n``, the commonest near word if at least twice as common
    (else null), and ``root``, the last form that following forms leads to."""
    vocabulary = materialize(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    key = ("m", "side", "part", "block")
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(vocabulary, block).repartition(parts, *key).sortWithinPartitions(*key, "role", F.desc("n"), "word")
    found = dealt.mapInArrow(_found(rows_at_once, units), "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b")
    near = found.groupBy(F.col("word").alias("_w")).agg(F.sum("n_near").alias("n_near"), best)
    twice = -F.col("b.minus") >= 2 * F.col("n")
    out = vocabulary.join(near, F.col("word") == F.col("_w"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                                             F.when(twice, F.col("b.near")).alias("form"), F.when(twice, -F.col("b.minus")).alias("form_n"))
    out = materialize(out)
    roots = out.where("form is not null").select(F.col("word").alias("_r"), F.col("form").alias("root"))
    while True:      # counts at least double from form to form, so a chain is short and each round halves it
        on = roots.select(F.col("_r").alias("_at"), F.col("root").alias("_next"))
        roots = materialize(roots.join(on, F.col("root") == F.col("_at"), "left").select("_r", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if roots.where("_moved").isEmpty():
            break
        roots = roots.drop("_moved")
    return out.join(roots.drop("_moved"), F.col("word") == F.col("_r"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
