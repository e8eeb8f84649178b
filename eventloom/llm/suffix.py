"""Repeated byte strings by distributed prefix doubling.

Every position of a text has a name for the string of length h that starts there. Names of length 2h come from pairs of names,
(name(p), name(p + h)), so lengths double from single bytes up to the wanted one, over the offsets 1, 2, 4, ... As matches
never cross documents, the pairs of a document lie together, and Spark ranks names where documents must meet: first those of
half length at sparse positions, then those of full length at all positions that are still not unique. What is unique at one
length is unique at all longer ones and takes no part any more.

The sparse positions are those whose half-length name is the smallest of a full-length string (ties: all of them), so equal
strings have equal ones; about one position in a quarter of the length is one. A text with no repeated sparse name has no
repeated string. The texts left are packed; each pack sends its distinct full-length names once to ranges of names, gets a bit
back for each that another pack has too, and adds those that it holds twice itself. No range, pack or task holds a group: a
string with very many occurrences is one name per pack.

Texts that occur more than once are wholly repeated if long enough, and take part in the ranking once. Null texts are empty.
Empty input gives no rows. Names have 64 bits: at 10^10 surviving positions, the expected number of false repeats is about 3.

Passages are the same on words: runs of a number of words, whatever white space lies between them, that another document has too.
Nothing is removed for them; they are counted. Marks are the sparse positions of words, and a run counts once a document however
often the document repeats it, so a line that only one document repeats is none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.arrays import buffers, constants, mix, slices, words
from eventloom.session import materialize

PACK = 1 << 21
#: Distinct names that a range gets, about.
RANGE = 1 << 19
_C = constants(3, 901)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` bytes, by doubling."""
    n = mix(data.astype(np.uint64) + _C[2])
    h = 1
    while h < length:
        step = min(h, length - h)      # the last step overlaps if the length is no power of two
        n = mix(n[:len(n) - step] * _C[0] + n[step:] * _C[1]) if len(n) > step else n[:0]
        h += step
    return n


def _slide(x: np.ndarray, w: int, pick, rest) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``w`` in a row, in two passes."""
    n = len(x) - w + 1
    k = -(-len(x) // w)
    y = np.full(k * w, rest, x.dtype)
    y[:len(x)] = x
    y = y.reshape(k, w)
    ahead = pick.accumulate(y, axis=1).ravel()
    back = pick.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[w - 1:w - 1 + n])


def smallest(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-length names; the smallest within each full-length string; where such strings start."""
    half = length // 2
    n = names(data, half)
    if len(data) < length:
        return n, n[:0], np.zeros(0, bool)
    low = _slide(n, length - half + 1, np.minimum, _TOP)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    return n, low, left[:len(low)] >= length


def sparse(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose half-length name is the smallest of some full-length string, and their names."""
    n, low, ok = smallest(data, at, length)
    if not ok.any():
        return np.zeros(0, np.int64), n[:0]
    w = length - length // 2 + 1
    reach = np.zeros(len(n) + w - 1, np.uint64)
    reach[w - 1:w - 1 + len(low)] = np.where(ok, low, 0)
    p = np.flatnonzero(n == _slide(reach, w, np.maximum, 0))
    return p, n[p]


_SPARSE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x1", T.LongType()), T.StructField("x2", T.LongType()), T.StructField("whole", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("names", T.ArrayType(T.LongType())), T.StructField("twice", T.ArrayType(T.BooleanType())),
                         T.StructField("n_words", T.LongType()), T.StructField("marks", T.ArrayType(T.LongType()))])


def _distinct(p: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names of each row, how often it has them, and where each row's begin."""
    row = np.searchsorted(own, p, "right") - 1
    order = np.lexsort((n, row))
    row, n = row[order], n[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (n[1:] != n[:-1]))[:len(n)])
    return n[new].view(np.int64), np.diff(np.append(new, len(n))), np.searchsorted(row[new], np.arange(1, len(own)))


def _sparse_rows(length: int, run: int):
    def rows(batches):
        for b in batches:
            data, at = buffers(b.column("text"))
            found, twice, ends, n_words, marks, mark_ends = [], [], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [], [np.zeros(1, np.int64)]
            for lo, hi in slices(at):
                own = at[lo:hi + 1] - at[lo]
                n, times, end = _distinct(*sparse(data[at[lo]:at[hi]], own, length), own)
                found.append(n)
                twice.append(times > 1)
                ends.append(end + ends[-1][-1])
                if run:
                    w, first = words(data[at[lo]:at[hi]], own, lower=False)
                    n_words.append(np.diff(first))
                    n, _, end = _distinct(*sparse(w, first, run), first)
                    marks.append(n)
                    mark_ends.append(end + mark_ends[-1][-1])
            if not run:
                n_words, mark_ends = [np.zeros(b.num_rows, np.int64)], [np.zeros(b.num_rows + 1, np.int64)]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(e).astype(np.int32)), pa.array(np.concatenate(v) if v else np.zeros(0, kind)))
                     for e, v, kind in ((ends, found, np.int64), (ends, twice, bool), (mark_ends, marks, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("x1"), b.column("x2"), b.column("whole"), pa.array(np.diff(at)), *lists[:2], pa.array(np.concatenate(n_words)), lists[2]], names=_SPARSE.names)
    return rows


_PACKS = T.StructType([T.StructField("pack", T.LongType()), T.StructField("x1", T.ArrayType(T.LongType())), T.StructField("x2", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
                       T.StructField("data", T.BinaryType()), T.StructField("open", T.BinaryType())])
_PACKS_ARROW = pa.schema([("pack", pa.int64()), ("x1", pa.list_(pa.int64())), ("x2", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary()), ("open", pa.binary())])


def _pack_rows(length: int, run: int):
    """Texts that have a repeated sparse name, a few MB to a row, with a bit for each string that is still open. Those that have
    a repeated mark are in rows of their own, without bits, as the names of their open runs."""
    def rows(batches):
        part, made, held, runs = TaskContext.get().partitionId() << 32, 0, [], []

        def row(held):
            open_ = None if held[0][3] is None else np.packbits(np.concatenate([h[3] for h in held])).tobytes()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([part + made], [[h[0] for h in held]], [[h[1] for h in held]], [np.cumsum([len(h[2]) for h in held])], [b"".join(h[2].tobytes() for h in held)], [open_]), _PACKS_ARROW.types)], schema=_PACKS_ARROW)

        for b in batches:
            data, at = buffers(b.column("text"))
            x1, x2, repeated, marked = b.column("x1").to_pylist(), b.column("x2").to_pylist(), b.column("names"), b.column("marks")
            for i in range(b.num_rows):
                d = data[at[i]:at[i + 1]]
                own = np.array([0, len(d)])
                if len(repeated[i].values):
                    _, low, ok = smallest(d, own, length)
                    open_ = np.zeros(len(d), bool)
                    open_[:len(low)] = ok & np.isin(low, repeated[i].values.to_numpy().view(np.uint64))
                    held.append((x1[i], x2[i], d, open_))
                    if sum(len(h[2]) for h in held) >= PACK:
                        yield row(held)
                        held, made = [], made + 1
                if len(marked[i].values):
                    w, first = words(d, own, lower=False)
                    _, low, ok = smallest(w, first, run)
                    runs.append((x1[i], x2[i], names(w, run)[ok & np.isin(low, marked[i].values.to_numpy().view(np.uint64))], None))
                    if sum(len(h[2]) for h in runs) >= PACK >> 3:
                        yield row(runs)
                        runs, made = [], made + 1
        for rest in (held, runs):
            if rest:
                yield row(rest)
                made += 1
    return rows


def _open_names(data: np.ndarray, bits: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:len(data)])
    return at, names(data, length)[at]


def _sent(length: int, ranges: int):
    """The distinct names of each pack by range; a pack without bits holds the names themselves."""
    def sent(batches):
        for b in batches:
            for pack, data, bits in zip(b.column("pack").to_pylist(), b.column("data"), b.column("open").to_pylist()):
                n = np.unique(np.frombuffer(data.as_buffer(), np.uint64) if bits is None else _open_names(np.frombuffer(data.as_buffer(), np.uint8), bits, length)[1])
                of = (n >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                cut = np.searchsorted(of, np.arange(ranges + 1).astype(np.uint64))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), pack)), pa.array([n[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary())], names=["range", "pack", "names"])
    return sent


def _met(table: pa.Table) -> pa.Table:
    """Of one range: a bit for each name of each pack, set if another pack has it too."""
    own = [np.frombuffer(v.as_buffer(), np.uint64) for c in table.column("names").chunks for v in c]
    all_, count = np.unique(np.concatenate(own), return_counts=True)
    bits = [np.packbits(count[np.searchsorted(all_, n)] > 1).tobytes() for n in own]
    return pa.table({"pack": table.column("pack"), "range": table.column("range"), "bits": pa.array(bits, pa.binary())})


def _again(own: np.ndarray, again: np.ndarray, met: pa.Table, ranges: int) -> np.ndarray:
    """``again``, or met in another pack, for the sorted names of a pack."""
    of = (own >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    edge = np.searchsorted(of, np.arange(ranges + 1).astype(np.uint64))
    for i, bits in zip(met.column("range").to_pylist(), met.column("bits").to_pylist()):
        again[edge[i]:edge[i + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8))[:edge[i + 1] - edge[i]].astype(bool)
    return again


_SPANS = T.StructType([T.StructField("x1", T.LongType()), T.StructField("x2", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])


def _cut(length: int, ranges: int):
    def cut(packs: pa.Table, met: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _SPANS.names}
        for r in packs.to_pylist():
            data = np.frombuffer(r["data"], np.uint8)
            at, n = _open_names(data, r["open"], length)
            own, first, count = np.unique(n, return_inverse=True, return_counts=True)
            again = _again(own, count > 1, met, ranges)
            steps = np.zeros(len(data) + 1, np.int64)
            hit = at[again[first]]
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + length, -1)
            gone = np.cumsum(steps[:-1]) > 0
            lo = 0
            for x1, x2, hi in zip(r["x1"], r["x2"], r["ends"]):
                g = np.concatenate([[0], gone[lo:hi].astype(np.int8), [0]])
                turn = np.diff(g)
                starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                if len(starts):
                    for c, v in zip(_SPANS.names, (x1, x2, starts, ends, data[lo:hi][~gone[lo:hi]].tobytes())):
                        out[c].append(v)
                lo = hi
        return pa.table({"x1": pa.array(out["x1"], pa.int64()), "x2": pa.array(out["x2"], pa.int64()), "starts": pa.array(out["starts"], pa.list_(pa.int64())), "ends": pa.array(out["ends"], pa.list_(pa.int64())), "kept": pa.array(out["kept"], pa.binary())})
    return cut


def _count(ranges: int):
    def count(packs: pa.Table, met: pa.Table) -> pa.Table:
        out: dict[str, list] = {"x1": [], "x2": [], "n_shared": []}
        for r in packs.to_pylist():
            own, first = np.unique(np.frombuffer(r["data"], np.uint64), return_inverse=True)
            lists = np.split(first, r["ends"][:-1])
            holders = np.zeros(len(own), np.int64)
            for f in lists:
                holders[np.unique(f)] += 1
            again = _again(own, holders > 1, met, ranges)
            out["x1"] += r["x1"]
            out["x2"] += r["x2"]
            out["n_shared"] += [int(again[f].sum()) for f in lists]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return count


def repeated(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """``rows``: ``doc_id, x1, x2, whole, n_bytes`` of every document, x1 and x2 naming its text, ``whole`` its SHA-256; ``texts``: for each text with a repeated
    string, ``x1, x2, starts, ends`` (the bytes it loses) and ``kept``, the rest."""
    return repeated_and_shared(docs, length, 0)[:2]


def repeated_and_shared(docs: DataFrame, length: int, run: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` and ``texts`` as above; ``shared``: ``x1, x2, n_shared`` of texts, the starts of ``run`` words in a row that another document has too (0: none looked for)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), F.col("text")).alias("x2"))
    found = materialize(d.withColumn("whole", F.sha2("text", 256)).mapInArrow(_sparse_rows(length, run), _SPARSE))
    long = found.where((F.col("n_bytes") >= length) | (F.size("marks") > 0))
    texts = long.groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("doc_id"), F.first("names").alias("names"), F.first("twice").alias("twice"), F.first("n_bytes").alias("n_bytes"),
                                         F.first("n_words").alias("n_words"), F.first("marks").alias("marks"))
    texts = materialize(texts)
    each = F.concat(F.transform(F.arrays_zip("names", "twice"), lambda z: F.struct(z["names"].alias("name"), z["twice"].alias("twice"), F.lit(False).alias("mark"))),
                    F.transform("marks", lambda m: F.struct(m.alias("name"), F.lit(False).alias("twice"), F.lit(True).alias("mark"))))
    at = texts.select("x1", "x2", "doc_id", F.explode(each).alias("_z")).select("x1", "x2", "doc_id", "_z.*")
    twice = at.groupBy("name", "mark").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("_n")).where("_n > 1").select("name", "mark")
    some = at.join(twice, ["name", "mark"], "left_semi").groupBy("x1", "x2", "doc_id").agg(F.collect_list(F.when(~F.col("mark"), F.col("name"))).alias("names"), F.collect_list(F.when(F.col("mark"), F.col("name"))).alias("marks"))
    s = some.select(F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), F.col("doc_id").alias("_id"), "names", "marks")
    left = d.join(s, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("x1") == F.col("_x1")) & (F.col("x2") == F.col("_x2"))).select("x1", "x2", "text", "names", "marks")
    both = materialize(left.mapInArrow(_pack_rows(length, run), _PACKS))

    def met(packs: DataFrame, ranges: int) -> DataFrame:
        sent = packs.select("pack", "data", "open").mapInArrow(_sent(length, ranges), "range long, pack long, names binary")
        return sent.groupBy("range").applyInArrow(_met, "pack long, range long, bits binary").groupBy("pack")

    sizes = dict(both.groupBy(F.isnull("open")).agg(F.sum(F.octet_length("data"))).collect())
    packs, runs = both.where("open IS NOT NULL"), both.where("open IS NULL")
    ranges = max(parts, -(-sizes.get(False, 0) // RANGE))
    cut = packs.groupBy("pack").cogroup(met(packs, ranges)).applyInArrow(_cut(length, ranges), _SPANS)
    copies = texts.where((F.col("times") > 1) & (F.col("n_bytes") >= length)).select("x1", "x2", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"), F.lit(b"").alias("kept"))
    single = texts.where("times = 1").select(F.col("x1").alias("_x1"), F.col("x2").alias("_x2"))
    one = (F.col("x1") == F.col("_x1")) & (F.col("x2") == F.col("_x2"))
    ranges = max(parts, -(-sizes.get(True, 0) // (8 * RANGE)))
    shared = runs.groupBy("pack").cogroup(met(runs, ranges)).applyInArrow(_count(ranges), "x1 long, x2 long, n_shared long").join(single, one, "left_semi")
    shared = shared.unionByName(texts.where(F.col("times") > 1).select("x1", "x2", F.greatest(F.lit(0).cast("long"), F.col("n_words") - (run - 1)).alias("n_shared")))
    return found.drop("names", "twice", "n_words", "marks"), cut.join(single, one, "left_semi").unionByName(copies), shared
