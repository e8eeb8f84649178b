"""Product codes of vectors: one codebook per part of the vector, refined by ball k-means.

Vectors become integers (floor(scale * x)) and are cut into equal consecutive parts. Each part position starts from the parts
of the vectors with the smallest ids; every round assigns each part to its nearest entry (squared distance, ties to the lower
index) and moves each entry to the floored mean of its parts. All of it is integer arithmetic, so results do not depend on
partitions.

The first assignment compares all entries. Later ones start from the entry a part had: its ball's radius (over the parts of a
block) leaves the entries within twice that as neighbours; a part nearer to its centre than half the way to the closest
neighbour is in the stable core and stays; the others lie in rings between half distances, and a part is compared only with
the neighbours whose half distance its ring has passed. The conditions are the triangle inequality in whole numbers, with
equality kept, so the result is that of comparing with every entry.

Blocks of vectors are written once, dealt by block; only codes (a byte per part) move between rounds. Tasks add up their
blocks' counts and sums, and the driver sees entries x positions numbers.

Rows whose vector is null, empty, has null or non-finite components, or another length than the vector of the smallest id are
left out. A length that ``parts`` does not divide is filled up with zeros. Null ids come last; equal ids are ordered by
vector. Fewer vectors than ``entries`` give as many entries. Integers beyond 2^23 are refused, as sums of squares would no
longer be exact. Empty input gives no rows. ``label`` may be null; null labels are one group.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialize

LARGEST = 1 << 23
#: Numbers of a matrix of distances at most.
CELLS = 1 << 22


@dataclass
class Coded:
    """``rows``: ``vec_id, label, code`` (hex) and ``error``; ``books``: per part, entries x width integers."""

    rows: DataFrame
    books: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _nearest(x: np.ndarray, book: np.ndarray, allowed: np.ndarray | None = None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance; ties to the lower name. Exact: all numbers are below 2^53."""
    names = np.arange(len(book)) if names is None else names
    best, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, CELLS // len(book))
    for lo in range(0, len(x), step):
        own = x[lo:lo + step]
        d = _squares(own)[:, None] - 2 * (own @ book.T) + _squares(book)
        if allowed is not None:
            d[np.arange(len(book)) >= allowed[lo:lo + step, None]] = np.inf
        low = d.min(1)
        best[lo:lo + step] = np.where(d == low[:, None], names, len(book) + names.max() + 1).min(1)
        far[lo:lo + step] = low
    return best, far


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ball k-means: the nearest entry of each row and its squared distance, from the entry each row had."""
    own = _squares(x - book[code]).astype(np.int64)
    out, far = code.copy(), own.copy()
    between = (_squares(book)[:, None] - 2 * (book @ book.T) + _squares(book)).astype(np.int64)
    order = np.argsort(code, kind="stable")
    used, first = np.unique(code[order], return_index=True)
    for c, rows in zip(used.tolist(), np.split(order, first[1:])):
        reach = 4 * own[rows]
        gap = between[c].copy()
        gap[c] = -1
        near = np.flatnonzero((gap <= reach.max()) & (gap >= 0))            # neighbours of the ball
        near = near[np.argsort(gap[near], kind="stable")]
        ring = np.searchsorted(gap[near], reach, "right")                   # 0: the stable core
        outside = np.flatnonzero(ring)
        outside = outside[np.argsort(ring[outside], kind="stable")]
        lo = 0
        while lo < len(outside):                                            # rings whose sizes lie within a factor of two
            hi = int(np.searchsorted(ring[outside], 2 * ring[outside[lo]], "right"))
            some = outside[lo:hi]
            r, k = rows[some], ring[some]
            name, d = _nearest(x[r], book[near[:k[-1]]], k, near[:k[-1]])
            moved = (d < own[r]) | ((d == own[r]) & (name < c))
            out[r[moved]], far[r[moved]] = name[moved], d[moved]
            lo = hi
    return out, far


_BLOCKS = "block long, n int, vec_ids binary, ids_null binary, labels binary, labels_null binary, data binary"


def _blocks(width: int):
    """Arrow batches as one row each: ids, labels and the parts as numbers of as few bytes as hold them."""
    def blocks(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1)
            full = np.zeros((b.num_rows, width), np.int32)
            full[:, :x.shape[1]] = x
            kept = [pa.array([part + made]), pa.array([b.num_rows], pa.int32())]
            for c in ("vec_id", "label"):
                v = b.column(c)
                kept += [pa.array([np.asarray(v.fill_null(0)).astype(np.int64).tobytes()]), pa.array([np.packbits(np.asarray(v.is_null())).tobytes()])]
            small = full.astype(np.int16) if np.abs(full).max(initial=0) < 1 << 15 else full
            yield pa.RecordBatch.from_arrays([*kept, pa.array([small.tobytes()])], names=["block", "n", "vec_ids", "ids_null", "labels", "labels_null", "data"])
            made += 1
    return blocks


def _matrix(data: bytes, n: int, width: int, parts: int) -> list[np.ndarray]:
    x = np.frombuffer(data, np.int16 if len(data) == 2 * n * width else np.int32).reshape(n, parts, width // parts)
    return [x[:, p].astype(np.float64) for p in range(parts)]


def _assigned(x: list[np.ndarray], books: list[np.ndarray], codes: bytes | None) -> list[tuple[np.ndarray, np.ndarray]]:
    if codes is None:
        return [_nearest(p, b.astype(float)) for p, b in zip(x, books)]
    had = np.frombuffer(codes, np.uint16).reshape(len(x), -1).astype(np.int64)
    return [reassign(p, b.astype(float), h) for p, b, h in zip(x, books, had)]


def _round(width: int, books: list[np.ndarray]):
    """Codes of each block, and at the end of the task a row per part and entry: how many parts it got and their sums."""
    parts = len(books)

    def step(batches):
        sums = [np.zeros((len(b), 1 + b.shape[1]), np.int64) for b in books]
        for batch in batches:
            for r in batch.to_pylist():
                x = _matrix(r["data"], r["n"], width, parts)
                code = [c for c, _ in _assigned(x, books, r["codes"])]
                for p, (own, c) in enumerate(zip(x, code)):
                    order = np.argsort(c, kind="stable")
                    used, first = np.unique(c[order], return_index=True)
                    sums[p][used, 0] += np.diff(np.append(first, len(c)))
                    sums[p][used, 1:] += np.add.reduceat(own[order].astype(np.int64), first, axis=0)
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "codes": np.concatenate(code).astype(np.uint16).tobytes(), "part": None, "entry": None, "sums": None}], schema=schema)
        found = [{"block": None, "codes": None, "part": p, "entry": int(e), "sums": s[e].tolist()} for p, s in enumerate(sums) for e in np.flatnonzero(s[:, 0])]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))])
    return step


def _last(width: int, books: list[np.ndarray]):
    """``vec_id, label, code, error`` of every vector."""
    def step(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                got = _assigned(_matrix(r["data"], n, width, len(books)), books, r["codes"])
                digits = 2 if max(map(len, books)) <= 256 else 4
                code = ["".join(f"{int(i):0{digits}x}" for i in row) for row in np.stack([c for c, _ in got], 1)]
                own = [pa.array(np.frombuffer(r[c], np.int64), mask=np.unpackbits(np.frombuffer(r[m], np.uint8))[:n].astype(bool)) for c, m in (("vec_ids", "ids_null"), ("labels", "labels_null"))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(code), pa.array(np.sum([d for _, d in got], axis=0))], names=["vec_id", "label", "code", "error"])
    return step


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Coded:
    """Codes of ``vec_id, embedding, label``: ``label`` and ``vec_id`` are whole numbers."""
    if entries > 1 << 16:
        raise ValueError("a code has at most 16 bits")
    spark = vectors.sparkSession
    raw = F.col("embedding").cast("array<double>")
    usable = F.coalesce((F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    v = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), raw.alias("x"))
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))))
    seeds = v.select("vec_id", "x", whole.alias("w")).orderBy(F.col("vec_id").asc_nulls_last(), "x")
    length = len((seeds.first() or {"x": []})["x"])
    if not length:
        return Coded(spark.createDataFrame([], "vec_id long, label long, code string, error long"), [np.zeros((0, 0), np.int64)] * parts)
    width = -(-length // parts) * parts
    rows = [r["w"] for r in seeds.where(F.size("x") == length).limit(entries).collect()]
    first = np.zeros((len(rows), width), np.int64)
    first[:, :length] = rows
    books = [first[:, p * width // parts:(p + 1) * width // parts] for p in range(parts)]
    fits = F.when(F.forall(whole, lambda x: F.abs(x) <= LARGEST), whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")).cast("array<int>"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = v.where(F.size("x") == length).select("vec_id", "label", fits.alias("x")).mapInArrow(_blocks(width), _BLOCKS)
    blocks = materialize(blocks.repartition(n, "block").sortWithinPartitions("block"))
    codes = None

    def coded() -> DataFrame:
        if codes is None:
            return blocks.withColumn("codes", F.lit(None).cast("binary"))
        return blocks.join(codes.select(F.col("block").alias("_b"), "codes").hint("shuffle_hash"), F.col("block") == F.col("_b")).drop("_b")

    for _ in range(rounds):
        done = materialize(coded().select("block", "n", "data", "codes").mapInArrow(_round(width, books), "block long, codes binary, part int, entry int, sums array<long>"))
        codes = done.where("block is not null")
        size = width // parts + 1
        sums = done.where("part is not null").groupBy("part", "entry").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).alias("s")).collect()
        books = [b.copy() for b in books]
        for r in sums:
            s = np.asarray(r["s"], np.int64)
            books[r["part"]][r["entry"]] = s[1:] // s[0]
    out = coded().select("n", "vec_ids", "ids_null", "labels", "labels_null", "data", "codes").mapInArrow(_last(width, books), "vec_id long, label long, code string, error long")
    return Coded(materialize(out), books)
