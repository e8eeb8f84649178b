"""Fingerprints by quartile buckets: hashed byte triplets are counted, and each bucket's quartile is written down.

A fingerprint is hexadecimal: one byte for the logarithm of the length, then two bits per bucket. The difference of two
fingerprints is the sum of their buckets' distances (opposite quartiles count double) plus that of their lengths, bounded;
``likeness`` turns it into 1 for equal to 0 for as far apart as chance.

Null texts are empty; texts under three bytes have no triplets and equal buckets. Empty input gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import order
from eventloom.llm.arrays import buffers, constants, slices

BUCKETS = 1024
#: Distances between bytes of a triplet: next to one another and further apart, so that whole words count.
SPANS = ((1, 2), (2, 5), (3, 7))
_HASH = [constants(256, 100 + i) for i in range(3)]
_CHANCE = 1.625 + 2 / 16 * 3   # mean distance of unlike buckets: opposite quartiles, an eighth of them, count 6
_LENGTHS = 64


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: the length's code, then each bucket's quartile."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, BUCKETS + 1), np.uint8)
    out[:, 0] = np.minimum(255, np.round(np.log1p(size) / np.log(1.1))).astype(np.uint8)
    for lo, hi in slices(offsets, 1 << 19):
        d, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        row, left = np.repeat(np.arange(hi - lo), np.diff(at)), np.repeat(at[1:], np.diff(at)) - np.arange(len(d))
        counts = np.zeros((hi - lo) * BUCKETS, np.int64)
        for salt, (a, b) in enumerate(SPANS):
            if len(d) <= b:
                continue
            own = np.flatnonzero(left > b)
            h = (_HASH[0][d[own]] + _HASH[1][d[own + a]] + _HASH[2][d[own + b]]) * constants(1, 200 + salt)[0]
            bucket = (h >> np.uint64(32)).astype(np.int64) % BUCKETS
            counts += np.bincount(row[own] * BUCKETS + bucket, minlength=len(counts))
        counts = counts.reshape(hi - lo, BUCKETS)
        q = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
        for i in (1, 2, 3):
            out[lo:hi, 1:] += counts > q[:, i * BUCKETS // 4 - 1, None]
    return out


def text_of(code: np.ndarray) -> list[str]:
    quads = code[:, 1:].reshape(len(code), -1, 4)
    packed = quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3]
    return [row.tobytes().hex() for row in np.concatenate([code[:, :1], packed], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, down to 0 at the distance that chance gives or beyond."""
    d = np.abs(a[:, 1:].astype(np.int8) - b[:, 1:].astype(np.int8))
    apart = d.sum(1, dtype=np.int64) + 3 * (d == 3).sum(1)
    lengths = np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]), _LENGTHS)
    return np.clip(1 - (apart + lengths) / (_CHANCE * BUCKETS + _LENGTHS), 0, 1)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``fingerprint``."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fingerprint", T.StringType())])

    def made(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(text_of(codes(*buffers(b.column(text)))), pa.string())], names=[*kept, "fingerprint"])

    return docs.mapInArrow(made, schema)


def edit(text: str, other: str) -> str:
    """The last third replaced by as much of the beginning of ``other``."""
    k = len(text) // 3
    return text[:len(text) - k] + other[:k]


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
                       T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the row after it; a guest row only ends its block."""
    last: tuple[list, list, list, np.ndarray] | None = None
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids, guests = part.column("doc_id").to_pylist(), part.column("_guest").to_pylist()
            code = codes(*buffers(part.column("text")))
            if last is not None:
                texts, ids, guests, code = last[0] + texts, last[1] + ids, last[2] + guests, np.concatenate([last[3], code])
            last = texts[-1:], ids[-1:], guests[-1:], code[-1:]
            own = [i for i in range(len(texts) - 1) if not guests[i]]
            if not own:
                continue
            edited = [edit(texts[i], texts[i + 1]).encode() for i in own]
            other = codes(np.frombuffer(b"".join(edited), np.uint8), np.cumsum([0, *map(len, edited)]))
            o = np.asarray(own)
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([sha256(e).hexdigest() for e in edited]), pa.array(text_of(code[o])),
                pa.array(text_of(other)), pa.array(likeness(code[o], other)), pa.array(likeness(code[o], code[o + 1]))], names=_FOUND.names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document (``doc_id``, ``text``) with its text edited by the next one, by descending ``doc_id`` (null last; ties by
    text), the first following the last.

    The texts move once: to blocks of neighbouring ids, whose bounds are percentiles of the ids. The first row of each block
    also goes, as a guest, to the end of the block before it; these are as many as blocks.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    bounds = d.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    block = order.upper_bound(sorted(set(bounds)), F.col("doc_id")).alias("_block")
    heads = {r["_block"]: r["top"] for r in d.select("doc_id", block).groupBy("_block").agg(F.max("doc_id").alias("top")).collect()}
    blocks = sorted(heads)
    # the block with smaller ids comes later in the order: its head closes the block above it, and the top head the lowest
    goes = [(heads[b], blocks[(i + 1) % len(blocks)]) for i, b in enumerate(blocks)]
    same = lambda v: F.col("doc_id").isNull() if v is None else F.col("doc_id") == v
    to = F.lit(None).cast("int")
    for part in [goes[i:i + 200] for i in range(0, len(goes), 200)]:
        known = F.create_map(*(F.lit(x) for v, b in part if v is not None for x in (v, b))) if any(v is not None for v, _ in part) else None
        if known is not None:
            to = F.coalesce(to, known[F.col("doc_id")])
        for v, b in part:
            if v is None:
                to = F.coalesce(to, F.when(same(v), F.lit(b)))
    guests = d.select("doc_id", "text", to.alias("_block"), F.lit(True).alias("_guest")).where(F.col("_block").isNotNull())
    rows = d.select("doc_id", "text", block, F.lit(False).alias("_guest")).unionByName(guests)
    placed = rows.repartition(parts, "_block").sortWithinPartitions("_block", "_guest", F.col("doc_id").desc_nulls_last(), "text")
    return placed.mapInArrow(_compared, _FOUND)
