"""Fingerprints of documents and of their edits, against a plain recount; rows without ids and repeated rows."""
from collections import Counter
from hashlib import sha256
import math

import numpy as np
import pytest

from eventloom.llm import fingerprint as fp
from eventloom.llm.arrays import constants


def digest(text: str) -> str:
    data, salts = text.encode(), [int(constants(1, 200 + i)[0]) for i in range(len(fp.SPANS))]
    hashed = [constants(256, 100 + i).tolist() for i in range(3)]
    counts = Counter()
    for salt, (a, b) in zip(salts, fp.SPANS):
        for i in range(len(data) - b):
            h = (hashed[0][data[i]] + hashed[1][data[i + a]] + hashed[2][data[i + b]]) * salt % 2 ** 64
            counts[(h >> 32) % fp.BUCKETS] += 1
    all_ = sorted(counts[i] for i in range(fp.BUCKETS))
    cuts = [all_[k * fp.BUCKETS // 4 - 1] for k in (1, 2, 3)]
    quarters = [sum(counts[i] > q for q in cuts) for i in range(fp.BUCKETS)]
    out = bytes([min(255, round(math.log1p(len(data)) / math.log(1.1)))])
    return (out + bytes(sum(x << s for x, s in zip(quarters[i:i + 4], (6, 4, 2, 0))) for i in range(0, fp.BUCKETS, 4))).hex()


def quarters_of(print_: str):
    raw = bytes.fromhex(print_)
    return raw[0], [x >> s & 3 for x in raw[1:] for s in (6, 4, 2, 0)]


def alike(a: str, b: str) -> float:
    (la, qa), (lb, qb) = quarters_of(a), quarters_of(b)
    apart = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(qa, qb))
    return min(1, max(0, 1 - (apart + min(abs(la - lb), 64)) / ((1.625 + 2 / 16 * 3) * fp.BUCKETS + 64)))


def next_rows(rows):
    """(doc_id, text) in the order of the operator, each with the one after it."""
    return [(a, rows[(i + 1) % len(rows)]) for i, a in enumerate(rows)]


def found(spark, rows, parts=7):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return fp.compare_with_next(d).collect()


def test_whole_rows_against_a_recount(spark):
    rng = np.random.default_rng(3)
    some = ["wort", "straße", "日本", "and", "x" * 40, "the", "é"]
    rows = [(i, " ".join(rng.choice(some, rng.integers(0, 120)))) for i in range(60)] + [(60, None), (61, ""), (62, "ab"), (63, "y" * 300_000)]
    got = {r.doc_id: r for r in found(spark, rows)}
    order = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    assert len(got) == len(rows)
    for (i, t), (_, other) in next_rows(order):
        k = len(t) // 3
        edited = t[:len(t) - k] + other[:k]
        own, changed, after = digest(t), digest(edited), digest(other)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha256(edited.encode()).hexdigest(), own, changed)
        assert r.near_edited == pytest.approx(alike(own, changed)) and r.near_next == pytest.approx(alike(own, after))


def test_rows_without_ids_or_with_one_id(spark):
    """Null ids come last; rows that share an id are in the order of their texts."""
    rows = [(None, f"text {i % 90} of many words") for i in range(400)] + [(7, "same")] * 250 + [(i, f"own {i}") for i in range(100, 140)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((i, sha256(fp.edit(t, other).encode()).hexdigest()) for (i, t), (_, other) in next_rows(order))
    assert Counter((r.doc_id, r.edited_sha256) for r in found(spark, rows)) == want


def test_one_row_follows_itself_and_none_gives_none(spark):
    (r,) = found(spark, [(5, "abcdef")])
    assert r.edited_sha256 == sha256(b"abcdab").hexdigest() and r.near_next == 1.0
    assert found(spark, []) == []
