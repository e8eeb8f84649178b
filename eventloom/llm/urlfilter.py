"""Exact URL lists by a cascade of Bloom filters.

A rule is a host and a path; it fits its host and all subdomains where the URL's path starts with the rule's. The keys of a
URL are every suffix of its host joined with every path prefix as long as some rule's path. Over the complete set of keys of
the corpus, level 1 encodes the listed keys, level 2 the corpus keys that level 1 wrongly accepts, level 3 the listed keys
that level 2 wrongly accepts, and so on until nothing is wrong; membership of any corpus key is then exact, and the pages are
judged with no join. The filters' size follows the number of rules (sized for a false-positive rate of rules to keys at level 1
and one half below), and the rules are checked against ``MAX_RULES`` before they are sent.

Null or scheme-less URLs have no keys and get no rule. The longest fitting rule wins; a rule listed both ways counts as
``block``. With no rules, or none that fits, the verdict is ``allow``. Empty input gives no rows; extra columns pass through,
and the operator's own names (host, path, rule, verdict) replace those of the input.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.arrays import mix
from eventloom.llm.shared import shared
from eventloom.session import materialize

#: Rules of one cascade, about 2 bytes each as filters. Longer lists are refused: apply them in parts, the longest rule of all parts wins.
MAX_RULES = 20_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


class Bloom:
    def __init__(self, keys: np.ndarray, rate: float, level: int):
        self.level = np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        self.size = max(64, int(-len(keys) * math.log(rate) / math.log(2) ** 2) + 1)
        self.hashes = max(1, round(-math.log2(rate)))
        bits = np.zeros(self.size, bool)
        for at in self._places(keys):
            bits[at] = True
        self.bits = np.packbits(bits)

    def _places(self, keys: np.ndarray):
        a = mix(keys.view(np.uint64) ^ self.level)
        b = mix(a) | np.uint64(1)
        for i in range(self.hashes):
            yield ((a + np.uint64(i) * b) % np.uint64(self.size)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def listed(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """The first level that rejects a key decides: an odd one says it is not listed, an even one that it is."""
    out = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for i, level in enumerate(levels):
        ok = level.has(keys[left])
        out[left[~ok]] = i % 2 == 1
        left = left[ok]
    out[left] = len(levels) % 2 == 1
    return out


def cascade(universe: DataFrame, keys: np.ndarray) -> list[Bloom]:
    """Levels over ``universe`` (distinct ``key``, hashes of all keys of the corpus) and the listed ``keys``, until no key is wrong.

    From the corpus come only the keys that the levels so far accept wrongly, which are about as many as rules at first and
    halve from then on.
    """
    keys = np.unique(keys)
    if not len(keys):
        return []
    n = max(1, universe.count())
    levels = [Bloom(keys, min(0.5, math.sqrt(0.5) * len(keys) / n), 1)]
    right = keys

    def still(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(k[levels[0].has(k) & ~np.isin(k, keys)])], names=["key"])

    wrong = np.asarray([r[0] for r in universe.mapInArrow(still, "key long").toLocalIterator()], np.int64)
    while len(wrong):
        levels.append(Bloom(wrong, 0.5, len(levels) + 1))
        right = right[levels[-1].has(right)]
        if not len(right):
            break
        levels.append(Bloom(right, 0.5, len(levels) + 1))
        wrong = wrong[levels[-1].has(wrong)]
    return levels


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a URL, longest first: host suffixes at label boundaries, times path prefixes of the rules' lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = F.flatten(F.transform(suffixes, lambda s: F.array(*(F.when(F.char_length(path) >= n, F.concat(s, F.substring(path, 1, n))) for n in lengths)))) if lengths else F.array().cast("array<string>")
    return F.array_sort(F.filter(each, lambda k: k.isNotNull()), lambda a, b: F.when(F.char_length(a) > F.char_length(b), -1).when(F.char_length(a) < F.char_length(b), 1).otherwise(0))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``rules``: ``verdict`` (allow or block), ``host``, ``path``. Adds ``host, path, rule, verdict`` to the pages."""
    spark = pages.sparkSession
    listing = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block")) \
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    found = listing.select("verdict", F.xxhash64(F.concat("host", "path")).alias("key"), F.char_length("path").alias("n")).limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    lengths = sorted({r["n"] for r in found})
    host, path = host_and_path(F.col(url))
    own = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in own]
    keyed = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("_keys", F.when(F.col(url).contains("://"), keys_of(F.col("host"), F.col("path"), lengths)).otherwise(F.array().cast("array<string>")))
    keyed = keyed.withColumn("_hashes", F.transform("_keys", lambda k: F.xxhash64(k)))
    universe = materialize(keyed.select(F.explode("_hashes").alias("key")).distinct())
    sent = shared(spark, {v: cascade(universe, np.asarray([r["key"] for r in found if r["verdict"] == v], np.int64)) for v in ("block", "allow")})
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in own])

    def judged(batches):
        filters = sent()
        for b in batches:
            hashes, keys = b.column("_hashes"), b.column("_keys")
            flat = hashes.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy())]).astype(np.int64)
            block, allow = (listed(filters[v], flat) for v in ("block", "allow"))
            hit = np.flatnonzero(block | allow)
            first = np.append(hit, len(flat))[np.searchsorted(hit, at[:-1])]
            some = first < at[1:]
            texts = keys.flatten()
            rule = np.full(b.num_rows, None, object)
            rule[some] = texts.take(pa.array(first[some])).to_pylist()
            verdict = np.where(some & np.append(block, False)[np.minimum(first, len(flat))], "block", "allow")
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*kept, *own])

    return keyed.mapInArrow(judged, schema)
