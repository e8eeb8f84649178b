"""Language identification by words first, then by shorter and shorter character n-grams.

Fitting takes at most ``per_language`` labelled documents of each language (drawn by a hash, each whole), and keeps the
``max_words`` most frequent words and ``max_grams`` most frequent n-grams: the model's size is bounded by these parameters,
whatever the corpus. Every text is scored whole. A known word adds its log frequency in each language; an unseen word takes
its longest n-grams that the model knows, order by order down to single letters, at a fixed price per order given up.

``lang_pred`` is ``und`` (score 0) for a null text, a text without letters, and all texts when nothing could be learned; ties
go to the language first by code point. Rows without a label teach nothing. Empty input gives no rows; extra columns pass
through, and ``lang_pred`` and ``score`` of the input, if any, are replaced.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from eventloom.llm.arrays import buffers, constants, mix, slices
from eventloom.llm.columns import hidden
from eventloom.llm.shared import shared

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
#: Labels that a model may have; more are refused, as each takes a column of the tables.
MAX_LANGUAGES = 1000
#: Letters times languages that are looked up at once.
CELLS = 1 << 21
STEP_DOWN = math.log(0.4)
_KEYS = constants(2, 4201)


def _spread(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words, one after another, and where each word's begin."""
    data = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return data, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def _whole(words: list[str]) -> np.ndarray:
    """A 64-bit key of each word."""
    data, first = _codes(words)
    size = np.diff(first)
    if not len(data):
        return np.zeros(len(words), np.uint64)
    place = np.arange(len(data)) - np.repeat(first[:-1], size)
    return mix(np.add.reduceat(mix(data + _KEYS[0]) * constants(int(size.max()), 4203)[place], first[:-1]))


def _runs(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the ``n`` code points at each place."""
    h = np.full(len(at), _KEYS[1])
    for j in range(n):
        h = mix((h ^ data[at + j]) * _KEYS[0])
    return h


def _rows(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is among the sorted keys; -1 if nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """Log frequencies per language of words and n-grams, as tables of a bounded size: sorted 64-bit keys, rows of float32."""

    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray], n_words: list[int]):
        (terms, c), (parts, g) = words, grams
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        at = {n: np.flatnonzero(size == n) for n in ORDERS}
        self._fill(languages, (_whole(terms), c), {n: (_runs(*_starts([parts[i] for i in w.tolist()]), n), g[w]) for n, w in at.items()}, n_words)

    @classmethod
    def of_keys(cls, languages: list[str], words: tuple[np.ndarray, np.ndarray], grams: dict[int, tuple[np.ndarray, np.ndarray]], n_words: list[int]) -> Model:
        """``words`` and each order of ``grams``: keys and their counts per language."""
        model = cls.__new__(cls)
        model._fill(languages, words, grams, n_words)
        return model

    def _fill(self, languages, words, grams, n_words) -> None:
        self.languages = languages
        total = np.asarray(n_words, float)
        keys, c = words
        self.words = self._sorted(keys, np.log((c + 0.1) / (total + 0.1 * (len(c) + 1))))
        # one table per order, so that frequencies of an order are shares of that order
        self.grams = {n: self._sorted(k, np.log((g + 0.1) / (g.sum(0) + 0.1 * (len(g) + 1)))) for n, (k, g) in grams.items()}
        self.never = np.log(0.1 / (total + 0.1 * (len(keys) + 1)))

    @staticmethod
    def _sorted(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], table[order].astype(np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        data, first = _codes([f"<{w}>" for w in words])
        out = np.tile(self.never + STEP_DOWN * (len(ORDERS) + 1), (len(words), 1))
        for lo, hi in slices(first, max(1, CELLS // len(self.languages))):
            owner = np.repeat(np.arange(lo, hi), np.diff(first[lo:hi + 1]))
            at = np.arange(first[lo], first[hi])
            for down, n in enumerate(ORDERS):
                keys, table = self.grams[n]
                fits = at + n <= first[owner + 1]
                row = np.full(len(at), -1)
                row[fits] = _rows(keys, _runs(data, at[fits], n))
                hit = np.flatnonzero(row >= 0)
                if not len(hit):
                    continue
                begin = np.flatnonzero(np.diff(owner[hit], prepend=-1))
                some, count = owner[hit[begin]], np.diff(begin, append=len(hit))
                out[some] = np.add.reduceat(table[row[hit]], begin, axis=0, dtype=float) / count[:, None] + STEP_DOWN * (down + 1)
                left = ~np.isin(owner, some)
                owner, at = owner[left], at[left]
        return out

    def score(self, words: list[str]) -> np.ndarray:
        keys, table = self.words
        row = _rows(keys, _whole(words))
        out = np.empty((len(words), len(self.languages)))
        out[row >= 0] = table[row[row >= 0]]
        new = np.flatnonzero(row < 0)
        out[new] = self.unseen([words[i] for i in new.tolist()])
        return out


def fit(docs: DataFrame, learn: Column, per_language: int = 3000, max_words: int = 200_000, max_grams: int = 300_000) -> Model:
    """A model of ``text`` and ``lang`` over the rows for which ``learn`` holds."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    languages = sorted((r["lang"] for r in counts), key=lambda s: s.encode())
    if not languages:
        return Model([], ([], np.zeros((0, 0))), ([], np.zeros((0, 0))), [])
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))))
    drawn = labelled.where(_spread(F.struct("doc_id", "text")) < share[F.col("lang")])
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    total = dict(words.groupBy("lang").agg(F.sum("n")).collect())
    marked = F.concat(F.lit("<"), F.col("term"), F.lit(">"))
    cuts = F.flatten(F.array(*(F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i, n=n: F.substr(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in ORDERS)))
    grams = words.select("lang", "n", F.explode(cuts).alias("term")).groupBy("lang", "term").agg(F.sum("n").alias("n"))

    def table(t: DataFrame, most: int, orders: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of the most frequent terms, by order (0: whole words). Terms are hashed in a task; only keys and counts reach the driver."""
        wide = t.groupBy("term").agg(F.sum("n").alias("all"), *(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(languages)))
        top = wide.where("`all` > 1").orderBy(F.desc("all"), "term").limit(most)
        found = top.select("term", F.array(*(f"l{i}" for i in range(len(languages)))).alias("each")).mapInArrow(_hashed(orders), "kind int, key long, each array<long>").toArrow()
        kind, key = found.column("kind").to_numpy(), found.column("key").to_numpy().view(np.uint64)
        each = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in found.column("each").chunks)]).reshape(-1, len(languages))
        return {n: (key[kind == n], each[kind == n]) for n in orders}

    return Model.of_keys(languages, table(words, max_words, (0,))[0], table(grams, max_grams, ORDERS), [total.get(x, 0) for x in languages])


def _hashed(orders: tuple[int, ...]):
    def hashed(batches):
        for b in batches:
            terms = b.column("term").to_pylist()
            size = np.fromiter(map(len, terms), np.int64, len(terms))
            for n in orders:
                at = np.flatnonzero(size == n) if n else np.arange(len(terms))
                some = [terms[i] for i in at.tolist()]
                if some:
                    key = _whole(some) if not n else _runs(*_starts(some), n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(key.view(np.int64)), b.column("each").take(pa.array(at))], names=["kind", "key", "each"])
    return hashed


def _starts(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, first = _codes(terms)
    return data, first[:-1]


_LETTERS = re.compile(r"[^\W\d_]+")


def _letters(text: str) -> list[str]:
    """Runs of letters, lower-cased; digits and numerals of other kinds are none."""
    found = _LETTERS.findall(text.lower())
    if text.isascii():
        return found
    return [w if w.isalpha() else v for w in found for v in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, the winner's share of the posterior over the languages."""
    sent = shared(docs.sparkSession, model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def scored(batches):
        m = sent()
        names = np.asarray([*m.languages, UNKNOWN], object)
        for b in batches:
            col = b.column("text")
            _, at = buffers(col)
            pred, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            for lo, hi in slices(at) if m.languages else ():
                words, n = [], np.zeros(hi - lo, np.int64)
                for i, text in enumerate(col.slice(lo, hi - lo).to_pylist()):
                    if text:
                        w = _letters(text)
                        n[i] = len(w)
                        words += w
                if not words:
                    continue
                coded = pa.array(words, pa.string()).dictionary_encode()
                each = m.score(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                some = np.flatnonzero(n)
                sums = np.add.reduceat(each, (np.cumsum(n) - n)[some], axis=0)
                best = sums.argmax(1)
                share = 1 / np.exp(np.clip(sums - sums.max(1, keepdims=True), -700, 0)).sum(1)
                pred[lo + some], score[lo + some] = names[best], share
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(pred, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by ``doc_id``; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, learn: Column | None = None, sure: float = 0.5, **fitting: int) -> DataFrame:
    """The rows, in their own columns, whose language is recognised with a score of ``sure`` or more."""
    docs, back = hidden(docs, ("lang_pred", "score"))
    return back(identify(docs, learn, **fitting).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= sure)))


def identify(docs: DataFrame, learn: Column | None = None, **fitting: int) -> DataFrame:
    """Fits on the labelled rows (those for which ``learn`` holds) and predicts all rows."""
    return predict(docs, fit(docs, F.lit(True) if learn is None else learn, **fitting))
