"""Log-bilinear language model: noise-contrastive training in numpy, normalised log-probabilities by matrix products.

Tokens are runs of anything but ASCII white space, A-Z lower-cased, then one end per text. Counts of all training tokens are
kept in a table of any size. The ``head`` most frequent words (seen twice or more) get vectors; the others are the tail. Heads
are dealt over classes of equal size by bisecting how their neighbours are spread. A text's next token is predicted as

    P(token | context) = P(class | context) * P(word | class, context)      or      P(tail | context) * P(word | tail)

where both softmaxes score the vectors of classes and words against a context vector, the sum of the last words' vectors, each
weighted by a vector per distance. The tail gives its words shares by count, and one unseen word type the share of words
that were seen once. So the probabilities over all training words and the unseen type add up to one.

Training goes over all training texts in rounds, each over its own part of them. Within a round, each task runs minibatches
of noise-contrastive estimation from the same parameters (noise: the unigrams of classes, and of the words of a class); Spark
adds up the changes, weighted by how often a task has met a row, and the driver applies their mean. What tasks send grows
with the corpus: a task per ``TOKENS`` tokens sends its changed rows.

Models are bounded by parameters (``head`` vectors, ``lookup`` counts that tasks hold); tail words beyond ``lookup`` meet their
counts in a join, so no count is cut. A null text is empty: it has the end only. A null ``doc_id`` is a training row. Repeated
rows count again; ties in count fall together (a threshold admits all words of a count or none). With no training token every
token has probability one. Empty input gives no rows; extra columns pass through, those of the result's names are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.arrays import buffers, mix, slices, words
from eventloom.session import materialize

#: Tokens that a training task works on, about.
TOKENS = 4_000_000
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 20
#: Tokens that are scored at once.
BATCH = 1 << 16
MINIBATCH = 8192
#: Noise classes shared by a minibatch, and noise words shared by its tokens of a class.
NOISE, WORD_NOISE = 64, 32
_TRAINED = ("near", "far", "classes", "words")
#: Shares of the training texts that the rounds take.
ROUNDS = (0.15, 0.35, 0.5)
RATE = 0.05
_END = mix(np.array([0xE0D], np.uint64))[0]


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each row, its end included, and where each row's begin."""
    h, first = words(data, at)
    n = np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(begin[-1], np.uint64)
    out[begin[1:] - 1] = _END
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    out[inside] = h
    return out, begin


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    h, n = h[order], n[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[new], np.add.reduceat(n, new)


def _counted(batches):
    def sent(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    held, size = [], 0
    for b in batches:
        data, at = buffers(b.column("text"))
        for lo, hi in slices(at):
            held.append(np.unique(tokens(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])[0], return_counts=True))
            size += len(held[-1][0])
            if size >= HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield sent(*held[0])
                    held, size = [], 0
    if size:
        yield sent(*_merged(held))


def _places(keys: np.ndarray) -> dict:
    """Sorted keys with where each run of leading bits begins."""
    bits = max(1, len(keys).bit_length())
    return {"keys": keys, "bits": bits, "starts": np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)).astype(np.int32)}


def _find(table: dict, h: np.ndarray) -> np.ndarray:
    """Where each hash is among the keys; -1 if nowhere."""
    lead = (h >> np.uint64(64 - table["bits"])).astype(np.int64)
    at, end = table["starts"][lead], table["starts"][lead + 1]
    out = np.full(len(h), -1, np.int32)
    left = np.flatnonzero(at < end)
    while len(left):
        hit = table["keys"][at[left]] == h[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < end[left]]
    return out


def _contexts(ids: np.ndarray, begin: np.ndarray, n: int, start: int) -> np.ndarray:
    """The ``n`` tokens before each one, the last first; ``start`` before the text."""
    place = np.arange(len(ids)) - np.repeat(begin[:-1], np.diff(begin))
    out = np.full((len(ids), n), start, np.int32)
    for i in range(n):
        some = np.flatnonzero(place > i)
        out[some, i] = ids[some - i - 1]
    return out


def _sigmoid(x: np.ndarray, sign: int = 1) -> np.ndarray:
    """``sign`` times the sigmoid of ``x``, which is overwritten."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += 1
    x *= np.float32(0.5 * sign)
    return x


def _sums(g: np.ndarray, first: np.ndarray, short: int = 6) -> np.ndarray:
    """Sums of the rows from each ``first`` to the next: short runs row by row, all at once, then the rest of each long one."""
    end = np.append(first[1:], len(g))
    out, left = g[first], np.arange(len(first))
    for k in range(1, short):
        left = left[first[left] + k < end[left]]
        out[left] += g[first[left] + k]
    for k in left[first[left] + short < end[left]].tolist():
        out[k] += g[first[k] + short:end[k]].sum(0)
    return out


def trained(p: dict, stream, seed: int) -> tuple[dict, dict]:
    """The parameters after the stream of (ids, begin), and how often each row of each was met."""
    p = {k: v.copy() if k in _TRAINED else v for k, v in p.items()}
    met = {k: np.zeros(len(p[k]), np.int64) for k in _TRAINED}
    seen = {k: np.full(len(p[k]), 1e-2, np.float32) for k in _TRAINED}
    rng = np.random.default_rng(seed)
    heads, tail, distances = len(p["words"]), len(p["classes"]) - 1, len(p["far"])
    near, far, classes, words_, first_of = p["near"], p["far"], p["classes"], p["words"], p["class_first"]
    class_price, word_price = p["class_log"] + np.float32(np.log(NOISE)), p["word_log"] + np.float32(np.log(WORD_NOISE))

    def move(name: str, rows: np.ndarray, g: np.ndarray, times) -> None:
        met[name][rows] += times
        seen[name][rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        p[name][rows] += g * (RATE / np.sqrt(seen[name][rows]))[:, None]

    for ids, begin in stream:
        ctx = _contexts(ids, begin, distances, heads + 1)
        for lo in range(0, len(ids), MINIBATCH):
            w = ids[lo:lo + MINIBATCH]
            order = np.argsort(w, kind="stable")      # by word, and so by class
            w, x = w[order], ctx[lo:lo + MINIBATCH][order]
            c = p["class_of"][w]
            before = [near[x[:, i]] for i in range(distances)]
            q1 = np.ones((len(w), near.shape[1] + 1), np.float32)     # the last column of classes and words is a bias
            q1[:, :-1] = sum(v * f for v, f in zip(before, far))
            # classes against noise that the minibatch shares
            noise = np.minimum(np.searchsorted(p["class_cum"], rng.random(NOISE)), tail)
            u, un = classes[c], classes[noise]
            gp = _sigmoid(class_price[c] - np.einsum("bd,bd->b", u, q1))
            gn = q1 @ un.T
            gn -= class_price[noise]
            gn = _sigmoid(gn, -1)
            gq = gn @ un
            gq += gp[:, None] * u
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(first, len(c)))
            g = np.zeros((tail + 1, q1.shape[1]), np.float32)
            g[c[first]] = np.stack([gp[a:a + k] @ q1[a:a + k] for a, k in zip(first.tolist(), size.tolist())])
            np.add.at(g, noise, gn.T @ q1)
            times = np.bincount(noise, minlength=tail + 1)
            times[c[first]] += size
            some = np.flatnonzero(times)
            move("classes", some, g[some], times[some])
            # words against noise that the tokens of a class share
            n = int(np.searchsorted(w, heads))               # the tail comes last
            if n:
                v, of = w[:n], c[first[first < n]]
                edge = [*first[first < n].tolist(), n]
                drawn = np.searchsorted(p["word_cum"], p["low"][of][:, None] + rng.random((len(of), WORD_NOISE)) * (p["high"][of] - p["low"][of])[:, None], "right")
                drawn = np.clip(drawn, first_of[of][:, None], first_of[of + 1][:, None] - 1)
                rows, r, y = words_[v], words_[drawn], q1[:n]
                hit = _sigmoid(word_price[v] - np.einsum("bd,bd->b", rows, y))[:, None]
                miss, away = np.empty((n, WORD_NOISE), np.float32), np.empty_like(r)
                for k, (a, e) in enumerate(zip(edge[:-1], edge[1:])):
                    np.matmul(y[a:e], r[k].T, out=miss[a:e])
                miss -= np.repeat(word_price[drawn], np.diff(edge), axis=0)
                miss = _sigmoid(miss, -1)
                for k, (a, e) in enumerate(zip(edge[:-1], edge[1:])):
                    np.matmul(miss[a:e].T, y[a:e], out=away[k])
                    gq[a:e] += miss[a:e] @ r[k]
                gq[:n] += hit * rows
                first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                u, place = np.unique(np.concatenate([v[first], drawn.ravel()]), return_inverse=True)
                g = np.zeros((len(u), q1.shape[1]), np.float32)
                g[place[:len(first)]] = _sums(hit * y, first)
                hits = np.argsort(place[len(first):], kind="stable")      # sums of sorted runs: a third of the time of adding row by row
                at = place[len(first):][hits]
                run = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                g[at[run]] += _sums(away.reshape(-1, q1.shape[1])[hits], run)
                times = np.bincount(place[len(first):], minlength=len(u))
                times[place[:len(first)]] += np.diff(np.append(first, n))
                move("words", u, g, times)
            # the words before: what each position is owed by the next ones of the minibatch, in the order of the words again
            gq = gq[:, :-1]
            move("far", np.arange(distances), np.stack([np.einsum("bd,bd->d", gq, v) for v in before]), len(w))
            placed = np.empty_like(gq)
            placed[order] = gq
            owed, times = np.zeros_like(gq), np.zeros(len(w), np.int64)
            for i, f in enumerate(far):
                inside = ctx[lo + i + 1:lo + len(w), i] <= heads
                due = placed[i + 1:] * f
                due[~inside] = 0
                owed[:len(w) - i - 1] += due
                times[:len(w) - i - 1] += inside
                start = ctx[lo:lo + len(w), i] > heads
                if start.any():
                    move("near", np.array([heads + 1]), (placed[start].sum(0) * f)[None], int(start.sum()))
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            move("near", w[first], _sums(owed[order], first), np.add.reduceat(times[order], first))
    return p, met


def log_probabilities(p: dict, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of head words, and of being in the tail, each given the words before."""
    heads = len(p["words"])
    ctx, of = _contexts(ids, begin, len(p["far"]), heads + 1), p["class_of"][ids]
    out = np.empty(len(ids))
    for lo in range(0, len(ids), BATCH):
        w, c = ids[lo:lo + BATCH], of[lo:lo + BATCH]
        q = np.ones((len(w), p["near"].shape[1] + 1), np.float32)
        q[:, :-1] = sum(p["near"][ctx[lo:lo + BATCH, i]] * f for i, f in enumerate(p["far"]))
        own = np.empty(len(w))
        step = 4096
        for a in range(0, len(w), step):
            own[a:a + step] = _picked(q[a:a + step], p["classes"], c[a:a + step])
        order = np.argsort(c, kind="stable")
        edge = np.searchsorted(c[order], np.arange(len(p["classes"])))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            first, last = p["class_first"][k], p["class_first"][k + 1]
            rows = order[edge[k]:edge[k + 1]]
            for a in range(0, len(rows), step):
                some = rows[a:a + step]
                own[some] += _picked(q[some], p["words"][first:last], w[some] - first)
        out[lo:lo + BATCH] = own
    return out


def _picked(q1: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The log of the softmax over ``rows`` at ``which``."""
    s = q1 @ rows.T
    top = np.zeros(len(s), np.float32)
    if np.sqrt(np.einsum("ij,ij->i", q1, q1).max() * np.einsum("ij,ij->i", rows, rows).max()) > 80:     # no score can be larger
        top = s.max(1)
        s -= top[:, None]
    picked = s[np.arange(len(s)), which].astype(float)
    np.exp(s, out=s)
    return picked - np.log(s @ np.ones(s.shape[1], np.float32))


def _bisected(x: np.ndarray, classes: int) -> np.ndarray:
    """Class numbers of equal size: halves along the direction in which the rows spread most, again and again."""
    out, parts, n = np.zeros(len(x), np.int64), [np.arange(len(x))], 1
    while n < classes:
        halves = []
        for rows in parts:
            y = x[rows] - x[rows].mean(0) if len(rows) else x[rows]
            way = np.linalg.eigh(y.T @ y)[1][:, -1]
            rows = rows[np.argsort(y @ way, kind="stable")]
            halves += [rows[:(len(rows) + 1) // 2], rows[(len(rows) + 1) // 2:]]
        parts, n = halves, 2 * n
    for i, rows in enumerate(parts):
        out[rows] = i
    return out


def _numbers(keys: dict):
    """Each training text as the numbers of its tokens in the order of the keys, the tail last: texts are read and looked up once."""
    heads = len(keys["keys"])
    kind = _kind(heads)

    def rows(batches):
        for b in batches:
            data, at = buffers(b.column("text"))
            for lo, hi in slices(at):
                h, begin = tokens(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                ids = _find(keys, h)
                ids = np.where(ids < 0, heads, ids).astype(kind)
                ends = pa.py_buffer((begin * ids.itemsize).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("round").slice(lo, hi - lo), pa.Array.from_buffers(pa.binary(), hi - lo, [None, ends, pa.py_buffer(ids)])], names=["round", "ids"])
    return rows


def _kind(heads: int):
    return np.uint16 if heads < 1 << 16 else np.int32


def _streamed(batches, heads: int):
    """(ids, begin) of a few hundred thousand tokens at a time."""
    size = np.dtype(_kind(heads)).itemsize
    for b in batches:
        data, at = buffers(b.column("ids"))
        for lo, hi in slices(at, 1 << 19):
            yield data[at[lo]:at[hi]].view(_kind(heads)).astype(np.int64), (at[lo:hi + 1] - at[lo]) // size


def _neighbours(heads: int, spread: np.ndarray):
    """Per head word: its count and the sums of the random vectors of the words before and after it."""
    def rows(batches):
        d = spread.shape[1]
        total, met = np.zeros((heads + 1, 2 * d), np.float32), np.zeros(heads + 1, np.int64)
        for ids, begin in _streamed(batches, heads):
            own, both = spread[ids], np.zeros((len(ids), 2 * d), np.float32)
            both[1:, :d], both[:-1, d:] = own[:-1], own[1:]
            both[begin[:-1], :d], both[begin[1:] - 1, d:] = spread[-1], spread[-1]
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
            u, s = ids[order][first], _sums(both[order], first)
            total[u] += s
            met += np.bincount(ids, minlength=heads + 1)
        some = np.flatnonzero(met[:heads])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(met[some]), pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * 2 * d).astype(np.int32)), pa.array(total[some].ravel()))], names=["id", "met", "x"])
    return rows


def _round(sent):
    """A task's training: the rows it has changed, times how often it met them."""
    def rows(batches):
        p = sent.value
        heads = len(p["words"])
        number = np.append(p["number"], heads)
        new, met = trained(p, ((number[ids], begin) for ids, begin in _streamed(batches, heads)), TaskContext.get().partitionId())
        for name, times in met.items():
            some = np.flatnonzero(times)
            change = (new[name][some].astype(float) - p[name][some]) * times[some, None]
            width = change.shape[1]
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(times[some]), pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * width).astype(np.int32)), pa.array(change.ravel().astype(np.float32)))], names=["name", "id", "met", "x"])
    return rows


def _summed(rows: DataFrame, width: int, *key: str):
    """Sums per key, as an Arrow table: as many rows as the model has."""
    return rows.groupBy(*key).agg(F.sum("met").alias("met"), F.array(*(F.sum(F.get("x", F.lit(i))) for i in range(width))).alias("x")).toArrow()


@dataclass
class Model:
    """``sent``: what tasks hold; ``counts``: the training count of every word (``word``, ``n``); ``least``: counts below it are not held by tasks."""

    sent: dict
    counts: DataFrame
    least: int
    n: int
    v: int


def fit(docs: DataFrame, learn: Column, head: int = 1 << 14, lookup: int = 1 << 20, classes: int = 128, width: int = 32, context: int = 2) -> Model:
    """A model of the texts for which ``learn`` holds."""
    spark = docs.sparkSession
    texts = docs.where(learn).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # how many words have a count of this size: 16 steps for each doubling
    sizes = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()
    sizes = sorted(sizes, key=lambda r: -r["step"])
    total, v, once = (sum(r[c] for r in sizes) for c in ("n", "words", "once"))

    def threshold(most: int, least: int) -> int:
        at, taken = None, 0
        for r in sizes:
            taken += r["words"]
            if taken > most or r["least"] < least:
                break
            at = r["least"]
        return at if at is not None else total + 1

    top, low = threshold(head, 2), threshold(lookup, 1)
    held = counts.where(F.col("n") >= min(top, low)).toArrow()
    h, n = held.column("word").to_numpy().view(np.uint64), held.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    is_head = n >= top
    keys, own = _places(h[is_head]), n[is_head]
    heads = len(own)
    # classes by neighbours
    rng = np.random.default_rng(13)
    spread = rng.choice(np.float32([-1, 1]), (heads + 2, width // 2))
    spread -= np.average(spread[:heads], axis=0, weights=own).astype(np.float32) if heads else 0
    parts = max(1, -(-total // TOKENS))
    place, edges = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20)), np.cumsum(ROUNDS)[:-1].tolist()
    which = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= place))
    numbers = materialize(texts.select("text", which.alias("round")).mapInArrow(_numbers(keys), "round int, ids binary")) if heads else None
    x = np.zeros((heads, width), np.float64)
    if heads:
        t = _summed(numbers.coalesce(parts).select("ids").mapInArrow(_neighbours(heads, spread), "id long, met long, x array<float>"), width, "id")
        at = t.column("id").to_numpy()
        x[at] = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width) / np.sqrt(t.column("met").to_numpy())[:, None]
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    classes = min(classes, 1 << max(0, (heads // 4).bit_length() - 1)) if heads else 0
    of = _bisected(x, classes) if heads else np.zeros(0, np.int64)
    by_class = np.lexsort((h[is_head], of))               # words are numbered class by class
    number = np.empty(heads, np.int32)
    number[by_class] = np.arange(heads)
    of, own = of[by_class], own[by_class].astype(float)
    class_first = np.searchsorted(of, np.arange(classes + 1))
    mass = np.append(np.add.reduceat(own, class_first[:-1]) if heads else np.zeros(0), total - own.sum()) + 0.5
    class_log, word_log = np.log(mass / mass.sum()), np.log(own / (mass[of] - 0.5)) if heads else np.zeros(0)
    cum = np.cumsum(own)
    small = lambda *shape: (rng.standard_normal(shape) * 0.05).astype(np.float32)
    near = small(heads + 2, width)
    near[:heads] += (x[by_class] * 2).astype(np.float32)
    p = {"keys": keys, "number": number, "class_of": np.append(of, classes).astype(np.int32), "class_first": np.append(class_first, heads).astype(np.int64)[:classes + 1] if heads else np.zeros(1, np.int64),
         "class_log": class_log.astype(np.float32), "word_log": word_log.astype(np.float32), "class_cum": np.cumsum(mass / mass.sum()), "word_cum": cum,
         "low": np.append(cum - own, 0)[class_first] if heads else np.zeros(0), "high": np.append(0, cum)[np.append(class_first[1:], heads)[:classes + 1]] if heads else np.zeros(0),
         "near": near, "far": (np.ones((context, width)) / np.arange(1, context + 1)[:, None]).astype(np.float32),
         "classes": np.concatenate([np.zeros((classes + 1, width), np.float32), class_log[:, None].astype(np.float32)], 1), "words": np.concatenate([np.zeros((heads, width), np.float32), word_log[:, None].astype(np.float32)], 1)}
    for k, share in enumerate(ROUNDS if heads else ()):
        some = numbers.where(F.col("round") == k).select("ids").coalesce(max(1, round(parts * share)))
        t = _summed(some.mapInArrow(_round(spark.sparkContext.broadcast(p)), "name string, id long, met long, x array<float>"), width + 1, "name", "id")
        names, at, met = np.asarray(t.column("name").to_pylist()), t.column("id").to_numpy(), t.column("met").to_numpy()
        change = t.column("x").combine_chunks().flatten().fill_null(0).to_numpy().reshape(-1, width + 1) / np.maximum(met, 1)[:, None]
        p = dict(p)
        for name in _TRAINED:
            which = names == name
            p[name] = p[name].copy()
            p[name][at[which]] += change[which][:, :p[name].shape[1]].astype(np.float32)
    rest = total - own.sum()
    unseen = (once + 0.5) / (rest + 1) if rest else 1.0
    known = _places(h)
    sent = {"p": p, "known": known, "counts": n, "unseen": unseen, "rest": float(rest), "total": total, "v": v}
    return Model(sent, counts, min(top, low), total, v)


_OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigrams) and ``score`` (the model), both log10."""
    kept = [c for c in docs.columns if c.lower() not in _OUT]
    docs = docs.select(*(f"`{c}`" for c in kept))
    sent = docs.sparkSession.sparkContext.broadcast(model.sent)
    own = [T.StructField("_row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
           T.StructField("_words", T.ArrayType(T.LongType())), T.StructField("_times", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema[c] for c in kept] + own)

    def scored(batches):
        m = sent.value
        p, heads = m["p"], len(m["p"]["words"])
        base_of = np.log10((m["counts"] + 0.5) / (m["total"] + 0.5 * (m["v"] + 1)))
        tail_of = np.log10((1 - m["unseen"]) * m["counts"] / m["rest"]) if m["rest"] else np.zeros(len(m["counts"]))
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            data, at = buffers(b.column("text"))
            sums: list[list[np.ndarray]] = [[], [], [], []]
            far, times, ends = [], [], [np.zeros(1, np.int64)]
            for lo, hi in slices(at):
                hashes, begin = tokens(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                place = _find(m["known"], hashes)
                ids = _find(p["keys"], hashes)
                ids = np.where(ids < 0, heads, p["number"][ids]) if heads else np.zeros(len(ids), np.int64)
                lp = log_probabilities(p, ids, begin) / np.log(10) if heads else np.zeros(len(ids))
                held = place >= 0
                base = np.where(held, base_of[place], 0.0) if len(base_of) else np.zeros(len(ids))
                lp += np.where(held & (ids == heads), tail_of[place], 0.0) if len(tail_of) else 0.0
                for to, each in zip(sums, (np.ones(len(ids), np.int64), held.astype(np.int64), base, lp)):
                    to.append(np.add.reduceat(each, begin[:-1]))
                out = np.flatnonzero(~held)
                of = np.searchsorted(begin, out, "right") - 1
                order = np.lexsort((hashes[out], of))
                of, w = of[order], hashes[out][order]
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (w[1:] != w[:-1]))[:len(of)])
                far.append(w[new].view(np.int64))
                times.append(np.diff(np.append(new, len(of))))
                ends.append(np.searchsorted(of[new], np.arange(1, len(begin))) + ends[-1][-1])
            n = [np.concatenate(s) if s else np.zeros(0) for s in sums]
            places = pa.array(np.concatenate(ends).astype(np.int32))
            lists = [pa.ListArray.from_arrays(places, pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))) for x in (far, times)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.arange(row, row + b.num_rows)), pa.array(n[0].astype(np.int64)), pa.array(n[1].astype(np.int64)), pa.array(n[2].astype(float)), pa.array(n[3].astype(float)), *lists], names=schema.names)
            row += b.num_rows

    return _with_rest(docs.mapInArrow(scored, schema), kept, model)


def _with_rest(rows: DataFrame, kept: list[str], model: Model) -> DataFrame:
    """Adds what the words beyond ``lookup`` and the unseen ones are worth, by a join with their counts."""
    rows = materialize(rows)
    far = rows.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("z")).select("_row", F.col("z._words").alias("_w"), F.col("z._times").alias("_t"))
    c = model.counts.where(F.col("n") < model.least).select("word", "n")
    far = far.join(c, F.col("_w") == F.col("word"), "left").withColumn("c", F.coalesce("n", F.lit(0).cast("long")))
    s = model.sent
    base = F.log10((F.col("c") + 0.5) / F.lit(s["total"] + 0.5 * (s["v"] + 1)))
    share = F.when(F.col("c") > 0, F.log10(F.col("c") * F.lit((1 - s["unseen"]) / s["rest"] if s["rest"] else 1.0))).otherwise(F.lit(float(np.log10(s["unseen"]))))
    more = far.groupBy(F.col("_row").alias("_r")).agg(F.sum(F.when(F.col("c") > 0, F.col("_t")).otherwise(0)).alias("_known"), F.sum(F.col("_t") * base).alias("_base"), F.sum(F.col("_t") * share).alias("_score"))
    j = rows.drop("_words", "_times").join(more, F.col("_row") == F.col("_r"), "left")
    return j.select(*(f"`{c}`" for c in kept), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"), F.lit(s["total"]).cast("long").alias("train_tokens"),
                    (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by ``doc_id``; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))
