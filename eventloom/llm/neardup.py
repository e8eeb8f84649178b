"""Near-duplicate groups: MinHash bands, sequential Bayesian verification, exact confirmation.

A document is the set of its distinct shingles of ``k`` words (A-Z lower-cased, split at ASCII white space; fewer words make
one shingle; no words make an empty set, which is linked with nothing). Equal sets are one class from the start, so copies
cost nothing further. Classes that agree in a band of the signature are candidates. A candidate pair's signatures are compared
batch by batch; it is dropped once the posterior probability of the wanted similarity, under a uniform prior, is below
``miss``; pairs that survive are confirmed on their full sets.

Links are wanted for the components they make. Each class is first compared with one pivot of its buckets; where a bucket's
members are then not yet one component, its classes are compared with one another across components, in blocks within tasks
that emit what joins components, so no component is left apart and no list of pairs is made.

Null ``doc_id`` keeps its row; a component's id is its smallest non-null ``doc_id``. Rows that repeat a ``doc_id`` each get a row.
Empty input gives no rows. The chance that a pair at exactly the threshold shares no band is below 3e-6.
"""
from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.arrays import buffers, constants, mix, shingles, slices, words
from eventloom.llm.columns import hidden
from eventloom.llm.components import components
from eventloom.session import materialize

BANDS, ROWS = 42, 6
BATCH = 36
SLOTS = BANDS * ROWS
_A, _B = constants(SLOTS, 301), constants(SLOTS, 302)
_BLOCK = 1 << 15
#: Classes and shingles of a block of the second comparison.
BLOCK, BLOCK_SHINGLES = 256, 400_000


def signatures(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each hash function over each row's shingles; rows without any are left out by the caller."""
    out = np.empty((len(begin) - 1, SLOTS), np.uint16)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + _BLOCK, "right")) - 1)
        x, at = s[begin[lo]:begin[hi]], begin[lo:hi] - begin[lo]
        y = np.empty_like(x)
        for i in range(SLOTS):
            np.multiply(x, _A[i], out=y)
            np.add(y, _B[i], out=y)
            out[lo:hi, i] = np.minimum.reduceat(y, at) >> np.uint64(44) & np.uint64(0xFFFF)
        lo = hi
    return out


def _sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and where each row's begin."""
    s, begin = shingles(*words(data, at), k)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(begin)))


def _names(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(np.uint64)).view(np.int64)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, x`` (the text's hash), ``n_shingles, node`` (the set's hash), ``sig``."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType())])

    def signed(batches):
        for b in batches:
            data, at = buffers(b.column("text"))
            n, node, sig = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for lo, hi in slices(at):
                s, begin = _sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], k)
                n[lo:hi], node[lo:hi] = np.diff(begin), _names(s, begin)
                some = np.flatnonzero(np.diff(begin))
                for i, row in zip(some.tolist(), signatures(s, np.append(begin[:-1][some], len(s)))):
                    sig[lo + i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("x"), pa.array(n), pa.array(node), pa.array(sig, pa.binary())], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("x"), "text").mapInArrow(signed, schema)


def least_matches(similarity: float, miss: float) -> list[tuple[int, int]]:
    """(slots compared, matches needed): fewer leave the posterior of the similarity below ``miss``.

    Under a uniform prior, P(J >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(BATCH, SLOTS, BATCH), SLOTS]:
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * similarity ** m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return out


def _likely(similarity: float, miss: float):
    needed = least_matches(similarity, miss)

    def likely(batches):
        for b in batches:
            x, y = (np.frombuffer(buffers(b.column(c))[0], np.uint16).reshape(-1, SLOTS) for c in ("sig_x", "sig_y"))
            left, matches, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for n, m in needed:
                matches[left] += (x[left, done:n] == y[left, done:n]).sum(1)
                left, done = left[matches[left] >= m], n
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(left)) for c in ("x", "y")], names=["x", "y"])
    return likely


def _confirmed(percent: int):
    def confirmed(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_x"), b.column("set_y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(c).take(keep) for c in ("x", "y")], names=["a", "b"])
    return confirmed


def _sets_of(texts: DataFrame, k: int) -> DataFrame:
    """``node, sig, text`` → ``node, sig, set``: the distinct shingles themselves, as 64-bit hashes in order."""
    def sets(batches):
        for b in batches:
            data, at = buffers(b.column("text"))
            node = b.column("node").to_numpy()
            for lo, hi in slices(at):
                s, begin = _sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], k)
                own = np.flatnonzero(_names(s, begin) == node[lo:hi])     # hashes of two texts may be equal
                full = pa.array([s[begin[i]:begin[i + 1]].tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][own]), b.column("sig").slice(lo, hi - lo).take(pa.array(own)), full], names=["node", "sig", "set"])

    return texts.mapInArrow(sets, "node long, sig binary, set binary")


def _links(pairs: DataFrame, known: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (x, y) of classes that are links: by signatures first, survivors by full sets."""
    of = lambda c, v: known.select(F.col("node").alias(c), F.col(v).alias(f"{v}_{c}"))
    likely = pairs.join(of("x", "sig"), "x").join(of("y", "sig"), "y").select("x", "y", "sig_x", "sig_y").mapInArrow(_likely(percent / 100, miss), "x long, y long")
    return likely.join(of("x", "set"), "x").join(of("y", "set"), "y").select("x", "y", "set_x", "set_y").mapInArrow(_confirmed(percent), "a long, b long")


def _labels(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """Adds each node's component so far, itself if it has none."""
    c = comp.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return nodes.join(c, F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("_c", "node")).drop("_n", "_c")


def _chained(pivots: DataFrame) -> DataFrame:
    """``node, n, cell, comp, linked`` after one step along the pivots → after four. A class is in its cell's chain as far as links are
    confirmed without a gap: ``comp`` is where they end, and ``linked`` says that they reach the cell."""
    for _ in range(2):
        on = pivots.select(F.col("node").alias("_node"), F.col("cell").alias("_cell"), F.col("comp").alias("_comp"), F.col("linked").alias("_linked"))
        far = F.when(F.col("linked"), F.col("_comp")).otherwise(F.col("comp"))
        pivots = pivots.join(on, F.col("cell") == F.col("_node")).select("node", "n", F.col("_cell").alias("cell"), far.alias("comp"), (F.col("linked") & F.col("_linked")).alias("linked"))
    return pivots


def _apart(members: DataFrame, cells: DataFrame, known: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs of components that a link joins, over classes that share a bucket.

    The classes with a common pivot are a cell, pivots going with their own pivots twice over, so that a large group has few
    cells. Two cells that meet in such a bucket are compared block by block, inside a task;
    only links leave it. A block holds about ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles.
    """
    now = members.select("node", "bucket").join(cells, "node")
    apart = now.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("bucket")
    active = materialize(now.join(apart, "bucket", "left_semi"))
    met = active.select("bucket", "cell").distinct()
    met = met.select("bucket", F.col("cell").alias("c")).join(met.select("bucket", F.col("cell").alias("d")), "bucket").where("c <= d").select("c", "d").distinct()
    nodes = active.select("node", "n", "cell", "comp").distinct()
    sizes = nodes.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = nodes.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    of = lambda c: sizes.select(F.col("cell").alias(c), F.col("blocks").alias(f"_{c}"))
    units = met.join(of("c"), "c").join(of("d"), "d").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    units = units.withColumn("j", F.explode(F.sequence(F.when(F.col("c") == F.col("d"), F.col("i")).otherwise(0), F.col("_d") - 1)))
    units = units.select("c", "i", "d", "j", F.xxhash64("c", "i", "d", "j").alias("unit"))
    row = ("node", "n", "comp")
    # a unit of a block with itself has a left side only
    side = lambda cell, block, left: F.struct(F.col(cell).alias("cell"), F.col(block).alias("block"), F.lit(left).alias("left"))
    both = F.when((F.col("c") == F.col("d")) & (F.col("i") == F.col("j")), F.array(side("c", "i", True))).otherwise(F.array(side("c", "i", True), side("d", "j", False)))
    sides = units.select("unit", F.explode(both).alias("_s")).select("unit", "_s.*")
    sent = placed.join(sides, ["cell", "block"]).join(known, "node").select("unit", "left", *row, "sig", "set")
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_compare(percent, miss), "a long, b long").distinct()


def _compare(percent: int, miss: float):
    """Rows in the order of ``unit``: the left ones of a unit with its right ones, or with one another if it has no right ones."""
    needed = least_matches(percent / 100, miss)

    def links(t: pa.Table):
        t = t.combine_chunks()
        n, comp, left = (t.column(c).to_numpy() for c in ("n", "comp", "left"))
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        y = y if len(y) else x
        if not len(x) or (comp[x].min() == comp[x].max() == comp[y].min() == comp[y].max()):
            return
        sig = np.frombuffer(buffers(t.column("sig"))[0], np.uint16).reshape(-1, SLOTS)
        data, at = buffers(t.column("set"))
        at = at // 8
        _, ids = np.unique(data.view(np.uint64) if data.flags.aligned else np.frombuffer(data.tobytes(), np.uint64), return_inverse=True)
        has = np.zeros(int(ids.max()) + 1, bool)
        label, comp = comp, comp.copy()   # joined here as links are found: one link says enough about two components
        for i in x.tolist():
            ok = y[(comp[y] != comp[i]) & (100 * np.minimum(n[y], n[i]) >= percent * np.maximum(n[y], n[i]))]
            matches, done = np.zeros(len(ok), np.int64), 0
            for upto, least in needed:
                matches += (sig[ok, done:upto] == sig[i, done:upto]).sum(1)
                ok, matches, done = ok[matches >= least], matches[matches >= least], upto
            if not len(ok):
                continue
            has[ids[at[i]:at[i + 1]]] = True
            for j in ok.tolist():
                if comp[j] == comp[i]:
                    continue
                both = int(np.count_nonzero(has[ids[at[j]:at[j + 1]]]))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    yield label[i], label[j]
                    comp[comp == comp[j]] = comp[i]
            has[ids[at[i]:at[i + 1]]] = False

    def compared(batches):
        held, unit = [], None
        out = lambda t: list(links(t))

        def pairs(found):
            return pa.RecordBatch.from_arrays([pa.array([v[k] for v in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            u = b.column("unit").to_numpy()
            edges = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and u[lo] != unit:
                    yield pairs(out(pa.Table.from_batches(held)))
                    held = []
                unit = u[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield pairs(out(pa.Table.from_batches(held)))

    return compared


def groups(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    out = _grouped(docs, k, percent, miss)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """Per row: ``doc_id, x`` (the text's hash), ``n_shingles, comp`` (its group's label, null for empty sets), ``component_id``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(_signed(docs, k))
    some = signed.where("n_shingles > 0")
    first = F.min(F.struct(F.isnull("doc_id").alias("_null"), "doc_id", "x"))
    classes = some.groupBy("node").agg(first.alias("_f"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.select("node", F.col("_f.doc_id").alias("first_id"), F.col("_f.x").alias("x"), "n", "sig"))
    bands = classes.select("node", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("_i", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("bucket")
    members = materialize(bands.select("node", "n", "bucket").join(shared, "bucket", "left_semi"))
    # what comparing needs, for classes that share a bucket only: their texts move once
    shares = members.select("node").distinct()
    # by id and text, as many rows may have one id or none
    of = classes.join(shares, "node", "left_semi").select("node", "sig", F.col("first_id").alias("_id"), F.col("x").alias("_x"))
    texts = docs.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_x"))).select("node", "sig", "text")
    known = materialize(_sets_of(texts, k).dropDuplicates(["node"]))
    # first each class with one pivot: of its buckets' first classes by a hash, the one that comes first
    order = F.struct(F.xxhash64("node").alias("_o"), "node", "n")
    pivots = members.groupBy("bucket").agg(F.min(order).alias("_p"))
    cells = materialize(members.join(pivots, "bucket").groupBy("node", "n").agg(F.min("_p").alias("_p")).select("node", "n", F.col("_p.node").alias("cell"), F.col("_p.n").alias("_n")))
    fits = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    links = _links(cells.where((F.col("node") != F.col("cell")) & fits).select(F.col("node").alias("x"), F.col("cell").alias("y")), known, percent, miss)
    # a class with a confirmed link takes its pivot's place; pivots may have taken another's
    links = links.select(F.col("a").alias("_a"), F.lit(True).alias("_ok"))
    linked = (F.col("node") == F.col("cell")) | F.coalesce("_ok", F.lit(False))
    pivots = materialize(cells.join(links, F.col("node") == F.col("_a"), "left").select("node", "n", "cell", F.when(linked, F.col("cell")).otherwise(F.col("node")).alias("comp"), linked.alias("linked")))
    cells = materialize(_chained(pivots).drop("linked"))
    more = materialize(_apart(members, cells, known, percent, miss))
    comp = cells.select("node", F.col("comp").alias("component"))
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("_m"), F.col("component").alias("_c"))
        comp = comp.join(joined, F.col("component") == F.col("_m"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    ids = _labels(classes.select("node", "first_id"), comp)
    smallest = ids.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    placed = ids.join(smallest, "comp").select(F.col("node").alias("_node"), "comp", "component_id")
    out = signed.join(placed, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "x", "n_shingles", "comp", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """The documents with one row of each group: the smallest ``doc_id`` (null last), of its texts the one with the smallest
    hash, and of rows that repeat both any one. Documents without words are in no group and stay."""
    g = materialize(_grouped(docs, k, percent, miss).where("comp is not null").groupBy("comp", "doc_id", "x").agg(F.count(F.lit(1)).alias("times")))
    order = F.struct(F.isnull("doc_id").alias("_null"), "doc_id", "x")
    first = g.groupBy(F.col("comp").alias("_comp")).agg(F.min(order).alias("_f"))
    judged = g.join(first, F.col("comp") == F.col("_comp")).withColumn("stays", order.eqNullSafe(F.col("_f")))
    judged = materialize(judged.where(~F.col("stays") | (F.col("times") > 1)).select(F.col("doc_id").alias("_id"), F.col("x").alias("_x"), "stays"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_x") == F.col("_x"))
    docs, back = hidden(docs, ("stays",))
    keyed = docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_x": F.xxhash64("text")})
    marked = keyed.join(judged, same, "left").drop("_id", "_x")
    once = marked.where("stays is null")
    again = marked.where("stays").dropDuplicates(["_own_id", "_own_x"])
    return back(once.unionByName(again))
