"""Mixing sources to target weights: whole repetitions of each document plus one hash-seeded Bernoulli copy.

A null text has size 0; a null source is a source; a source of size 0 gets nothing. Rows that share a ``doc_id``, or have none,
draw each for itself. Empty input gives an empty mix. Other columns pass through; names that start with an underscore are the operator's.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import order
from eventloom.llm.columns import hidden
from eventloom.session import materialize

#: Source names of a plan that is broadcast take at most so many bytes together; a larger plan is joined by shuffling.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_rank(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the weights in turn over the sources by code point, null last."""
    placed = order.positions(sources, F.col("source").asc_nulls_last())
    n = order.numbered(placed, "_rank")
    return n.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int")).cast("double")).drop("_rank")


def targets(sources: DataFrame, most: float = 3.0, total: float | None = None) -> DataFrame:
    """``source, source_size, weight`` → with ``target`` and ``rate``: shares of ``total`` (default: all sizes) by weight, none above
    ``most`` times the source's size; the excess is shared again until none is above.

    Only three sums reach the driver per pass; a pass settles every source that is above at the present share.
    """
    cap = F.col("source_size") * F.lit(float(most))
    all_of = lambda above: sources.select(F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.sum(above.cast("long")).alias("n"), F.sum("source_size").alias("size")).first()
    share, settled = 0.0, -1
    while True:
        now = all_of(cap <= F.lit(share) * F.col("weight"))
        if (now["n"] or 0) == settled or not now["weight"]:
            break
        settled = now["n"]
        share = max(share, ((now["size"] if total is None else total) - (now["capped"] or 0.0)) / now["weight"])
    target = F.least(cap, F.lit(share) * F.col("weight")).cast("double")
    return sources.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed only: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_key``, what a row's draw depends on: its ``doc_id``, and for all but the first of the rows that share an id or have
    none, also their number among them, by text. Only rows that share an id are sorted, with a tie-break, so many equal ones part."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ids = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    ids = materialize(ids)
    if ids.isEmpty():
        return docs.withColumn("_key", own)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    shared = docs.join(ids, same, "left_semi").withColumns({"_h": F.md5(F.coalesce("text", F.lit("")).cast("binary")), "_tie": F.monotonically_increasing_id()})
    placed = order.positions(shared, F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_tie"))
    n = order.numbered(placed, "_number", "doc_id")
    shared = n.withColumn("_key", F.when(F.col("_number") == 0, own).otherwise(F.concat(own, F.lit("#"), F.col("_number")))).drop("_number", "_h", "_tie")
    return docs.join(ids, same, "left_anti").withColumn("_key", own).unionByName(shared)


def plan(docs: DataFrame, weights: tuple[float, ...] | DataFrame, most: float = 3.0, total: float | None = None) -> DataFrame:
    """One row per source of ``docs`` (``source``, ``size``). ``weights``: by rank of the source, or a table (source, weight)."""
    sizes = materialize(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    if isinstance(weights, DataFrame):
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sized = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    else:
        sized = by_rank(sizes, weights)
    return targets(materialize(sized), most, total)


def repetitions(docs: DataFrame, weights: tuple[float, ...] | DataFrame, most: float = 3.0, total: float | None = None, seed: str = "mix") -> DataFrame:
    """The documents with ``size``, their source's ``source_size``, ``target`` and ``rate``, and ``copies``."""
    sized = keyed(docs).withColumn("size", words(F.col("text")))
    p = materialize(plan(sized, weights, most, total))
    p = p.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    if (p.select(F.sum(F.octet_length("_source") + F.lit(32))).first()[0] or 0) <= BROADCAST_BYTES:
        p = F.broadcast(p)
    j = sized.drop("source_size", "target", "rate", "copies").join(p, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    extra = (draw(F.col("_key"), seed) < F.col("rate") - whole).cast("long")
    return j.withColumn("copies", whole + extra).drop("_key")


def mix(docs: DataFrame, weights: tuple[float, ...] | DataFrame, most: float = 3.0, total: float | None = None, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as often as drawn, in its own columns."""
    docs, back = hidden(docs, ("size", "source_size", "target", "rate", "copies"))
    r = repetitions(docs, weights, most, total, seed)
    copy = r.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return back(copy)
