"""Connected components by alternating large-star and small-star steps over an edge table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialize


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))


def _both(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """Two rows (a, b) of one."""
    return F.explode(F.array(F.struct(first[0].alias("a"), first[1].alias("b")), F.struct(second[0].alias("a"), second[1].alias("b")))).alias("_e")


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (longs) → ``node, component``, the smallest node that each reaches. Ends when the edges are stars.

    A node's neighbours are never gathered: each step joins the edges with one number per node.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("_m")
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # a center is no star's leaf, and a leaf has one center: then no step would change an edge
        ends = e.select(F.explode(F.array(F.struct(a.alias("node"), b.alias("to")), F.struct(b.alias("node"), F.lit(None).cast("long").alias("to")))).alias("_e")).select("_e.*")
        ends = ends.groupBy("node").agg(F.min("to").alias("component"), F.max("to").alias("_max"), F.count("to").alias("_up"), F.count(F.lit(1)).alias("_n"))
        if ends.where("_up > 0 and (_n > _up or component <> _max)").isEmpty():
            break
        both = e.select(_both((a, b), (b, a))).select("_e.*")
        large = both.where("b > a").join(_smallest(both), "a").select(b.alias("a"), m.alias("b")).where("a <> b")
        small = large.join(_smallest(large), "a").select(_both((b, m), (a, m))).select("_e.*").where("a <> b").distinct()
        e = materialize(small)
    return ends.select("node", F.coalesce("component", "node").alias("component"))
