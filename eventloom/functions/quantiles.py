"""Exact rank statistics without gathering a group's values in one task.

Values are counted, the counts are rolled up into order-preserving buckets (1/1024 of an octave), and a
running sum over the buckets of a group finds the bucket of each wanted rank.  Those buckets are cut into
a million cells each, and a second running sum finds the cells; only their distinct values are walked.  A
cell is 2⁻³⁰ of its values wide or narrower, so no window holds more than about four million rows,
however many values a group has and however close together they lie.
"""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

_PER_OCTAVE, _CELLS = 1024, 1 << 20
_SHIFT = 2_000_000  # keeps negative, zero and positive values in separate bucket ranges


def _size(x: Column) -> Column:
    return F.least(F.abs(x), F.lit(1.7e308))                  # infinities share the outermost buckets


def _octave(x: Column) -> Column:
    return F.floor(F.log2(_size(x)) * _PER_OCTAVE)


def _bucket(x: Column) -> Column:
    m = _octave(x) + _SHIFT
    return F.when(F.isnan(x), F.lit(10 * _SHIFT)).when(x > 0, m).when(x < 0, -m).otherwise(F.lit(0)).cast("bigint")


def _cell(x: Column) -> Column:
    """Where a value lies within its bucket; never decreasing in the value."""
    share = _size(x) / F.pow(F.lit(2.0), _octave(x) / _PER_OCTAVE) - 1
    at = F.floor(share * (_CELLS / (2 ** (1 / _PER_OCTAVE) - 1)))
    return F.when(F.isnan(x) | (x == 0), F.lit(0)).when(x > 0, at).otherwise(-at).cast("bigint")


def _ranks(n: Column, spec) -> list[tuple[Column, Column]]:
    """(rank, weight) pairs for one statistic."""
    if spec == "median":
        return [(F.floor((n + 1) / 2), F.lit(0.5)), (F.floor(n / 2) + 1, F.lit(0.5))]
    if spec == "upper_median":
        return [(F.floor(n / 2) + 1, F.lit(1.0))]
    kind, p = spec if isinstance(spec, tuple) else ("nearest", spec)
    if kind == "linear":
        at = (n - 1) * F.lit(float(p))
        lo = F.floor(at)
        return [(lo + 1, 1 - (at - lo)), (F.least(lo + 2, n), at - lo)]
    # ceil(p*n) on integers: p is a whole number of millionths
    q = int(round(p * 1_000_000))
    return [(F.greatest(F.lit(1), F.floor((n * q + 999_999) / 1_000_000)), F.lit(1.0))]


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, _c): how often each number occurs."""
    val = F.col(value).cast("double")
    return df.where(val.isNotNull()).groupBy(*keys, val.alias("_v")).agg(F.count("*").alias("_c"))


def _holding(counts: DataFrame, level: DataFrame, part: list, names: list[str]) -> DataFrame:
    """The values in those buckets of ``level`` (named by ``names``, the last in order) that hold a wanted rank.

    ``_below`` is how many values come before the bucket, ``_t`` the ranks wanted of it.
    """
    run = W.partitionBy(*part).orderBy(names[-1]).rowsBetween(W.unboundedPreceding, 0)
    level = level.withColumn("_below", F.col("_below") + F.sum("_cb").over(run) - F.col("_cb"))
    inside = lambda t: (t["rank"] > F.col("_below")) & (t["rank"] <= F.col("_below") + F.col("_cb"))
    hits = level.withColumn("_t", F.filter("_t", inside)).where(F.size("_t") > 0)
    named = hits.select(*[F.col(k).alias(f"_h_{k}") for k in names], "_below", "n", "_t")
    cond = F.lit(True)
    for k in names:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return counts.join(named, cond).drop(*[f"_h_{k}" for k in names])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, stats: dict, counted: bool = False) -> DataFrame:
    """One row per group: keys, ``n`` and one column per entry of ``stats``.

    With ``counted`` the input already is a value_counts table.  A stat is a fraction (nearest rank), "median", "upper_median" or ("linear", fraction).
    """
    counts = (df if counted else value_counts(df, keys, value)).withColumns({"_b": _bucket(F.col("_v")), "_s": _cell(F.col("_v"))})
    part = keys or [F.lit(0)]
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_cb")).withColumn("n", F.sum("_cb").over(W.partitionBy(*part)))
    wanted = []
    for name, spec in stats.items():
        for rank, weight in _ranks(F.col("n"), spec):
            wanted.append(F.struct(F.lit(name).alias("stat"), rank.cast("bigint").alias("rank"),
                                   weight.cast("double").alias("weight")))
    buckets = buckets.withColumns({"_t": F.array(*wanted), "_below": F.lit(0).cast("bigint")})
    near = _holding(counts, buckets, part, [*keys, "_b"])
    cells = near.groupBy(*keys, "_b", "_s", "n", "_below", "_t").agg(F.sum("_c").alias("_cb"))
    near = _holding(counts, cells, [*keys, "_b"], [*keys, "_b", "_s"])
    cum = W.partitionBy(*keys, "_b", "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_to", F.sum("_c").over(cum) + F.col("_below"))
    picked = (near.select(*keys, "n", "_v", F.explode(F.filter(
        "_t", lambda t: (t["rank"] <= F.col("_to")) & (t["rank"] > F.col("_to") - F.col("_c")))).alias("_t")))
    out = [F.sum(F.when(F.col("_t.stat") == s, F.col("_v") * F.col("_t.weight"))).alias(s) for s in stats]
    return picked.groupBy(*keys).agg(F.max("n").alias("n"), *out)
