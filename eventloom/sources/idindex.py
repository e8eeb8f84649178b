"""Which event ids are stored already, without reading the history's ids.

An index is a folder with two tables, partitioned by ``day`` and ``batch`` (a segment): ``ids``, and ``bloom``, a Bloom filter of
the segment's ids, made of blocks of 32,768 bits that are kept as 1,024 words.  An id lies in one block of a segment, so asking
a segment joins an id with one row.  The number of blocks is a power of two that fits the segment; segments of one size are asked
together.  Only the days whose filters answer are then read, by id, and checked exactly: a false hit costs reading, never a row.

A batch that is run again replaces its own segments, and does not look into them.  ``compact`` unites the segments of a day,
so that the number asked stays near the number of days.  Missing ids are never stored; events without a time count as 1970-01-01.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.model import day
from eventloom.session import materialize
from eventloom.sources import ingest
from eventloom.sources.refresh import _path

BITS = 24                 # bits an id at least; 82 false hits were measured when 3,000,000 ids asked a full segment
BLOCK_BITS = 32_768       # what bitmap_construct_agg makes
WORD_BITS = 32


def _probes(bits: int) -> int:
    return max(1, round(bits * 0.69))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(1)), blocks)


def _position(i, start: Column, step: Column) -> Column:
    return F.pmod(start + step * i, F.lit(BLOCK_BITS))


def _start_step() -> tuple[Column, Column]:
    h = F.xxhash64("id", F.lit(2))
    return F.pmod(h, F.lit(BLOCK_BITS)), F.shiftleft(F.pmod(F.shiftright(h, 20), F.lit(BLOCK_BITS // 2)), 1) + 1      # an odd step meets every bit


def _words(bitmap: Column) -> Column:
    """The bytes of a bitmap as big-endian words."""
    n = WORD_BITS // 8
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // WORD_BITS - 1)), lambda w: F.conv(F.hex(F.substring(bitmap, w * n + 1, F.lit(n))), 16, 10).cast("bigint"))


def _is_set(words: Column, position: Column) -> Column:
    byte = F.shiftright(position, 3)
    n = WORD_BITS // 8
    at = (n - 1 - byte % n) * 8 + position % 8
    return F.getbit(F.get(words, F.call_function("div", byte, F.lit(n)).cast("int")), at.cast("int")) == 1


def filters(ids: DataFrame, bits: int = BITS) -> DataFrame:
    """(day, blocks, block, probes, words) of distinct (day, id)."""
    want = F.greatest(F.lit(1.0), F.col("_n") * bits / BLOCK_BITS)
    sizes = ids.groupBy("day").agg(F.count("*").alias("_n")).select("day", F.pow(F.lit(2.0), F.ceil(F.log2(want))).cast("bigint").alias("blocks"))
    start, step = _start_step()
    placed = ids.join(F.broadcast(sizes), "day").select("day", "blocks", _block(F.col("blocks")).alias("block"), start.alias("_start"), step.alias("_step"))      # days: few
    # the block's ids meet first, so the bits are set where the block is made
    placed = placed.repartition("day", "blocks", "block")
    k = _probes(bits)
    bit = placed.select("day", "blocks", "block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _position(i, F.col("_start"), F.col("_step")))).alias("_p"))
    made = bit.groupBy("day", "blocks", "block").agg(F.bitmap_construct_agg("_p").alias("_bits"))
    return made.select("day", "blocks", "block", F.lit(k).alias("probes"), _words(F.col("_bits")).alias("words"))


def _write(ids: DataFrame, key: str, index: str, bits: int) -> None:
    ids = materialize(ids)
    out = lambda d, name: d.withColumn("batch", F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{index}/{name}")
    out(ids.repartitionByRange("day", "id").sortWithinPartitions("day", "id"), "ids")
    # last, as a segment counts from its filter on
    out(filters(ids, bits).repartition("day"), "bloom")


def record(events: DataFrame, key: str, index: str, bits: int = BITS) -> None:
    """Add the ids of a batch (``id``, ``timestamp``), whose key must be new or that of the same batch."""
    _write(events.where("id is not null").select("id", F.coalesce(day(), F.lit("1970-01-01").cast("date")).alias("day")).distinct(), key, index, bits)


def segments(spark: SparkSession, index: str) -> DataFrame | None:
    fs, p = _path(spark, f"{index}/bloom")
    if not fs.exists(p):
        return None
    return spark.read.schema("blocks bigint, block bigint, probes int, words array<bigint>, day date, batch string").parquet(f"{index}/bloom")


def _stored(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema("id string, day date, batch string").parquet(f"{index}/ids")


def candidates(ids: DataFrame, index: str, own: str | None = None) -> DataFrame | None:
    """(id, day, batch): segments whose filter knows the id; None if there are no segments."""
    f = segments(ids.sparkSession, index)
    if f is None:
        return None
    f = f if own is None else f.where(F.col("batch") != own)
    shapes = f.select("blocks", "probes").distinct().collect()           # powers of two: a few tens
    if not shapes:
        return None
    start, step = _start_step()
    sizes = F.array(*[F.lit(n).cast("bigint") for n in sorted({r["blocks"] for r in shapes})])
    asked = ids.where("id is not null").select("id").distinct().withColumns({"_start": start, "_step": step, "blocks": F.explode(sizes)})
    asked = asked.withColumn("block", _block(F.col("blocks")))
    j = asked.join(f, ["blocks", "block"])
    for i in range(max(r["probes"] for r in shapes)):
        j = j.where((F.col("probes") <= i) | _is_set(F.col("words"), _position(F.lit(i), F.col("_start"), F.col("_step"))))
    return j.select("id", "day", "batch")


def known(ids: DataFrame, index: str, own: str | None = None) -> DataFrame:
    """(id,): those of ``ids`` that a segment, other than of batch ``own``, holds."""
    spark = ids.sparkSession
    hits = candidates(ids, index, own)
    if hits is None:
        return spark.createDataFrame([], "id string")
    hits = materialize(hits)
    days = [r["day"] for r in hits.select("day").distinct().collect()]    # calendar days
    return hits.join(_stored(spark, index).where(F.col("day").isin(days)), ["day", "batch", "id"], "left_semi").select("id").distinct()


def dedup(batch: DataFrame, order: str, index: str, key: str | None = None) -> DataFrame:
    """The first row of each id that is not stored yet; ``key`` names the batch, for when it is run again."""
    first = ingest.dedup(batch, order)
    return first.join(known(first.select("id"), index, key), "id", "left_anti")


def compact(spark: SparkSession, index: str, keep: tuple[str, ...] = (), bits: int = BITS) -> None:
    """Unite the segments of each day that has several; those of the batches in ``keep``, which may be run again, stay.

    The new segments are written before the old ones go, so a compaction that is cut short leaves ids twice, which is harmless.
    """
    f = segments(spark, index)
    if f is None:
        return
    per = f.select("day", "batch").distinct().where(~F.col("batch").isin(*keep))
    old = per.join(per.groupBy("day").agg(F.count("*").alias("_n")).where("_n > 1").select("day"), "day").collect()      # segments since the last time
    if not old:
        return
    ids = _stored(spark, index).where(F.col("day").isin([d for d in {r["day"] for r in old}]) & ~F.col("batch").isin(*keep))
    _write(ids.select("id", "day").distinct(), f"united-{uuid.uuid4().hex}", index, bits)
    for r in old:
        for table in ("bloom", "ids"):
            fs, p = _path(spark, f"{index}/{table}/day={r['day']}/batch={r['batch']}")
            fs.delete(p, True)
