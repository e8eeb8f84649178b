"""Late data: a ledger of touched days, and daily aggregates refreshed for those days only.

A store is a folder with three tables: ``events`` (partitioned by day and batch), ``ledger`` (a folder per batch that has not
been refreshed yet, with the days it touched) and ``daily`` (partitioned by day: counts, first and last event, and a sketch of
people per event). A batch writes its events and its days; a refresh recomputes the days in the ledger from the stored
events, replaces those partitions, and then drops the ledger entries it has used.

Everything may be repeated. A batch that is run again replaces its own partitions and ledger entry. A refresh that was cut
short leaves its ledger entries, so the next one recomputes the same days to the same values. The ledger holds waiting
batches only, so it does not grow with the life of the stream. Whatever the watermark of the reports was, a late row
changes exactly its own day. Rows without a time have no day and are refused.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.model import day
from eventloom.operators import sketches
from eventloom.session import materialize


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def append(batch: DataFrame, key: str, store: str) -> None:
    """Store the rows of one batch under its key, with its days in the ledger. The events may have any columns but ``day`` and ``batch``."""
    d = batch.withColumns({"day": F.when(F.col("timestamp").isNull(), F.raise_error(F.lit("an event without a time has no day")).cast("date")).otherwise(day()), "batch": F.lit(key)})
    d = d.repartitionByRange("day", "timestamp")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{store}/events")
    batch.select(day().alias("touched")).distinct().coalesce(1).write.mode("overwrite").parquet(f"{store}/ledger/batch={key}")


def waiting(spark: SparkSession, store: str) -> list[str]:
    """The folders of the ledger: one per batch since the last refresh."""
    fs, p = _path(spark, f"{store}/ledger")
    return [f"{store}/ledger/{e.getPath().getName()}" for e in fs.listStatus(p)] if fs.exists(p) else []


def dirty(spark: SparkSession, store: str) -> DataFrame | None:
    """(touched,): the days in the ledger; None if it is empty."""
    folders = waiting(spark, store)
    return spark.read.schema("touched date").parquet(*folders).distinct() if folders else None


def aggregate(events: DataFrame) -> DataFrame:
    """(name, n, first, last, people, day)"""
    g = events.groupBy("day", "name").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.hll_sketch_agg("distinct_id", sketches.LG_K).alias("people"))
    return g.select("name", "n", "first", "last", "people", "day")


def refresh(spark: SparkSession, store: str) -> DataFrame:
    """Recompute the days in the ledger; (day,): which they were."""
    folders = waiting(spark, store)            # a batch that comes meanwhile waits for the next refresh
    if not folders:
        return spark.createDataFrame([], "day date")
    days = materialize(spark.read.schema("touched date").parquet(*folders).select(F.col("touched").alias("day")).distinct())
    if not days.isEmpty():
        # calendar days: few enough for the broadcast that prunes the partitions of the events
        fresh = aggregate(spark.read.parquet(f"{store}/events").join(F.broadcast(days), "day", "left_semi"))
        fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{store}/daily")
    for folder in folders:
        fs, p = _path(spark, folder)
        fs.delete(p, True)
    return days


def daily(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/daily")


def run(stream: DataFrame, name: str, store: str) -> None:
    """Store and refresh everything available of a stream; ``name`` tells streams that feed one store apart."""
    def each(batch: DataFrame, number: int) -> None:
        append(batch, f"{name}-{number}", store)
        refresh(batch.sparkSession, store)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{store}/checkpoints/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
