"""Events stored by person, so that reports per person need no shuffle.

A store is a folder with two tables.  ``cold`` is bucketed by ``distinct_id`` and sorted within its buckets: grouping, windows and
joins by person find their rows together, whatever the report.  A bucket is read by one task, so people with more rows than a
block holds (the rule of ``functions.scan``) stay out of it; their rows lie in ``hot``, ranged by person and time, where reports
cut them into blocks.  Every person is in one of the two, so a report per person runs on each and the results are united.

Writing shuffles the events once, after a count of rows per person.  Rows without a person are a person like any other.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.functions import scan
from eventloom.model import attach_row
from eventloom.session import materialize

ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 1 << 16            # beyond it buckets grow with the table


@dataclass(frozen=True)
class Store:
    cold: DataFrame              # bucketed by distinct_id
    hot: DataFrame               # people with more rows than a block, without a layout by person
    rows_per_block: int

    def per_person(self, report: Callable[..., DataFrame]) -> DataFrame:
        """``report(events, block_rows)`` on both parts; right for reports whose rows concern one person each."""
        return report(self.cold, self.rows_per_block).unionByName(report(self.hot, self.rows_per_block))

    def each(self, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``report(events)`` on both parts, for reports that need no blocks."""
        return report(self.cold).unionByName(report(self.hot))


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """A power of two, so that stores of different size still join bucket by bucket."""
    return min(MAX_BUCKETS, 1 << max(0, (max(rows, 1) - 1) // rows_per_bucket).bit_length())


def write(events: DataFrame, path: str, table: str, buckets: int | None = None, rows_per_block: int = scan.ROWS_PER_BLOCK) -> Store:
    """Store ``events`` under ``path``; the bucketed part is the catalog's ``table``, replaced if it is there."""
    spark = events.sparkSession
    counts = materialize(events.groupBy("distinct_id").agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n").alias("_all"))
    limit = F.greatest(F.lit(rows_per_block), F.ceil(F.col("_all") / scan.MAX_BLOCKS))
    # at most MAX_BLOCKS people, so they may be broadcast
    hot = materialize(attach_row(counts, total).where(F.col("_n") > limit).select(F.col("distinct_id").alias("_hk"), F.lit(True).alias("_is_hot")))
    n = buckets or buckets_for(total.first()["_all"] or 0)
    marked = events.join(F.broadcast(hot), F.col("distinct_id").eqNullSafe(F.col("_hk")), "left")
    cold = marked.where("_is_hot is null").drop("_hk", "_is_hot")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (cold.repartition(n, "distinct_id").write.mode("overwrite").format("parquet").option("path", f"{path}/cold")
     .bucketBy(n, "distinct_id").sortBy("distinct_id", "timestamp").saveAsTable(table))
    marked.where("_is_hot").drop("_hk", "_is_hot").repartitionByRange("distinct_id", "timestamp").write.mode("overwrite").parquet(f"{path}/hot")
    spark.range(1).select(F.lit(n).alias("buckets"), F.lit(rows_per_block).alias("rows_per_block")).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return read(spark, path, table)


def read(spark: SparkSession, path: str, table: str) -> Store:
    """Open a store; a session whose catalog doesn't know ``table`` gets it declared over the files."""
    layout = spark.read.parquet(f"{path}/layout").first()
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(f"{path}/cold").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (distinct_id) SORTED BY (distinct_id, timestamp) "
                  f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/cold'")
    cold = spark.table(table)
    return Store(cold, spark.read.schema(cold.schema).parquet(f"{path}/hot"), layout["rows_per_block"])
