"""Events whose free-form properties are stored shredded: each frequent property as a typed Parquet column inside the VARIANT.

Reports ask for properties by name as ever (``functions.values``). Over a shredded table Spark turns these into fields of the scan: a
filter on one property reads that property's column, and its comparison is pushed to the scan, where the plain form reads
and decodes every row's whole document. A property's type is inferred per file from its first rows; values of another type, and rare
properties, stay beside it in the plain form, so nothing is lost. Rows whose properties are null stay so.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WRITING = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}
READING = {"spark.sql.variant.allowReadingShredded": "true", "spark.sql.variant.pushVariantIntoScan": "true"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(events: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Store ``events``, VARIANT columns shredded, and open them."""
    spark = events.sparkSession
    with _settings(spark, WRITING):
        w = events.write.mode(mode)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Open a store; the session keeps the settings by which properties reach the scan, as plans are made when reports run."""
    for k, v in READING.items():
        spark.conf.set(k, v)
    return spark.read.parquet(path)
