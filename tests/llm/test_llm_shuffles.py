"""What intermediate tables leave on disk, and how often edges are walked."""
import time

from pyspark.sql import functions as F

from eventloom.llm import components as cc
from eventloom.session import materialize


def _shuffles(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_materialized_tables_leave_no_shuffle_files(spark):
    before = _shuffles(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    kept = materialize(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while (left := _shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert kept.count() == 97 and kept.agg(F.sum("n")).first()[0] == 10_000
    assert spark.conf.get(key, None) == was


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(cc, "materialize", lambda df: written.append(1) or materialize(df))
    edges = [(1, i) for i in range(2, 9)] + [(20, 21), (21, 20), (30, 30)]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 9)} | {20: 20, 21: 20}
    assert len(written) == 1
