"""The stored event table: writing, export, retention, erasure and audit."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.model import FIXED, lit_ts
from eventloom.operators import identity


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Day partitions, rows ordered by person inside files so footers prune by person too."""
    d = df.withColumn("day", F.to_date("timestamp"))
    # range partitioning on (day, time) splits a heavy day over several files
    d.repartitionByRange("day", "timestamp").sortWithinPartitions("day", "distinct_id", "timestamp").write.mode(mode).partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_rows(df: DataFrame, props=()) -> DataFrame:
    """(id, name, distinct_id, timestamp, properties): RFC 3339 times and JSON text."""
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    flat = [c for c in (props or df.columns) if c not in FIXED and c != "properties"]
    body = F.to_json(F.struct(*[F.col(c) for c in flat])) if flat else F.to_json("properties")
    return df.select("id", "name", "distinct_id", ts.alias("timestamp"), F.when(body != "{}", body).otherwise(F.lit("")).alias("properties"))


def export(df: DataFrame, path: str, fmt: str = "jsonl", props=()) -> None:
    rows = export_rows(df, props)
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.withColumn("properties", F.when(F.col("properties") != "", F.parse_json("properties"))).write.mode("overwrite").json(path)


def prune(df: DataFrame, asof: str, days: int) -> DataFrame:
    """Rows no older than ``days``; whole day partitions outside are never read."""
    cut = lit_ts(asof) - F.expr(f"interval {days} days")
    d = df.where(F.col("timestamp") >= cut)
    return d.where(F.col("day") >= F.to_date(cut)) if "day" in df.columns else d


def erase_list(df: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(distinct_id) closed over aliases: the canonical ids and every alias pointing at them."""
    a = identity.alias_map(identity.alias_edges(df))
    want = ids.select("distinct_id").join(a, F.col("distinct_id") == F.col("anon"), "left").select("distinct_id", F.coalesce("canonical", "distinct_id").alias("canonical"))
    canon = want.select("canonical").distinct()
    more = a.join(canon, "canonical", "left_semi").select(F.col("anon").alias("distinct_id"))
    return want.select("distinct_id").unionByName(canon.select(F.col("canonical").alias("distinct_id"))).unionByName(more).distinct()


def erase(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(erase_list(df, ids), "distinct_id", "left_anti")


def touched_days(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Day partitions that hold a row of the erased people: only these are rewritten."""
    return df.join(erase_list(df, ids), "distinct_id", "left_semi").select(F.to_date("timestamp").alias("day")).distinct()


def erase_in_place(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Rewrite only the touched day partitions of a stored table.

    The kept rows are checkpointed first: a job must not read the partitions it is replacing, and a
    lost executor must find them again.
    """
    from eventloom.session import checkpoint_dir
    checkpoint_dir(spark)
    table = read_events(spark, path)
    days = touched_days(table, ids)
    kept = erase(table.join(days, "day", "left_semi"), ids).checkpoint()
    gone = days.join(kept.select("day").distinct(), "day", "left_anti").checkpoint()
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    empty = [r["day"] for r in gone.collect()]          # calendar days that lost every row
    if empty:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for d in empty:
            fs.delete(hadoop(f"{path}/day={d}"), True)


def manifest(df: DataFrame) -> DataFrame:
    """(day, rows, min_us, max_us) per partition."""
    us = F.unix_micros("timestamp")
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("rows"), F.min(us).alias("min_us"), F.max(us).alias("max_us"))


def verify(df: DataFrame, recorded: DataFrame) -> DataFrame:
    """Mismatches between what is stored and the recorded manifest."""
    m = manifest(df).alias("s")
    j = m.join(recorded.alias("r"), F.col("s.day") == F.col("r.day"), "full")
    problem = (F.when(F.col("r.day").isNull(), "orphan").when(F.col("s.day").isNull(), "missing").when(F.col("s.rows") != F.col("r.rows"), "count")
               .when((F.col("s.min_us") < F.col("r.min_us")) | (F.col("s.max_us") > F.col("r.max_us")), "range"))
    z = F.lit(0).cast("bigint")
    return j.select(F.date_format(F.coalesce("s.day", "r.day"), "yyyy-MM-dd").alias("day"), problem.alias("problem"), F.coalesce("s.rows", z).alias("rows"), F.coalesce("r.rows", z).alias("recorded")).where("problem is not null")
