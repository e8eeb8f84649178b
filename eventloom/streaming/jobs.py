"""Structured Streaming jobs: ingest, trends, live actives, sessions, alerts, experiment tallies, funnels.

Each builder takes a streaming DataFrame and returns a streaming DataFrame; ``run`` drains what is
available into a Parquet sink.  ``active_users`` and ``alerts`` write what is final themselves.  The watermark delay is a parameter everywhere.  Micro-batch size is
bounded at the source (maxFilesPerTrigger / maxBytesPerTrigger).
"""
from __future__ import annotations

import uuid
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from eventloom.operators import insights as ins, ops, sketches
from eventloom.operators.scope import drop_sampler
from eventloom.session import checkpoint_dir, materialize
from eventloom.sources import ingest as ig
from eventloom.streaming.keyed import experiment_tally, funnel_state, use_rocksdb  # noqa: F401


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/eventloom/{name}-{uuid.uuid4().hex}"


def run(stream: DataFrame, name: str, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process everything available into Parquet, then read the result back as a batch."""
    spark = stream.sparkSession
    base = path or work_dir(spark, name)
    use_rocksdb(spark)
    q = (stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


# ---- ingest ------------------------------------------------------------------------------------
def ingest(lines: DataFrame, now: str, delay: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(accepted, dead letters): normalised, repaired, deduplicated by id within the watermark."""
    d = ig.normalize(lines, now)
    ok = ig.accepted(d).withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])
    return ok.withColumn("properties", F.to_json("properties")), ig.rejected(d)


# ---- windowed reports --------------------------------------------------------------------------
def trend(events: DataFrame, grain: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and event, emitted when the window is final."""
    w = drop_sampler(events).withWatermark("timestamp", delay).groupBy(F.window("timestamp", grain), "name").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "name", "n")


LIVE_OUT = "start timestamp, live bigint"


def _micros(spark: SparkSession, length: str) -> int:
    return spark.range(1).select(F.unix_micros(F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {length}"))).first()[0]


def _people_of(windows: DataFrame, seen: DataFrame, width: int, grain: int) -> DataFrame:
    """(start, live): distinct people of each window, a row per window, from (distinct_id, at), the grains people were seen in.

    A person is counted once in each window: at the first of their grains in it. So a grain counts in the windows that hold it but
    not the person's grain before, at most ``width // grain`` of them, and only numbers per grain are spread over windows.
    """
    once = seen.distinct()
    before = F.lag("at").over(W.partitionBy("distinct_id").orderBy("at"))
    n = F.lit(width // grain).cast("bigint")
    steps = once.select("at", F.least(F.coalesce(F.call_function("div", F.col("at") - before, F.lit(grain)), n), n).alias("back"))
    firsts = steps.groupBy("at", "back").agg(F.count("*").alias("n"))
    starts = F.sequence(F.col("at") - (F.col("back") - 1) * F.lit(grain), F.col("at"), F.lit(grain).cast("bigint"))
    live = firsts.select(F.explode(starts).alias("_us"), "n").groupBy(F.timestamp_micros("_us").alias("start")).agg(F.sum("n").alias("live"))
    return windows.join(live, "start", "left").fillna(0, ["live"])


def active_users(events: DataFrame, path: str, width: str = "5 minutes", slide: str = "1 minute", delay: str = "1 hour") -> None:
    """Exact distinct people of each sliding window, written to ``path/data`` when the window is final.

    The state is a row per open window, not per window and person: it tells which windows the watermark has passed. People are
    kept under ``path/rows``, one folder per micro-batch, as (distinct_id, grain); a batch reads back
    only the folders that reach into the windows it closes.  An event counts in every window that is still open when it comes, as
    in Spark's own windows.  A replayed batch overwrites its own output.
    """
    spark = events.sparkSession
    wide, every = _micros(spark, width), _micros(spark, slide)
    grain = gcd(wide, every)
    us = F.unix_micros("timestamp")
    d = events.withWatermark("timestamp", delay)
    seen = d.where("distinct_id is not null and timestamp is not null").select("distinct_id", (us - F.pmod(us, F.lit(grain))).alias("at"))
    final = d.groupBy(F.window("timestamp", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"))

    def close(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = "distinct_id string, at bigint, start timestamp"
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        own = spark.read.schema(row).parquet(f"{path}/rows/batch={batch_id}")
        own.agg(F.max("at").alias("hi")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        windows = own.where("start is not null").select("start")
        lo, hi = windows.agg(F.unix_micros(F.min("start")), F.unix_micros(F.max("start")) + wide).first()
        out = spark.createDataFrame([], LIVE_OUT)
        if lo is not None:
            marks = spark.read.schema("hi bigint, batch bigint").parquet(f"{path}/marks").where((F.col("batch") <= batch_id) & (F.col("hi") >= lo))
            # folders that reach into the windows that close: at most one per micro-batch of that time
            folders = [f"{path}/rows/batch={r[0]}" for r in marks.select("batch").collect()]
            rows = spark.read.schema(row).parquet(*folders).where((F.col("at") >= lo) & (F.col("at") < hi)) if folders else own.limit(0)
            out = _people_of(windows, rows.select("distinct_id", "at"), wide, grain)
        out.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    use_rocksdb(spark)
    q = (seen.unionByName(final, allowMissingColumns=True).writeStream.foreachBatch(close).option("checkpointLocation", f"{path}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def people_sketches(events: DataFrame, grain: str = "1 minute", delay: str = "1 hour", lg_k: int = sketches.LG_K) -> DataFrame:
    """(start, people): a sketch of the people of each tumbling window. The state is a sketch per open window, not a row per person;
    sliding windows are united from the emitted rows."""
    w = events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", grain)).agg(F.hll_sketch_agg("distinct_id", lg_k).alias("people"))
    return w.select(F.col("window.start").alias("start"), "people")


def united(windows: DataFrame, grain_s: int, width_s: int) -> DataFrame:
    """(start, live): estimated people of each sliding window of ``width_s`` that begins at a multiple of ``grain_s``."""
    back = F.transform(F.sequence(F.lit(0), F.lit(width_s // grain_s - 1)), lambda i: F.timestamp_micros(F.unix_micros("start") - i.cast("long") * F.lit(grain_s * 1_000_000)))
    return windows.select(F.explode(back).alias("start"), "people").groupBy("start").agg(F.hll_sketch_estimate(F.hll_union_agg("people")).alias("live"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    d = drop_sampler(events).withWatermark("timestamp", delay)
    s = d.groupBy("distinct_id", F.session_window("timestamp", gap).alias("w")).agg(
        F.count("*").alias("events"), F.max("timestamp").alias("last"), F.count(F.when(F.col("name") == "$rageclick", 1)).alias("rage_clicks"))
    return s.select("distinct_id", F.col("w.start").alias("start"), "last", "events", "rage_clicks")


ALERT_OUT = "id string, kind string, event string, start timestamp, n bigint, value double"
_HOUR = 3_600_000_000


def _window_counts(hours: DataFrame, rules: DataFrame, after: int, upto: int) -> DataFrame:
    """Count, relative and ratio rules at each end of their windows in (after, upto], with ``cur``, ``prev`` and ``den``; silence is 0."""
    w = F.col("window_hours")
    multiple = lambda x: F.call_function("div", x, w) * w
    ends = rules.withColumns({"_from": multiple(F.lit(after)) + w, "_to": multiple(F.lit(upto))}).where("_from <= _to")
    ends = ends.withColumn("end", F.explode(F.sequence("_from", "_to", w.cast("bigint")))).drop("_from", "_to")
    need = rules.select("id", "window_hours", "event", "against", F.explode(F.array_distinct(F.array("event", F.coalesce("against", "event")))).alias("name"))
    j = hours.join(need, "name").withColumn("_end", multiple(F.col("h")) + w)
    # an hour belongs to the window it lies in, and to the one after as its past
    j = j.withColumn("end", F.explode(F.array("_end", F.col("_end") + w)))
    cur, own, other = F.col("end") == F.col("_end"), F.col("name") == F.col("event"), F.col("name") == F.col("against")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    c = j.groupBy("id", "end").agg(total(cur & own).alias("cur"), total(~cur & own).alias("prev"), total(cur & other).alias("den"))
    return ends.join(c, ["id", "end"], "left").fillna(0, ["cur", "prev", "den"])


def _anomalies(hours: DataFrame, widths: list[int], after: int, upto: int) -> DataFrame:
    """(window_hours, end, value, n): the sharpest swing of a day against the days before, where it is a warning."""
    span = 24 * (ins.BASE_DAYS + 1)
    j = hours.withColumn("window_hours", F.explode(F.array(*[F.lit(x) for x in widths])))
    w = F.col("window_hours")
    first = F.call_function("div", F.greatest(F.col("h"), F.lit(after)), w) * w + w
    j = j.withColumns({"_from": first, "_to": F.call_function("div", F.least(F.col("h") + span, F.lit(upto)), w) * w}).where("_from <= _to")
    j = j.withColumn("end", F.explode(F.sequence("_from", "_to", w.cast("bigint"))))
    recent = F.col("h") >= F.col("end") - 24
    s = j.groupBy("window_hours", "end", "name").agg(F.sum("n").alias("volume"), F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("last24"), F.sum(F.when(~recent, F.col("n"))).alias("base"),
                                                    F.count_distinct(F.when(~recent, F.call_function("div", F.col("end") - 25 - F.col("h"), F.lit(24)))).alias("observed"))
    busiest = F.row_number().over(W.partitionBy("window_hours", "end").orderBy(F.desc("volume"), "name"))
    s = s.withColumn("_rn", busiest).where(F.col("_rn") <= 6)
    s = ins.swings(s).where(F.abs("dev") >= ins.SWING)
    best = s.groupBy("window_hours", "end").agg(F.min(F.struct((-F.abs("dev")).alias("d"), (-F.col("volume")).alias("v"), "name", "dev", "last24")).alias("b"))
    rose = F.col("b.dev") > 0
    pct = F.round(F.abs(F.col("b.dev")) * 100, 0)
    return best.where(ins.severity(rose, F.col("b.name")) == "warn").select("window_hours", "end", F.when(rose, pct).otherwise(-pct).alias("value"), F.col("b.last24").alias("n"))


def alerts(events: DataFrame, rules: DataFrame, path: str, delay: str = "1 hour") -> None:
    """Rules of every kind (``ops.ALERT_DDL``) over their own windows; met ones are written to ``path/data``.

    A rule is evaluated at every multiple of its ``window_hours`` since the epoch that the watermark has
    passed, so results do not depend on how events fall into micro-batches.  An event that never came
    counts 0 and can meet an ``lt`` rule.  An hour is known to be over once any event of it or a later
    hour is final.  ``anomaly`` ranks events by their volume in the eight days it looks at.

    Hourly counts are kept under ``path/hours``, one folder per micro-batch; a batch reads back only
    the folders that reach into the longest window.  A replayed batch overwrites its own output.
    """
    widths = sorted(r[0] for r in rules.where("kind = 'anomaly'").select("window_hours").distinct().collect())    # bounded by the declared rules
    longest = max([2 * (rules.agg(F.max("window_hours")).first()[0] or 0), 24 * (ins.BASE_DAYS + 1)])
    counted = rules.where(F.col("kind") != "anomaly")

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(F.call_function("div", F.unix_micros("start"), F.lit(_HOUR)).alias("h"), "name", "n")
        fresh.write.mode("overwrite").parquet(f"{path}/hours/batch={batch_id}")
        own = spark.read.schema("h bigint, name string, n bigint").parquet(f"{path}/hours/batch={batch_id}")
        own.agg(F.min("h").alias("lo"), (F.max("h") + 1).alias("hi")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        marks = spark.read.schema("lo bigint, hi bigint, batch bigint").parquet(f"{path}/marks").where(F.col("lo").isNotNull() & (F.col("batch") <= batch_id))
        before = F.col("batch") < batch_id
        lo, after, upto = marks.agg(F.min("lo"), F.max(F.when(before, F.col("hi"))), F.max("hi")).first()
        after = lo if after is None else after
        out = spark.createDataFrame([], ALERT_OUT)
        if upto is not None and upto > after:
            # folders that reach into the longest window: at most one per micro-batch of that time
            recent = [f"{path}/hours/batch={r[0]}" for r in marks.where(F.col("hi") > after - longest).select("batch").collect()]
            hours = materialize(spark.read.schema("h bigint, name string, n bigint").parquet(*recent).where(F.col("h") >= after - longest))
            start = lambda back: F.timestamp_micros((F.col("end") - back) * F.lit(_HOUR))
            met = ops.judged_alerts(_window_counts(hours, counted, after, upto)).where("met")
            out = out.unionByName(met.select("id", "kind", "event", start(F.col("window_hours")).alias("start"), F.col("cur").alias("n"), "value"))
            if widths:
                odd = rules.where("kind = 'anomaly'").join(_anomalies(hours, widths, after, upto), "window_hours")
                out = out.unionByName(odd.select("id", "kind", "event", start(F.lit(24)).alias("start"), "n", "value"))
        out.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    q = trend(events, "1 hour", delay).writeStream.foreachBatch(check).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
