"""Keyed streaming state: restart from a checkpoint, and when state ends."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import make_events
from eventloom.operators import experiments as ex, funnel as fn
from eventloom.streaming import jobs

DAY = 86400


def held(spark, base, name, kind):
    """Rows that a state variable holds after the last batch."""
    r = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", name)
    return (r.option("flattenCollectionTypes", "true") if kind == "list" else r).load().count()


def add(events, path):
    events.coalesce(1).write.mode("append").parquet(path)


def follow(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def reached(out):
    return {r["distinct_id"]: r["m"] for r in out.groupBy("distinct_id").agg(F.max("reached").alias("m")).collect()}


def test_funnel_goes_on_from_its_checkpoint(spark, tmp_path):
    r = random.Random(8)
    steps = ["view", "click", "purchase"]
    ev = make_events(spark, sorted([(r.choice(steps), f"u{r.randrange(12)}", r.randrange(4 * DAY)) for _ in range(300)], key=lambda e: e[2]))
    cut = dt.datetime(2024, 3, 3)
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    live = lambda: jobs.funnel_state(follow(spark, ev.schema, src), steps, 20000, "5 days")
    add(ev.where(F.col("timestamp") < cut), src)
    first = reached(jobs.run(live(), "f", base))
    assert first == {r["distinct_id"]: r["reached"] for r in fn.outcomes(ev.where(F.col("timestamp") < cut), steps, 20000).collect()}
    add(ev.where(F.col("timestamp") >= cut), src)
    assert reached(jobs.run(live(), "f", base)) == {r["distinct_id"]: r["reached"] for r in fn.outcomes(ev, steps, 20000).collect()}
    rows = spark.read.parquet(f"{base}/data").count()
    jobs.run(live(), "f", base)                                   # nothing new: nothing is emitted again
    assert spark.read.parquet(f"{base}/data").count() == rows


def test_funnel_state_ends_one_window_after_the_last_event(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    early = make_events(spark, [("view", f"u{i}", i) for i in range(20)])
    add(early, src)
    out = jobs.run(jobs.funnel_state(follow(spark, early.schema, src), ["view", "click"], 3600, "1 hour"), "f", base)
    assert reached(out) == {f"u{i}": 1 for i in range(20)} and held(spark, base, "settled", "value") == 20
    add(make_events(spark, [("click", "u3", 30), ("view", "w", DAY)]), src)      # the click is in time, w's view ends all windows
    out = jobs.run(jobs.funnel_state(follow(spark, early.schema, src), ["view", "click"], 3600, "1 hour"), "f", base)
    assert reached(out)["u3"] == 2 and reached(out)["w"] == 1
    assert held(spark, base, "settled", "value") == 1 and held(spark, base, "held", "list") == 1     # w alone


def shaped(ev):
    e = F.col("name") == "view"
    return ev.withColumn(ex.P_FLAG, F.when(e, "f")).withColumn(ex.P_VARIANT, F.when(e, F.coalesce("arm", F.lit("a")))).withColumn("name", F.when(e, ex.EXPOSURE).otherwise(F.col("name")))


def tallies(out):
    return {r["variant"]: (r["e"], r["c"]) for r in out.groupBy("variant").agg(F.sum("exposed").alias("e"), F.sum("converted").alias("c")).collect() if r["e"]}


@pytest.mark.parametrize("stopped", ["", "2024-03-02 00:00:00"])
def test_units_of_a_stopped_flag_leave_the_state(spark, tmp_path, stopped):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    f = ex.Flag("f", (("a", 1), ("b", 1)), "buy", stopped=stopped)
    arm = {"arm": "a"}
    one = make_events(spark, [("view", "u", 100, arm), ("view", "v", 200, arm), ("view", "w", 90, arm), ("buy", "u", 300, arm)])
    two = make_events(spark, [("view", "u", 50, {"arm": "b"}), ("buy", "v", 3 * DAY, arm), ("view", "x", 3 * DAY, arm)])     # u's earlier exposure comes late
    three = make_events(spark, [("buy", "w", 4 * DAY, arm)])
    for n, batch in enumerate([one, two, three]):
        add(batch, src)
        out = jobs.run(jobs.experiment_tally(shaped(follow(spark, one.schema, src)), [f], "1 hour"), "t", base)
        if n == 0:
            assert tallies(out) == {"a": (3, 1)}
    if stopped:
        assert tallies(out) == {"a": (2, 0), "b": (1, 1)} and held(spark, base, "unit", "value") == 0
    else:
        assert tallies(out) == {"a": (3, 2), "b": (1, 1)} and held(spark, base, "unit", "value") == 4


def test_missing_ids_and_times(spark, tmp_path):
    src = str(tmp_path / "in")
    ev = make_events(spark, [("view", "u", 1), ("click", "u", 2), ("view", "v", 3)])
    add(ev.withColumn("id", F.lit(None).cast("string")).withColumn("timestamp", F.when(F.col("distinct_id") == "u", F.col("timestamp"))), src)
    assert reached(jobs.run(jobs.funnel_state(follow(spark, ev.schema, src), ["view", "click"], 60), "f", str(tmp_path / "out"))) == {"u": 2}
