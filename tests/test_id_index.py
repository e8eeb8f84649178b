"""The id index against an anti-join with all stored ids."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import make_events
from eventloom.sources import idindex as ix, ingest as ig

DAY = 86400


def events(spark, ids, day):
    return make_events(spark, [("view", "u", day * DAY)]).drop("id").crossJoin(spark.createDataFrame([(i,) for i in ids], "id string")).withColumn("n", F.xxhash64("id"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("bits", [1, 24])
def test_same_rows_as_the_whole_history(spark, tmp_path, bits):
    index = str(tmp_path / "ix")
    days = {d: [f"d{d}-{i}" for i in range(3000 if d == 2 else 400)] for d in range(6)}
    for d, own in days.items():
        ix.record(events(spark, own, d), f"b{d}", index, bits)
    history = spark.createDataFrame([(i,) for own in days.values() for i in own], "id string")
    batch = events(spark, [f"new-{i}" for i in range(1500)] + days[1][:50] + days[2][-50:], 9)
    batch = batch.unionByName(batch.limit(20))
    asked = ix.candidates(batch, index)
    false = asked.join(history, "id", "left_anti").count()
    assert false > 100 if bits == 1 else false < 5                  # one bit an id answers wrongly, and the rows are the same
    assert ids(ix.dedup(batch, "n", index)) == ids(ig.dedup(batch, "n", history)) == sorted(f"new-{i}" for i in range(1500))
    if bits == 24:
        assert asked.select("day").distinct().count() == 2
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        plan = ix.known(batch, index)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        read = [x.split("PartitionFilters: ")[1].split("PushedFilters")[0] for x in plan.splitlines() if "PartitionFilters: " in x and "/ids]" in x]
        assert read and all(set(re.findall(r"\d{4}-\d\d-\d\d", x)) == {"2024-03-02", "2024-03-03"} for x in read), plan


def test_every_stored_id_is_found(spark, tmp_path):
    index = str(tmp_path / "ix")
    own = events(spark, [f"{i:x}" for i in range(20000)] + ["", "é", "x" * 5000], 0)
    ix.record(own, "a", index)
    assert ix.segments(spark, index).select("blocks").distinct().first()[0] == 16
    assert ix.known(own, index).count() == 20003
    assert ix.known(own, index, own="a").count() == 0               # a batch doesn't meet its own earlier run


def test_repeats_and_compaction(spark, tmp_path):
    index = str(tmp_path / "ix")
    a, b, c = (events(spark, [f"{k}{i}" for i in range(30)], 0) for k in "abc")
    for _ in range(2):
        ix.record(a, "a", index)
    ix.record(b, "b", index)
    ix.record(c, "c", index)
    ix.record(events(spark, ["z"], 4), "c", index)                   # another day of the batch leaves its first
    ix.compact(spark, index, keep=("c",))
    seg = {(str(r["day"]), r["batch"][:6]) for r in ix.segments(spark, index).select("day", "batch").distinct().collect()}
    assert seg == {("2024-03-01", "united"), ("2024-03-01", "c"), ("2024-03-05", "c")}
    asked = a.unionByName(b).unionByName(c).unionByName(events(spark, ["z", "y"], 2))
    assert ix.known(asked, index).count() == 91 and ids(ix.dedup(asked, "n", index)) == ["y"]
    ix.compact(spark, index, keep=("c",))
    assert ix.known(asked, index).count() == 91


def test_missing_ids_and_times_and_nothing(spark, tmp_path):
    index = str(tmp_path / "ix")
    ev = events(spark, ["a", "b"], 0)
    assert ix.known(ev, index).count() == 0 and ids(ix.dedup(ev, "n", index)) == ["a", "b"]
    ix.record(ev.limit(0), "e", index)
    assert ix.known(ev, index).count() == 0
    ix.record(ev.withColumn("timestamp", F.lit(None).cast("timestamp")).unionByName(ev.withColumn("id", F.lit(None).cast("string"))), "n", index)
    assert ids(ix.known(ev, index)) == ["a", "b"]
