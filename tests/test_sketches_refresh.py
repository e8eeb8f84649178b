"""Sketches against exact counts, and late data: which days change, and that everything may be repeated."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import make_events
from eventloom.operators import sketches as sk
from eventloom.sources import refresh

DAY = 86400


def crowd(spark, n, days=10):
    """``n`` people, each active on two days that are five apart."""
    return spark.range(2 * n).select(F.concat(F.lit("e"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "buy").otherwise("view").alias("name"), F.concat(F.lit("u"), F.col("id") % n).alias("distinct_id"),
                                     F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % n % 5 + F.when(F.col("id") >= n, 5).otherwise(0)) * DAY + F.col("id") % 1000).alias("timestamp"))


def test_estimates_stay_within_their_bound(spark):
    ev = crowd(spark, 60_000)
    s = sk.merge(sk.daily(ev.where("id < 'e5'")), sk.daily(ev.where("id >= 'e5'")), sk.daily(ev.where("id < 'e3'")))     # a repeated batch adds nobody
    day = {(r["day"], r["name"]): r["people"] for r in sk.estimate(s, "day", "name").collect()}
    exact = {(r["day"], r["name"]): r["n"] for r in ev.groupBy(F.unix_date(F.to_date("timestamp")).alias("day"), "name").agg(F.count_distinct("distinct_id").alias("n")).collect()}
    assert day.keys() == exact.keys() and all(abs(day[k] - exact[k]) <= sk.bound() * exact[k] for k in exact)
    whole = sk.estimate(s).first()["people"]
    assert abs(whole - 60_000) <= sk.bound() * 60_000 and whole != 60_000       # more people than a sketch keeps one by one
    roll = {r["day"]: r["people"] for r in sk.rolling(sk.daily(ev), 6, "2023-12-31 00:00:00", "2024-01-20 00:00:00").collect()}
    first = 19723
    assert len(roll) == 20 and roll[first - 1] == 0 and roll[first + 15] == 0 and roll[first + 14] > 0
    assert abs(roll[first + 4] - 60_000) <= sk.bound() * 60_000 and abs(roll[first + 5] - 60_000) <= sk.bound() * 60_000
    two = sk.estimate(sk.window(s, "2024-01-02 00:00:00", "2024-01-04 00:00:00")).first()["people"]
    assert abs(two - 24_000) <= sk.bound() * 24_000


def test_sketches_of_nobody(spark):
    ev = make_events(spark, [("view", None, 0), ("view", "a", 1), ("view", "a", 2)])
    assert [(r["n"], r["people"]) for r in sk.estimate(sk.daily(ev)).collect()] == [(3, 1)]
    assert sk.daily(ev.limit(0)).count() == 0 and {r["people"] for r in sk.rolling(sk.daily(ev.limit(0)), 3, "2024-01-01 00:00:00", "2024-01-03 00:00:00").collect()} == {0}


def state(spark, store):
    rows = refresh.daily(spark, store).select("day", "name", "n", "first", "last", F.hll_sketch_estimate("people").alias("people")).collect()
    return {(r["day"], r["name"]): (r["n"], r["first"], r["last"], r["people"]) for r in rows}


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def full(events):
    g = events.groupBy(F.to_date("timestamp").alias("day"), "name").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_distinct("distinct_id").alias("people"))
    return {(r["day"], r["name"]): (r["n"], r["first"], r["last"], r["people"]) for r in g.collect()}


def test_late_rows_change_their_days_only(spark, tmp_path):
    store = str(tmp_path / "store")
    ev = make_events(spark, [("view", f"u{i % 7}", i * 20000) for i in range(60)])
    late = make_events(spark, [("view", "late", 3 * DAY + 5), ("buy", "late", 9 * DAY)]).withColumn("id", F.concat(F.lit("l"), "id"))
    refresh.append(ev, "b0", store)
    assert {r["day"] for r in refresh.refresh(spark, store).collect()} == {k[0] for k in full(ev)} and state(spark, store) == full(ev)
    before = files(tmp_path / "store" / "daily")
    refresh.append(late, "b1", store)
    touched = {r["day"] for r in refresh.refresh(spark, store).collect()}
    assert touched == {dt.date(2024, 3, 4), dt.date(2024, 3, 10)}
    changed = before ^ files(tmp_path / "store" / "daily")
    assert {f.split("/")[0] for f in changed} == {"day=2024-03-04", "day=2024-03-10"}          # no other partition was written
    assert state(spark, store) == full(ev.unionByName(late))
    assert refresh.refresh(spark, store).count() == 0 and refresh.dirty(spark, store) is None


def test_repeats_change_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    ev = make_events(spark, [("view", f"u{i % 7}", i * 9000) for i in range(60)])
    refresh.append(ev, "b0", store)
    refresh.append(ev, "b0", store)                                  # a batch that is run again after a crash
    waiting = refresh.dirty(spark, store).count()
    assert waiting == len({k[0] for k in full(ev)})
    refresh.refresh(spark, store)
    refresh.append(ev, "b0", store)                                  # and once more, after its refresh
    refresh.refresh(spark, store)
    assert state(spark, store) == full(ev)
    refresh.append(ev.limit(0), "b1", store)
    assert refresh.refresh(spark, store).count() == 0 and state(spark, store) == full(ev) and not refresh.waiting(spark, store)
    with pytest.raises(Exception, match="has no day"):
        refresh.append(ev.withColumn("timestamp", F.lit(None).cast("timestamp")), "b2", store)


def test_a_refresh_cut_short_is_made_up_for(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    ev = make_events(spark, [("view", f"u{i % 7}", i * 9000) for i in range(60)])
    refresh.append(ev, "b0", store)
    own = refresh.aggregate
    monkeypatch.setattr(refresh, "aggregate", lambda e: own(e).withColumn("n", F.raise_error(F.lit("lost")).cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        refresh.refresh(spark, store)
    monkeypatch.setattr(refresh, "aggregate", own)
    assert refresh.dirty(spark, store) is not None
    refresh.refresh(spark, store)
    assert state(spark, store) == full(ev)


def test_a_stream_keeps_the_store_up_to_date(spark, tmp_path):
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    ev = make_events(spark, [("view", f"u{i % 7}", i * 20000) for i in range(30)])
    late = make_events(spark, [("buy", "late", 100)])
    ev.write.parquet(source)
    stream = spark.readStream.schema(ev.schema).parquet(source)
    refresh.run(stream, "s", store)
    late.write.mode("append").parquet(source)
    refresh.run(stream, "s", store)                                   # goes on from its checkpoint
    assert state(spark, store) == full(ev.unionByName(late))
