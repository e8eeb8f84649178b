"""Sources, stored tables, change detection and streaming on small inputs."""
import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from eventloom.operators import aicrawl as ac, changes as ch, errors as er, experiments as ex, funnel as fn, insights as ins, journeys, ops, sessions as se, web
from eventloom.sources import importers as im, ingest as ig, snapshots as sn, tables as tb
from eventloom.streaming import jobs
from tests.conftest import make_events


# ---- ingest and importers ------------------------------------------------------------------------
def test_ingest_repairs_and_rejects(spark):
    now = "2024-06-01 00:00:00"
    lines = [{"name": "a", "distinct_id": "u"}, {"name": "a", "distinct_id": "u", "timestamp": "0100-01-01T00:00:00Z"}, {"name": "a", "distinct_id": "u", "timestamp": "2030-01-01T00:00:00Z"},
             {"id": "k", "name": "a", "distinct_id": "u", "timestamp": "2024-05-01T10:00:00+02:00"}, {"name": "", "distinct_id": "u"}, {"name": "a"},
             {"name": "a", "distinct_id": "u", "properties": {f"p{i}": 1 for i in range(251)}}, {"name": "a", "distinct_id": "u", "properties": {"big": {"x": ["y" * 9000]}}},
             {"name": "a", "distinct_id": "u", "properties": {f"p{i}": "z" * 8000 for i in range(5)}}]
    d = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("[oops",)], "value string")
    r = ig.normalize(d, now)
    assert sorted(x["reason"] for x in ig.rejected(r).collect()) == ["event too large", "invalid JSON", "missing distinct_id", "missing event name", "property too large", "too many properties"]
    ok = ig.accepted(r).orderBy("timestamp", "id").collect()
    assert [x["timestamp"] for x in ok] == [dt.datetime(2024, 5, 1, 8)] + [dt.datetime(2024, 6, 1)] * 3
    again = {x["id"] for x in ig.accepted(ig.normalize(d, now)).collect()}
    assert again == {x["id"] for x in ok}            # made-up ids are the same on a retry


def test_dedup_first_wins(spark):
    d = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "x"), ("c", 1, "old")], "id string, n bigint, v string")
    got = sorted((r["id"], r["v"]) for r in ig.dedup(d, "n", spark.createDataFrame([("c",)], "id string")).collect())
    assert got == [("a", "first"), ("b", "x")]


def test_country_lookup_edges(spark):
    r = spark.createDataFrame([(0, 255, "AA"), (65000, 200000, "BB"), (4294967295, 4294967295, "ZZ")], "start bigint, end bigint, cc string")
    d = spark.createDataFrame([("0.0.0.255",), ("0.0.1.0",), ("0.3.13.64",), ("0.3.13.65",), ("255.255.255.255",), ("::1",), ("300.1.1.1",)], "ip string")
    got = {x["ip"]: x["country"] for x in ig.enrich_country(d, r, ig.ip_number(F.col("ip"))).collect()}
    assert got == {"0.0.0.255": "AA", "0.0.1.0": None, "0.3.13.64": "BB", "0.3.13.65": None, "255.255.255.255": "ZZ", "::1": None, "300.1.1.1": None}


def test_importer_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Event,User_ID,Time,Plan,uuid\nsignup,u1,2024-01-02 03:04:05,pro,k1\n,u2,,,\npay,u3,1704067200000,,k3\nx,u4,never,,\n")
    got = sorted((r["reason"] or "", r["name"], r["distinct_id"]) for r in im.load(spark, "csv", str(tmp_path / "a.csv")).collect())
    assert got == [("", "pay", "u3"), ("", "signup", "u1"), ("missing event name", "", "u2"), ("unparseable timestamp", "x", "u4")]
    row = {"event_type": "Up", "user_id": 12345, "event_time": "2024-01-01 12:00:00.5", "$insert_id": "z", "event_properties": {"a": 1, "n": {"m": 2}}, "user_properties": {"a": 9, "b": True}}
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps(row) + "\n\nbroken\n")
    d = im.load(spark, "amplitude", str(tmp_path / "b.json.gz"))
    r = d.where("reason is null").select("id", "distinct_id", "timestamp", F.to_json("properties").alias("p")).first()
    assert (r["id"], r["distinct_id"], r["timestamp"], json.loads(r["p"])) == ("z", "12345", dt.datetime(2024, 1, 1, 12, 0, 0, 500000), {"a": 1, "n": {"m": 2}, "b": True})
    assert {x["reason"]: x["rows"] for x in im.summary(d).collect()} == {"parsed": 1, "invalid JSON": 1}
    with pytest.raises(ValueError):
        im.load(spark, "nope", "x")


# ---- stored tables ---------------------------------------------------------------------------------
def test_store_export_erase_prune(spark, tmp_path):
    rows = [("$identify", "u1", 10, {"$anon_distinct_id": "anon"}), ("a", "anon", 0), ("a", "u2", 86400 * 2), ("a", "u1", 86400), ("a", "u2", 5)]
    path = str(tmp_path / "ev")
    tb.write_events(make_events(spark, rows), path)
    t = tb.read_events(spark, path)
    m = tb.manifest(t)
    m = spark.createDataFrame(m.collect(), m.schema)
    assert tb.verify(t, m).count() == 0
    who = spark.createDataFrame([("anon",)], "distinct_id string")
    assert {str(r[0]) for r in tb.touched_days(t, who).collect()} == {"2024-03-01", "2024-03-02"}
    tb.erase_in_place(spark, path, who)
    left = tb.read_events(spark, path)
    assert sorted((r["distinct_id"], str(r["day"])) for r in left.collect()) == [("u2", "2024-03-01"), ("u2", "2024-03-03")]
    assert not os.path.exists(f"{path}/day=2024-03-02")
    assert {r["problem"] for r in tb.verify(left, m).collect()} == {"count", "missing"}
    assert tb.prune(left, "2024-03-04 00:00:00", 2).count() == 1
    tb.export(left, str(tmp_path / "out"), "csv", ["day"])
    back = im.load(spark, "csv", str(tmp_path / "out"))
    assert back.where("reason is null").count() == 2


# ---- aggregates equal raw events ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def shop(spark):
    """45 days: checkout falls from 40 to 12 a day on day 25, all of it in Safari; signup is flat; refunds are rare."""
    rows = []
    for d in range(45):
        n = 40 if d < 25 else 12
        rows += [("checkout", f"u{d}-{i}", d * 86400 + i * 600, {"browser": "Safari" if i % 40 >= 12 else "Chrome", "amount": 10.0 + i % 3}) for i in range(n)]
        rows += [("signup", f"s{d}-{i}", d * 86400 + i * 900, {"browser": "Chrome" if i % 2 else "Safari"}) for i in range(30)]
        rows += [("refund", f"r{d}-{i}", d * 86400 + i, {"browser": "Chrome"}) for i in range(2)]
        rows += [("checkout", f"d{d}-{i}", d * 86400 + i, {"browser": "Chrome", "env": "development"}) for i in range(25)]
        rows += [("$pageview", f"u{d}-{i}", d * 86400 + i * 400, {"browser": "Chrome"}) for i in range(50)]
    from eventloom.operators.scope import scope_production
    return scope_production(make_events(spark, rows)).cache()


ASOF = "2024-04-14 23:00:00"     # day 44


def test_investigation(shop):
    r = ch.investigate(shop, ASOF).collect()
    assert [(x["name"], x["kind"], x["day"], x["before"], x["after"], x["people"]) for x in r] == [("checkout", "regression", "2024-03-26", 40.0, 12.0, 840)]
    assert (r[0]["cause_dim"], r[0]["cause_value"], r[0]["cause_share"], r[0]["recovered"], r[0]["needs_you"]) == ("browser", "Safari", 1.0, False, True)
    assert r[0]["usd_per_month"] > 0
    assert [(x["name"], x["per_day"]) for x in ch.below_floor(shop, ASOF).collect()] == [("refund", 2.0)]


def test_investigation_from_aggregates(shop, spark):
    b = sn.daily_counts(shop, "2024-03-01 00:00:00", "2024-04-15 00:00:00")
    seg = sn.segment_counts(shop, "2024-03-01 00:00:00", "2024-04-15 00:00:00", ["browser"])
    raw = ch.findings(shop, ASOF).collect()
    back = sn.expand(b, seg, ["browser"], chunk=7)
    assert back.count() == shop.count()
    f = ch.findings(back, ASOF)
    assert f.collect() == raw
    assert ch.concentration(back, f).collect() == ch.concentration(shop, ch.findings(shop, ASOF)).collect()


def test_overflowing_segment_is_left_out(spark):
    b = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 2, dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 3))], "day date, name string, count bigint, first timestamp, last timestamp")
    s = spark.createDataFrame([(dt.date(2024, 1, 1), "a", "os", "x", 3), (dt.date(2024, 1, 1), "a", "br", "y", 1)], "day date, name string, dim string, value string, count bigint")
    got = sorted((r["timestamp"].hour, r["os"], r["br"]) for r in sn.expand(b, s, ["os", "br"]).collect())
    assert got == [(1, None, "y"), (3, None, None)] and sn.overflow(b, s).first()["dim"] == "os"


def test_backtest_dates_the_finding(shop):
    r = {x["name"]: x for x in ch.backtest(shop, "2024-04-14 00:00:00", 30).where("kind = 'regression'").collect()}
    assert r["checkout"]["day"] == "2024-03-26" and 2 <= r["checkout"]["lag_days"] <= 6


def test_tracking_break_needs_a_witness(spark):
    rows = []
    for d in range(30):
        rows += [("signup", f"s{d}-{i}", d * 86400 + i * 60) for i in range(30)] if d < 20 else []
        rows += [("$pageview", f"p{d}-{i}", d * 86400 + i * 60) for i in range(100)]
    d = make_events(spark, rows)
    asof = "2024-03-30 12:00:00"
    f = ch.findings(d, asof)
    plan = spark.createDataFrame([("signup",)], "event string")
    assert [x["verdict"] for x in ch.tracking_break(d, f, plan, asof).collect()] == ["tracking_broke"]
    fell = d.where("name = 'signup' or timestamp < '2024-03-21'")
    assert [x["verdict"] for x in ch.tracking_break(fell, f, plan, asof).collect()] == ["witness_fell"]
    assert [x["verdict"] for x in ch.tracking_break(d, f, plan.where("false"), asof).collect()] == ["not_planned"]


def test_deploy_impact_needs_full_windows(spark):
    s = spark.createDataFrame([("a", d, c) for d, c in enumerate([10, 10, 10, 4, 4, 4, 4])], "name string, day bigint, c bigint")
    dep = spark.createDataFrame([("x", dt.datetime(1970, 1, 4)), ("y", dt.datetime(1970, 1, 2)), ("z", dt.datetime(1980, 1, 1))], "deploy string, at timestamp")
    got = {r["deploy"]: (r["direction"], r["significant"]) for r in ch.deploy_impact(s, dep).collect()}
    assert got == {"x": ("regression", True), "y": ("flat", False)}


def test_digest_and_blame(spark):
    rows = []
    for i in range(400):
        dev = "mobile" if i % 2 else "desktop"
        rows += [("$pageview", f"u{i}", i * 60, {"device": dev}), ("signup", f"u{i}", i * 60 + 5)]
        if i % 10 == 1 or i % 2 == 0:
            rows.append(("activate", f"u{i}", i * 60 + 9))
    d = make_events(spark, rows)
    w = ins.worst_dropoff(d, ["signup", "activate"]).first()
    assert (w["from_step"], w["to_step"], w["rate"], w["dropped"]) == ("signup", "activate", 60, 160)
    b = ins.segment_blame(d, ["signup", "activate"], 0).first()
    assert (b["prop"], b["value"], b["rate"], b["overall"]) == ("device", "mobile", 20, 60)
    kinds = {r["kind"] for r in ins.notable(d, "2024-03-02 00:00:00", ["signup", "activate"]).collect()}
    assert {"segment", "dropoff"} <= kinds


# ---- reports -----------------------------------------------------------------------------------------
def test_error_messages_group(spark):
    msgs = ["Failed https://a.b/c?d=1 at 12", "Failed https://x.y/z at 99", "id 0xdeadbeef99 'bob'", 'id 0xcafebabe11 "al"', "uuid 123e4567-e89b-12d3-a456-426614174000", "other"]
    d = spark.createDataFrame([(m,) for m in msgs], "m string")
    assert [r[0] for r in d.select(er.normalise(F.col("m"))).collect()] == ["Failed <url> at <n>"] * 2 + ["id <id> <value>"] * 2 + ["uuid <id>", "other"]


def test_paths_normalise(spark):
    d = spark.createDataFrame([("/a/?x=1",), ("https://h.c/b//",), ("https://h.c",), ("",), ("c#f",), ("/",), ("/a://b",)], "p string")
    assert [r[0] for r in d.select(ac.norm_path(F.col("p"))).collect()] == ["/a", "/b", "/", "/", "/c", "/", "/a://b"]
    ua = spark.createDataFrame([("x Claude-SearchBot claudebot",), ("Googlebot",)], "u string").select(ac.identify(F.col("u"))).collect()
    assert ua[0][0]["crawler"] == "Claude-SearchBot" and ua[1][0] is None


def test_journey_and_page_proposal(spark):
    rows = [("$pageview", f"u{i}", 0, {"path": "/"}) for i in range(40)] + [("$pageview", f"u{i}", 60, {"path": "/signup"}) for i in range(20)] + [("$pageview", f"u{i}", 120, {"path": "/checkout"}) for i in range(6)]
    got = [(r["path"], r["people"], r["confident"]) for r in journeys.propose_page_funnel(make_events(spark, rows)).orderBy("step").collect()]
    assert got == [("/", 40, True), ("/signup", 20, True), ("/checkout", 6, True)]


def test_digest_changes_with_the_rows(spark):
    d = make_events(spark, [("a", "u", i) for i in range(50)])
    one = ops.row_digest(d).first()["digest"]
    assert one == ops.row_digest(d.repartition(7)).first()["digest"] != ops.row_digest(d.limit(49)).first()["digest"]


def test_dims_sum_to_visitors(spark, sf):
    from eventloom.plans.inputs import Inputs
    c = Inputs(spark, sf)
    win = ("2024-01-01 00:00:00", "2024-01-31 00:00:00")
    n = web.overview(c.web, *win).first()["visitors"]
    t = web.first_touch_dims(c.web, *win).groupBy("dim").agg(F.sum("visitors").alias("v")).collect()
    assert {r["v"] for r in t if r["dim"] in ("referrer", "device", "browser", "country")} == {n}


# ---- streaming over several micro-batches equals the batch result ---------------------------------------
@pytest.fixture(scope="module")
def drip(spark, tmp_path_factory):
    """Events in time order over six files, so a stream sees them in six micro-batches."""
    import random
    r = random.Random(4)
    rows = sorted([(r.choice(["view", "click", "purchase", "x"]), f"u{r.randrange(30)}", r.randrange(0, 6 * 86400)) for _ in range(1500)], key=lambda e: e[2])
    d = make_events(spark, rows)
    path = str(tmp_path_factory.mktemp("drip"))
    for i in range(6):
        lo = dt.datetime(2024, 3, 1) + dt.timedelta(days=i)
        d.where((F.col("timestamp") >= lo) & (F.col("timestamp") < lo + dt.timedelta(days=1))).coalesce(1).write.mode("append").parquet(path)
    live = lambda: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.read.parquet(path), live


def test_stream_sessions_equal_batch(drip):
    batch, live = drip
    cut = batch.agg(F.max("timestamp")).first()[0] - dt.timedelta(hours=1, minutes=30)
    want = sorted((r["distinct_id"], r["start_us"], r["events"]) for r in se.sessions(batch).where(F.timestamp_micros("end_us") <= cut).collect())
    got = sorted((r["distinct_id"], int(r["start"].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), r["events"]) for r in jobs.run(jobs.sessions(live()), "s").collect())
    assert got == want


def test_stream_funnel_equals_batch(drip):
    batch, live = drip
    steps = ["view", "click", "purchase"]
    want = {r["distinct_id"]: r["reached"] for r in fn.outcomes(batch, steps, 7200).collect()}
    got = {r["distinct_id"]: r["m"] for r in jobs.run(jobs.funnel_state(live(), steps, 7200, "2 days"), "f").groupBy("distinct_id").agg(F.max("reached").alias("m")).collect()}
    assert got == want


def test_stream_tally_equals_batch(drip):
    batch, live = drip
    f = ex.Flag("f", (("control", 1), ("test", 1)), "purchase")
    def shape(d):
        e = F.col("name") == "view"
        return (d.withColumn(ex.P_FLAG, F.when(e, "f")).withColumn(ex.P_VARIANT, F.when(e, ex.variant_of(f, F.col("distinct_id")))).withColumn("name", F.when(e, ex.EXPOSURE).otherwise(F.col("name"))))
    want = {r["variant"]: (r["exposed"], r["converted"]) for r in ex.measure(shape(batch), [f]).collect()}
    got = {r["variant"]: (r["e"], r["c"]) for r in jobs.run(jobs.experiment_tally(shape(live()), [f]), "t").groupBy("variant").agg(F.sum("exposed").alias("e"), F.sum("converted").alias("c")).collect()}
    assert got == want
