"""Blocks cut by rows, the SQL guard, several outcomes per flag, many events side by side."""
import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import scan
from eventloom.operators import sqlview, trends
from tests.conftest import make_events


def test_blocks_hold_a_burst(spark):
    burst = spark.range(20_000).select(F.lit("hot").alias("distinct_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 7).alias("timestamp"))
    early = spark.sql("SELECT 'hot' AS distinct_id, TIMESTAMP '2001-01-01' AS timestamp UNION ALL SELECT 'cold', TIMESTAMP '2020-01-01'")
    rows = scan.with_blocks(burst.unionByName(early), rows_per_block=500)
    sizes = {(r["distinct_id"], r["_blk"]): r["n"] for r in rows.groupBy("distinct_id", "_blk").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) <= 500 and sum(sizes.values()) == 20_002 and len(sizes) < 200
    spans = rows.where("_hot").groupBy("_blk").agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")).orderBy("_blk").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def test_one_instant_stays_together(spark):
    rows = spark.range(3000).select(F.lit("k").alias("distinct_id"), F.timestamp_seconds(F.col("id") % 2).alias("timestamp"))
    assert scan.with_blocks(rows, rows_per_block=100).select("timestamp", "_blk").distinct().count() == 2


def test_sql_is_scoped_by_its_plan(spark):
    ev = make_events(spark, [("a", "u", 1, {"env": "development"}), ("a", "u", 2, {"env": "production"})])
    n = lambda q: sqlview.sql(ev, q).count()
    assert n("SELECT * FROM {events} WHERE name <> 'env'") == n("SELECT id FROM {events}") == 1
    assert n("SELECT * FROM {events} WHERE env IS NOT NULL") == 2
    assert n("WITH x AS (SELECT * FROM {events}) SELECT * FROM x WHERE id IN (SELECT id FROM {events})") == 1
    spark.range(1).createOrReplaceTempView("other_table")
    for bad in ("WITH x AS (SELECT 7 AS a) INSERT INTO t1 SELECT a FROM x", "SELECT * FROM other_table", "SELECT * FROM parquet.`/tmp`", "DROP VIEW other_table", "SELECT (SELECT max(id) FROM other_table) FROM {events}"):
        with pytest.raises(ValueError):
            sqlview.sql(ev, bad)


def test_sql_returns_all_rows(spark):
    ev = make_events(spark, [("a", "u", 1)])
    assert sqlview.sql(ev.crossJoin(spark.range(5000).select("id").withColumnRenamed("id", "copy")), "SELECT * FROM {events}").count() == 5000


def test_nine_events_side_by_side(spark):
    ev = make_events(spark, [(f"e{i}", "u", i) for i in range(9)])
    assert {r["name"] for r in trends.trend_multi(ev, [f"e{i}" for i in range(9)], "2024-03-01", "2024-03-02").collect() if r["n"]} == {f"e{i}" for i in range(9)}


def test_late_click_before_the_view_does_not_count(spark, tmp_path):
    from eventloom.streaming import jobs
    for i, (name, at) in enumerate([("view", 600), ("click", 300), ("click", 900)]):
        make_events(spark, [(name, "u" if i < 2 else "w", at)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make_events(spark, [("view", "w", 800)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["distinct_id"]: r["m"] for r in jobs.run(jobs.funnel_state(live, ["view", "click"], 3600), "late", str(tmp_path / "out")).groupBy("distinct_id").agg(F.max("reached").alias("m")).collect()}
    assert got == {"u": 1, "w": 2}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from eventloom import session

    class Off:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class None_:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            isDefined = staticmethod(lambda: False)
                        return Empty
                return None_

    class Fake:
        sparkContext = Off

        class conf:
            get = staticmethod(lambda key, default=None: None)
    with pytest.raises(ValueError):
        session.checkpoint_dir(Fake)


def test_close_values_do_not_share_a_cell(spark):
    from eventloom.functions import quantiles as q
    d = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 1_000_003 % 200_000 + 1_700_000_000).cast("double").alias("x"))
    got = q.exact_quantiles(d, ["g"], "x", {"m": "upper_median", "p90": 0.9}).first()
    assert (got["n"], got["m"], got["p90"]) == (200_000, 1_700_100_000, 1_700_179_999)
    v = F.col("x")
    assert d.groupBy(q._bucket(v), q._cell(v)).count().agg(F.max("count")).first()[0] <= 4
    ordered = [float("-inf"), -3e300, -2.5, -2.4999999, -1e-320, -0.0, 5e-324, 1.0, 1.0000000001, 2.0, 1.75e308, float("inf"), float("nan")]
    at = [(r[0], r[1]) for r in spark.createDataFrame([(x,) for x in ordered], "x double").select(q._bucket(v), q._cell(v)).collect()]
    assert at == sorted(at)


def test_limits_are_parameters(spark):
    from eventloom.operators import agents, errors, goals
    ev = make_events(spark, [("agent_turn", "u", i, {"conversation_id": f"c{i % 120}", "role": "user", "text": "t" * 600}) for i in range(240)])
    s = agents.sample(ev, limit=150, turns=None, chars=None)
    assert s.count() == 120 and s.agg(F.min(F.length("transcript"))).first()[0] > 1200
    bad = make_events(spark, [("$exception", "u", i, {"message": "m" * 210 + "xy"[i]}) for i in range(2)])
    win = ("2024-03-01 00:00:00", "2024-03-02 00:00:00", "2024-02-01 00:00:00")
    assert errors.groups(bad, *win).count() == 2 and errors.groups(bad, *win, chars=200).count() == 1
    clicks = make_events(spark, [("$click", "u", i, {"path": "/", "text": f"b{i}", "vw": 1000, "x": 1, "y": 60_000, "sy": 0, "tag": "a", "href": ""}) for i in range(20)])
    assert goals.heatmap_targets(clicks, "/", limit=None).count() == 20
    assert goals.heatmap(clicks, "/", max_y=None).first()["row"] == 3000


def test_alerts_do_not_depend_on_micro_batches(spark, tmp_path):
    from eventloom.operators import ops
    from eventloom.streaming import jobs
    rows = [("tick", "u", 3600 * h + 60) for h in range(80)] + [("view", "u", 86400 * day + 7200 + i) for day in range(3) for i in range(4 * (day + 1))]
    d = make_events(spark, sorted(rows, key=lambda r: r[2]))
    for i in range(4):
        lo = F.lit("2024-03-01").cast("timestamp") + F.expr(f"interval {20 * i} hours")
        d.where((F.col("timestamp") >= lo) & (F.col("timestamp") < lo + F.expr("interval 20 hours"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))
    d.coalesce(1).write.parquet(str(tmp_path / "one"))
    rules = spark.createDataFrame([("c", "count", "view", None, "gt", 7.0, 24), ("s", "count", "gone", None, "lt", 1.0, 24), ("r", "relative", "view", None, "gt", 50.0, 24), ("q", "ratio", "view", "tick", "gt", 40.0, 24)], ops.ALERT_DDL)

    def fired(name):
        live = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        jobs.alerts(live, rules, str(tmp_path / f"out-{name}"))
        return sorted((r["id"], r["start"].day, r["n"]) for r in spark.read.schema(jobs.ALERT_OUT).parquet(str(tmp_path / f"out-{name}" / "data")).collect())

    want = [("c", 2, 8), ("c", 3, 12), ("q", 3, 12), ("r", 2, 8), ("r", 3, 12), ("s", 1, 0), ("s", 2, 0), ("s", 3, 0)]
    assert fired("one") == want
    assert fired("many") == want
