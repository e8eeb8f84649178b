"""Live people per sliding window: rows against SQL and Spark's own windows, over micro-batches and restarts; what the state holds."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import make_events
from eventloom.streaming import jobs

MIN = 60


def add(events, path):
    events.coalesce(1).write.mode("append").parquet(path)


def live(spark, schema, src, base, **how):
    jobs.active_users(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), base, **how)
    return sorted(tuple(r) for r in spark.read.schema(jobs.LIVE_OUT).parquet(f"{base}/data").select(F.unix_seconds("start"), "live").collect())


def own_windows(events, base, width="5 minutes", slide="1 minute"):
    """A state row per window and person, by Spark's windows alone."""
    per = events.withWatermark("timestamp", "1 hour").groupBy(F.window("timestamp", width, slide), "distinct_id").agg(F.count("*").alias("n"))
    c = per.groupBy("window").agg(F.count("distinct_id").alias("live")).select(F.unix_seconds("window.start").alias("s"), "live")
    return sorted(tuple(r) for r in jobs.run(c, "own", base).collect())


def test_events_without_a_person_as_in_sql(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i*i*7) AS ts, CASE WHEN i%3<>1 THEN i%4 END AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{"k": 1}}' AS props
     FROM range(1, 60) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(f"SELECT start_us, live FROM ({entry.oracle_sql()['stream_active_users']})").fetchall())
    assert 0 in {n for _, n in want}
    assert sorted((r["start_us"], r["live"]) for r in entry.queries()["stream_active_users"](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("width,slide", [("5 minutes", "1 minute"), ("5 minutes", "2 minutes")])
def test_late_and_shuffled_events_as_in_own_windows(spark, tmp_path, width, slide):
    """Files overlap by more than the watermark's delay, so some events come too late for some of their windows or for all."""
    r = random.Random(11)
    src, schema = str(tmp_path / "in"), None
    for i in range(4):
        rows = [("view", None if r.random() < 0.05 else "hot" if r.random() < 0.3 else f"u{r.randrange(8)}", i * 40 * MIN + r.randrange(-70 * MIN, 20 * MIN)) for _ in range(150)]
        d = make_events(spark, rows)
        schema = d.schema
        add(d, src)
    own = own_windows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path / "own"), width, slide)
    assert len(own) > 30 and max(n for _, n in own) > 2
    assert live(spark, schema, src, str(tmp_path / "out"), width=width, slide=slide) == own


def test_goes_on_from_its_checkpoint_with_a_state_row_per_open_window(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    first = make_events(spark, [("view", f"u{i}", j * MIN) for i in range(40) for j in range(3)])
    add(first, src)
    assert live(spark, first.schema, src, base) == []
    assert spark.read.format("statestore").load(f"{base}/checkpoint").count() == 7      # not 40 people in each
    add(make_events(spark, [("view", "w", 2 * MIN + 1), ("view", "u1", 2 * MIN + 2), ("view", "w", 180 * MIN)]), src)
    got = live(spark, first.schema, src, base)
    assert [n for _, n in got] == [40, 40, 41, 41, 41, 41, 41]
    assert live(spark, first.schema, src, base) == got                                   # nothing new: nothing is written again
    assert spark.read.format("statestore").load(f"{base}/checkpoint").count() == 5
