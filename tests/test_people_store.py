"""Events stored by person: same reports, no exchange by person, hot people apart."""
import pytest
from pyspark.sql import functions as F

from conftest import make_events
from eventloom.operators import funnel as fn, identity as idn, sessions as se
from eventloom.sources import people

STEPS = ["view", "click", "buy"]


def exchanges(df):
    """Shuffles by person in the plan."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "distinct_id" in x]


@pytest.fixture(scope="module")
def events(spark):
    names = STEPS + ["other"]
    rows = [(names[(i * 7 + i // 5) % 4], f"u{i % 23}", i * 400, {"browser": "ab"[i % 2], "path": f"/{i % 5}"}) for i in range(900)]
    rows += [(names[(i * 3 + i // 7) % 4], "hot", i * 333, {"browser": "c", "path": "/h"}) for i in range(400)]
    return make_events(spark, rows)


@pytest.fixture(scope="module")
def store(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("people"))
    return path, people.write(events, path, "people_test", buckets=4, rows_per_block=100)


REPORTS = {
    "funnel": lambda d, rows=None: fn.outcomes(d, STEPS, 7200, block_rows=rows),
    "sessions": lambda d, rows=None: se.sessions(d, block_rows=rows),
    "touch": lambda d, rows=None: idn.stamp_first_touch(d, ["browser", "path"]).select("id", "distinct_id", "browser", "path"),
}


def same(a, b):
    key = lambda df: sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))
    assert key(a) == key(b)


@pytest.mark.parametrize("report", REPORTS)
def test_same_rows_and_no_exchange_by_person(spark, events, store, report):
    _, s = store
    assert s.hot.count() == 400 and {r[0] for r in s.hot.select("distinct_id").distinct().collect()} == {"hot"}
    same(s.per_person(REPORTS[report]), REPORTS[report](events))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # joins by person must not owe it to small tables
    try:
        assert exchanges(REPORTS[report](events)) and not exchanges(REPORTS[report](s.cold, 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_shuffle_and_one_file_a_bucket(spark, store, tmp_path):
    import pathlib
    files = [p.name for p in pathlib.Path(store[0], "cold").glob("*.parquet")]
    assert len(files) == len({f.split("_")[1].split(".")[0] for f in files}) <= 4


def test_another_catalog_reads_the_same_layout(spark, events, store):
    path, _ = store
    again = people.read(spark, path, "people_test_again")
    assert again.rows_per_block == 100
    same(again.each(lambda d: d), events)
    assert not exchanges(again.cold.groupBy("distinct_id").count())


def test_nobody_and_nothing(spark, tmp_path):
    ev = make_events(spark, [("view", None, i) for i in range(30)] + [("view", "", 1), ("view", "a", 2)])
    s = people.write(ev, str(tmp_path / "a"), "people_null", buckets=2, rows_per_block=10)
    assert (s.hot.count(), s.cold.count()) == (30, 2)
    same(s.each(lambda d: d.groupBy("distinct_id").count()), ev.groupBy("distinct_id").count())
    e = people.write(ev.limit(0), str(tmp_path / "b"), "people_empty")
    assert e.per_person(REPORTS["funnel"]).count() == 0
    assert people.buckets_for(0) == people.buckets_for(4_000_000) == 1 and people.buckets_for(4_000_001) == 2 and people.buckets_for(10 ** 13) == 1 << 16


def test_long_alias_chains_take_few_rounds(spark, monkeypatch):
    import datetime as dt
    n, base = 1000, dt.datetime(2024, 1, 1)
    rows = [(f"{i:04d}", f"a{i}", f"a{i - 1}", base + dt.timedelta(minutes=i)) for i in range(1, n + 1)]
    rows += [("x1", "p", "q", base), ("x1", "q", "p", base)]              # one event id, one instant: no circle
    rounds = []
    kept = idn.materialize
    monkeypatch.setattr(idn, "materialize", lambda df: rounds.append(1) or kept(df))
    got = {r["anon"]: r["canonical"] for r in idn.alias_map(spark.createDataFrame(rows, "eid string, anon string, canonical string, timestamp timestamp")).collect()}
    assert got == {**{f"a{i}": "a0" for i in range(1, n + 1)}, "p": "q", "q": "p"} and len(rounds) <= 12
