"""Words of activity against the same reports over events, over spans of many words."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import make_events
from eventloom.operators import activity as ac, engagement as en, retention as rt, trends as tr


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for u in range(60):
        start, p = rng.randrange(-200, 200), rng.choice([0.02, 0.3, 0.95])
        rows += [(rng.choice(["view", "buy"]), f"u{u}", d * 86400 + rng.randrange(86400)) for d in range(start, start + rng.randrange(1, 250)) if rng.random() < p]
    rows += [("view", None, 0), ("view", None, 86400), ("view", "old", -80 * 365 * 86400), ("$ai_crawl", "u1", 5 * 86400)]
    return make_events(spark, rows)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [sorted(map(tuple, x.select(*cols).collect()), key=repr) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("days", [1, 7, 30, 59, 60])
def test_rolling(events, days):
    start, end = "2023-09-01 00:00:00", "2024-11-20 00:00:00"
    most = {}
    same(ac.rolling(ac.words(events), days, start, end), tr.active_users(events, days, start, end, most=most))


def test_lifecycle_and_stickiness(events):
    w = ac.words(events)
    same(ac.lifecycle(w, 500), en.lifecycle(events, 500))
    for asof in ("2024-03-01 00:00:00", "2024-09-01 00:00:00"):
        same(ac.stickiness(w, asof), en.stickiness(events, asof))


@pytest.mark.parametrize("bucket,periods,rolling", [("day", 14, False), ("day", 200, False), ("week", 30, False), ("month", 9, False), ("day", 90, True), ("week", 8, True)])
def test_grid(events, bucket, periods, rolling):
    same(ac.grid(ac.words(events), periods, bucket, rolling), rt.grid(events, periods, bucket=bucket, rolling=rolling))


def test_one_event(events):
    same(ac.grid(ac.words(events, "buy"), 20), rt.grid(events, 20, event="buy"))


def test_batches_unite_and_repeat(events):
    even = F.pmod(F.hash("id"), F.lit(2)) == 0
    a, b = ac.words(events.where(even)), ac.words(events.where(~even))
    same(ac.merge(a, b, a), ac.words(events))


def test_periods_of_words_are_periods_of_events(events):
    for days in (1, 7, 30):
        same(ac.by_period(ac.words(events), days), ac.words(events, days=days))


def test_parts_of_days_and_long_windows_are_refused(events):
    w = ac.words(events)
    with pytest.raises(ValueError):
        ac.stickiness(w, "2024-03-01 12:00:00")
    with pytest.raises(ValueError):
        ac.rolling(w, 61, "2024-03-01", "2024-03-02")


def test_empty(events):
    w = ac.words(events.where("false"))
    assert {r.n for r in ac.rolling(w, 7, "2024-03-01", "2024-03-05").collect()} == {0}
    assert ac.lifecycle(w).count() == 0 and ac.grid(w, 5).count() == 0
    assert ac.stickiness(w, "2024-03-01").first().mau == 0


def test_stored_words_need_no_exchange_by_person(spark, events, tmp_path):
    w = ac.store(ac.words(events), str(tmp_path / "words"), "activity_words_test", 4)
    keys = {}
    for name, report in {"rolling": lambda t: ac.rolling(t, 30, "2024-01-01", "2024-06-01"), "lifecycle": lambda t: ac.lifecycle(t, 100), "grid": lambda t: ac.grid(t, 30),
                         "sticky": lambda t: ac.stickiness(t, "2024-09-01")}.items():
        plan = report(w)._jdf.queryExecution().executedPlan().toString()
        keys[name] = [x for x in plan.splitlines() if "Exchange hashpartitioning(distinct_id" in x]
    assert not any(keys.values()), keys
    same(ac.lifecycle(w, 100), en.lifecycle(events, 100))
    spark.sql("DROP TABLE activity_words_test")
    same(ac.grid(ac.open_store(spark, str(tmp_path / "words"), "activity_words_test", 4), 30), rt.grid(events, 30))
