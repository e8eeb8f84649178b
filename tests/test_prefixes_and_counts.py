"""Paths looked up by their prefixes, and counts observed on the pass that stores."""
import json
import random

from pyspark.sql import functions as F

from eventloom.operators import aicrawl as ac
from eventloom.sources import ingest as ig


def test_prefix_lookup_equals_starts_with(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab/é") for _ in range(r.randrange(0, 9)))
    texts, blocked = [word() for _ in range(400)] + [None, "", "x" * 5000], {word() for _ in range(12)} - {""} | {"x" * 40}
    d = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "path string, n int")
    p = spark.createDataFrame([(b,) for b in blocked], "blocked string")
    got = {x["n"] for x in ac.not_starting_with(d, "path", p).collect()}
    assert got == {i for i, t in enumerate(texts) if t is None or not any(t.startswith(b) for b in blocked)}
    assert ac.not_starting_with(d, "path", p.limit(0)).count() == len(texts)


def test_many_prefixes_do_not_widen_rows(spark):
    d = spark.range(2000).select(F.concat(F.lit("/p/"), "id", F.lit("/x")).alias("path"))
    p = spark.range(100_000).select(F.concat(F.lit("/p/"), F.col("id") * 2, F.lit("/")).alias("blocked"))
    out = ac.not_starting_with(d, "path", p)
    assert out.count() == 1000 and out.columns == ["path"]


def test_counts_are_read_after_one_action(spark):
    lines = [json.dumps({"name": n, "distinct_id": who}) for n, who in [("$pageview", "a"), ("$pageview", "b"), ("buy", "c"), ("", "d"), ("buy", "")]] + ["{", ""]
    agents = ["Mozilla Chrome/1", "Googlebot/2", "Googlebot/2", "", "", "", ""]
    d = ig.normalize(spark.createDataFrame(list(zip(lines, agents)), "value string, user_agent string"), "2024-03-01 00:00:00")
    rows, seen = ig.observed(d, "counted", "user_agent")
    assert sorted(r["distinct_id"] for r in rows.collect()) == ["a", "c"]
    assert seen.get == {"rows": 7, "stored": 2, "bots": 1, "rejected_invalid_json": 2, "rejected_missing_event_name": 1, "rejected_too_many_properties": 0,
                        "rejected_property_too_large": 0, "rejected_event_too_large": 0, "rejected_missing_distinct_id": 1}
    rows, seen = ig.observed(d, "uncounted")
    assert rows.count() == 3 and seen.get["bots"] == 0
    rows, seen = ig.observed(d.limit(0), "none", "user_agent")
    assert rows.collect() == [] and seen.get["rows"] == 0
