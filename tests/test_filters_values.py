import pytest
from pyspark.sql import functions as F

from eventloom.functions import scalars as sc, values as v
from eventloom.operators import filters as flt, identity as idn, trends as tr, retention as rt, engagement as en
from eventloom.operators.filters import Filter
from eventloom.operators.scope import drop_sampler, scope_production
from tests.conftest import make_events


def variant(spark, *bodies):
    d = spark.createDataFrame([(f"e{i}", "a", f"u{i}", b) for i, b in enumerate(bodies)], "id string, name string, distinct_id string, b string")
    return d.select("id", "name", "distinct_id", F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.parse_json("b").alias("properties"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_variant_text_and_numbers(spark):
    d = variant(spark, '{"x": 50.0}', '{"x": "50"}', '{"x": true}', '{"x": null}', '{}', '{"x": "1d"}', '{"x": {"y": 1}}')
    rows = d.orderBy("id").select(v.text(d, "x"), v.num_strict(d, "x"), v.num_lenient(d, "x"), v.present(d, "x"), v.label(d, "x")).collect()
    assert [tuple(r) for r in rows] == [("50", 50.0, 50.0, True, "50"), ("50", None, 50.0, True, "50"), ("true", None, None, True, "true"), (None, None, None, True, "(none)"),
                                        (None, None, None, False, "(none)"), ("1d", None, None, True, "1d"), ('{"y":1}', None, None, True, '{"y":1}')]


@pytest.mark.parametrize("f,want", [
    (Filter("plan", "eq", "pro"), ["e0"]), (Filter("plan", "neq", "pro"), ["e1", "e2", "e3"]), (Filter("plan", "set"), ["e0", "e1", "e3"]), (Filter("plan", "notset"), ["e2"]),
    (Filter("n", "gt", 5), ["e0", "e1"]), (Filter("n", "lt", 5), ["e2"]), (Filter("n", "in", [7]), ["e1"]), (Filter("n", "notin", [7]), ["e0", "e2", "e3"]),
    (Filter("referrer", "eq", "reddit.com"), ["e0"]), (Filter("plan", "regex", "^f"), ["e1"]), (Filter("plan", "contains", "re"), ["e1"]), (Filter("plan", "ncontains", "re"), ["e0", "e2", "e3"])])
def test_each_operator(spark, f, want):
    d = variant(spark, '{"plan":"pro","n":10,"referrer":"https://www.reddit.com/r/x"}', '{"plan":"free","n":"7"}', '{"n":1}', '{"plan":null,"n":"n/a"}')
    assert ids(flt.apply(d, [f])) == want


def test_env_scope_and_any_mode(spark):
    d = variant(spark, '{"env":"development"}', '{"env":"prod","p":1}', '{"p":1}', '{"env":"ci"}')
    assert ids(scope_production(d)) == ["e1", "e2"]
    assert ids(flt.apply(d, [Filter("env", "eq", "development"), Filter("p", "set")], any_mode=True)) == ["e0", "e1", "e2"]


def test_validation():
    for bad in (Filter("x", "gt", "abc"), Filter("x", "in", "a"), Filter("x", "nope"), Filter("", "set"), Filter("x", "regex", "(")):
        with pytest.raises(ValueError):
            flt.validate([bad])


def test_first_touch_batched_equals_chained(spark):
    d = make_events(spark, [("a", "u", 5, {"src": "x"}), ("b", "u", 1, {"dev": "m"}), ("c", "u", 9, {"src": "y", "dev": "d"}), ("a", "w", 0)])
    once = idn.stamp_first_touch(d, ["src", "dev"])
    twice = idn.stamp_first_touch(idn.stamp_first_touch(d, ["src"]), ["dev"])
    key = lambda df: sorted((r["id"], r["src"], r["dev"]) for r in df.collect())
    assert key(once) == key(twice) == [("e00000", "x", "m"), ("e00001", "x", "m"), ("e00002", "x", "m"), ("e00003", None, None)]


@pytest.mark.parametrize("block", [None, 2])
def test_alias_chains(spark, block):
    import datetime as dt
    t = lambda h: dt.datetime(2024, 1, 1, h)
    e = spark.createDataFrame([("1", "C", "D", t(1)), ("2", "B", "C", t(2)), ("3", "A", "B", t(3)), ("4", "X", "Y", t(4)), ("5", "Y", "Z", t(5)), ("6", "X2", "Y", t(6)), ("7", "A", "B", t(7))],
                              "eid string, anon string, canonical string, timestamp timestamp")
    got = {r["anon"]: r["canonical"] for r in idn.alias_map(e, block_rows=block).collect()}
    # an alias made later does not rewrite an earlier one
    assert got == {"C": "D", "B": "D", "A": "D", "X": "Y", "Y": "Z", "X2": "Z"}


def test_totals_agree_across_grains(spark):
    d = make_events(spark, [("a", f"u{i % 4}", i * 7000) for i in range(200)])
    win = ("2024-03-01 00:00:00", "2024-03-20 00:00:00")
    for unique in (False, True):
        totals = {r["total"] for g in ("hour", "day", "week", "month") for r in tr.trend(d, "a", *win, unique=unique, grain=g).collect()}
        assert totals == ({4} if unique else {200})
    assert sum(r["n"] for r in tr.trend_breakdown(d.withColumn("p", F.col("distinct_id")), "a", "p", *win).collect()) == 200


def test_hour_cap_keeps_recent_end_and_total(spark):
    d = make_events(spark, [("a", "u", i * 3600) for i in range(1000)])
    t = tr.trend(d, "a", "2024-03-01 00:00:00", "2024-04-15 00:00:00", grain="hour").collect()
    assert len(t) == 744 and {r["total"] for r in t} == {1000} and max(r["bucket"] for r in t) == "2024-04-14 23:00"


def test_measures(spark):
    d = make_events(spark, [("p", "u", 10, {"amt": "10"}), ("p", "u", 20, {"amt": "20"}), ("p", "u", 30, {"amt": "oops"}), ("p", "u", 40), ("p", "u", 90000, {"amt": "5.5"})])
    t = {r["bucket"]: r for r in tr.measure(d, "p", "amt", "2024-03-01 00:00:00", "2024-03-04 00:00:00").collect()}
    assert (t["2024-03-01"]["n"], t["2024-03-01"]["median"], t["2024-03-01"]["p90"]) == (2, 15.0, 20.0)
    assert (t["2024-03-03"]["n"], t["2024-03-03"]["sum"]) == (0, 0.0) and (t["total"]["sum"], t["total"]["n"], t["total"]["median"]) == (35.5, 3, 10.0)


def test_rolling_actives_do_not_depend_on_the_clock(spark):
    d = make_events(spark, [("a", f"u{i}", i * 40000) for i in range(20)])
    a = {r["bucket"]: r["n"] for r in tr.active_users(d, 7, "2024-03-05 00:00:00", "2024-03-08 00:00:00").collect()}
    b = {r["bucket"]: r["n"] for r in tr.active_users(d, 7, "2024-03-05 17:30:00", "2024-03-08 00:00:00").collect()}
    assert a == b


def test_rollup_gives_the_same_reports(spark, sf):
    from eventloom.operators import changes as ch, rollups
    from eventloom.plans.inputs import Inputs
    e = Inputs(spark, sf).prod
    u = rollups.user_day(e)
    same = lambda f: sorted(map(tuple, f(e).collect())) == sorted(map(tuple, f(u).collect()))
    assert same(lambda d: en.lifecycle(d, 10)) and same(lambda d: rt.grid(d, 10, bucket="week")) and same(lambda d: rt.grid(d, 5, "purchase", rolling=True))
    assert same(lambda d: tr.active_users(d, 7, "2024-01-05 00:00:00", "2024-01-31 00:00:00"))
    assert same(lambda d: ch.detect(d, "2024-01-31 00:00:00")) and same(lambda d: ch.backtest(d, "2024-01-31 00:00:00", 10))


def test_retention_nulls_unfinished_periods(spark):
    d = make_events(spark, [("a", "u", 0), ("a", "u", 86400), ("a", "v", 86400)])
    g = {(r["cohort"], r["n"]): r["returned"] for r in rt.observable(rt.grid(d, 3), "2024-03-03 05:00:00").collect()}
    assert g[("2024-03-01", 1)] == 1.0 and g[("2024-03-01", 2)] is None and g[("2024-03-02", 0)] == 1.0 and g[("2024-03-02", 1)] is None


def test_formula_refuses_code(spark):
    s = spark.createDataFrame([("d", 4)], "bucket string, n bigint")
    assert tr.formula({"A": s, "B": s}, "-(A + B) / 2 * 1.5").first()["value"] == -6.0
    for bad in ("A.real", "__import__('os')", "A ** 2", "C + 1"):
        with pytest.raises(ValueError):
            tr.formula({"A": s}, bad)


def test_sampler_rows_hidden_unless_named(spark):
    d = make_events(spark, [("$ai_crawl", "$crawler", 0), ("a", "u", 0)])
    assert drop_sampler(d).count() == 1 and drop_sampler(d, "$ai_crawl").count() == 2


def test_sql_scalars(spark):
    d = spark.createDataFrame([(None, "10", "naïve"), ("x", "9", "abc")], "a string, b string, c string")
    r = d.select(sc.compare("!=", F.col("a"), "x"), sc.compare(">", F.col("b"), 9), sc.compare(">", F.col("b"), "9"), sc.length(F.col("c")), sc.substr(F.col("c"), 0, 2), sc.substr(F.col("c"), 99), sc.in_list(F.col("a"), ["", "y"])).collect()
    assert [tuple(x) for x in r] == [(False, True, False, 6.0, "na", "", True), (False, False, False, 3.0, "ab", "", False)]
