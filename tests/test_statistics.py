import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import stats
from eventloom.functions.quantiles import exact_quantiles
from eventloom.operators import experiment_units as eu, experiments as ex
from tests.conftest import make_events


def test_exact_quantiles(spark):
    r = random.Random(1)
    vals = [(k, r.choice([-1, 1]) * r.lognormvariate(0, 4) if r.random() < 0.9 else 0.0) for k in "ab" for _ in range(501 if k == "a" else 300)]
    d = spark.createDataFrame(vals, "g string, x double")
    got = {q["g"]: q for q in exact_quantiles(d, ["g"], "x", {"m": "median", "p90": 0.9, "p99": 0.99, "lin": ("linear", 0.25), "up": "upper_median"}).collect()}
    for g in "ab":
        x = np.sort([v for k, v in vals if k == g])
        n = len(x)
        near = lambda p: x[max(0, math.ceil(p * n - 1e-9) - 1)]
        q = got[g]
        assert (q["n"], q["p90"], q["p99"], q["up"]) == (n, near(0.9), near(0.99), x[n // 2])
        assert q["m"] == pytest.approx(np.median(x)) and q["lin"] == pytest.approx(np.quantile(x, 0.25))


def test_tails():
    assert stats.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert stats.z_at(0.975) == pytest.approx(stats.Z95)


def test_always_valid_p_round_trip():
    for n in (200, 5000, 40000):
        for p in (0.2, 0.01, 1e-6):
            half = 0.01 * stats.width_factor(n, p, 5000)
            assert stats._always_valid(half, 0.01, n, 5000) == pytest.approx(p, rel=1e-6)
    assert stats._always_valid(0, 0.01, 100, 5000) == 1.0 and stats._always_valid(9, 0.01, 100, 5000) == 1e-12


def test_peeking_false_positives(spark):
    """2,000 experiments without an effect, looked at every 200 users: the sequential interval holds its level."""
    looks, per = 50, 200
    rng = np.random.default_rng(7)
    c = rng.binomial(per // 2, 0.2, size=(2, 2000, looks)).cumsum(axis=2)
    n = np.arange(1, looks + 1) * (per // 2)
    rows = [(i, int(t), int(k), int(m)) for i in range(2000) for t, k, m in zip(c[0, i], c[1, i], n)]
    d = spark.createDataFrame(rows, "experiment bigint, ct bigint, cc bigint, nt bigint").withColumn("nc", F.col("nt"))
    s = ex.sequential(d.withColumn("flag", F.lit("f")), n_planned=5000)
    fixed = F.abs(F.col("diff")) > stats.Z95 * F.col("se")
    g = s.groupBy("experiment").agg(F.max("excludes_zero").alias("seq"), F.max(fixed).alias("fixed")).agg(F.avg(F.col("seq").cast("int")).alias("s"), F.avg(F.col("fixed").cast("int")).alias("f")).first()
    assert g["s"] <= 0.06 and g["f"] > 0.15


def test_assignment_is_stable_and_independent(spark):
    u = spark.range(20000).select(F.concat(F.lit("u"), "id").alias("distinct_id"))
    a, b = ex.Flag("x", (("c", 1), ("t", 1))), ex.Flag("y", (("c", 1), ("t", 1)))
    g = {(r[0], r[1]): r[2] for r in u.groupBy(ex.variant_of(a, F.col("distinct_id")), ex.variant_of(b, F.col("distinct_id"))).count().collect()}
    assert all(abs(n - 5000) < 300 for n in g.values())
    wide = ex.Flag("x", (("c", 2), ("t", 1)))
    moved = u.select(ex.variant_of(a, F.col("distinct_id")).alias("o"), ex.variant_of(wide, F.col("distinct_id")).alias("n")).where("o = 'c' and n <> 'c'").count()
    assert moved == 0


def exp(spark, rows):
    return make_events(spark, [(ex.EXPOSURE if n == "x" else n, u, t, ({ex.P_FLAG: "f", ex.P_VARIANT: p} | q) if n == "x" else q) for n, u, t, p, q in [(*r, {}) if len(r) == 4 else r for r in rows]])


def test_measure_keeps_dead_arms_and_repeat_converters(spark):
    f = ex.Flag("f", (("control", 1), ("test", 1), ("dead", 1)), "buy")
    d = exp(spark, [("buy", "u1", 0, None), ("x", "u1", 10, "control"), ("buy", "u1", 20, None), ("buy", "u2", 0, None), ("x", "u2", 10, "test"), ("x", "u3", 10, "test"), ("x", "u3", 30, "control"), ("buy", "u3", 10, None)])
    got = {r["variant"]: (r["exposed"], r["converted"]) for r in ex.measure(d, [f]).collect()}
    assert got == {"control": (1, 1), "test": (2, 1), "dead": (0, 0)}


def test_bucket_id_joins_goals_through_the_person(spark):
    f = ex.Flag("f", (("control", 1), ("test", 1)), "buy")
    d = exp(spark, [("x", "anon", 0, "control", {ex.P_BUCKET: "dev1"}), ("x", "user", 50, "control", {ex.P_BUCKET: "dev1"}), ("buy", "user", 60, None)])
    got = {r["variant"]: (r["exposed"], r["converted"]) for r in ex.measure(d, [f]).collect()}
    assert got["control"] == (1, 1)


def test_lift_reasons(spark):
    rows = [(0, 200, 60, 200, "test_zero"), (60, 200, 0, 200, "control_zero"), (0, 0, 1, 2, "no_sample"), (0, 9, 0, 9, "no_conversions"), (9, 9, 3, 9, "saturated"), (5, 1000, 2, 1000, "control_near_zero"), (500, 1000, 450, 1000, "ok")]
    d = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "ct bigint, nt bigint, cc bigint, nc bigint, want string")
    assert all(r["reason"] == r["want"] for r in ex.lift_intervals(d).collect())


def test_guardrail_verdicts(spark):
    f = ex.Flag("f", (("control", 1), ("test", 1)), "buy", mode="fixed", guardrails=(ex.Guardrail("err", "not_better", 10), ex.Guardrail("ok", "not_worse", 50), ex.Guardrail("buy", "not_worse", 1)))
    rows = []
    for i in range(400):
        arm = "control" if i % 2 else "test"
        rows.append(("x", f"u{i}", 0, arm))
        if i % 10 in (0, 2, 4, 6, 1, 3):
            rows.append(("err", f"u{i}", 9, None))
        if i % 5 < 4:
            rows.append(("ok", f"u{i}", 9, None))
    got = {r["event"]: r["status"] for r in ex.guardrails(exp(spark, rows), [f]).collect()}
    assert got == {"err": "FAIL", "ok": "PASS", "buy": "INCONCLUSIVE"}


def test_bh_is_monotone_and_steps_up(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    d = spark.createDataFrame([("e", f"v{i}", "m", x) for i, x in enumerate(p)], "experiment string, variant string, metric string, p double")
    r = ex.benjamini_hochberg(d, 0.05).orderBy("rank").collect()
    assert [x["p_adjusted"] for x in r] == [0.025, 0.025, 0.05, 0.05, 0.5] and [x["rejected"] for x in r] == [True] * 4 + [False]


def test_cuped_equals_direct_regression(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.poisson(3, n).astype(float)
    t = rng.integers(0, 2, n)
    pre = rng.random(n) < 0.8
    y = 0.7 * x * pre + 0.3 * t + rng.normal(0, 1, n)
    d = spark.createDataFrame([("f", f"u{i}", "test" if t[i] else "control", float(y[i]), float(x[i]), bool(pre[i])) for i in range(n)], "flag string, unit string, variant string, y double, x double, has_pre boolean")
    r = eu.cuped_adjust(d, [ex.Flag("f", (("control", 1), ("test", 1)))]).first()
    xi = np.where(pre, x, x[pre].mean())
    def hc1(m):
        inv = np.linalg.inv(m.T @ m)
        b = inv @ m.T @ y
        u = y - m @ b
        return b, np.sqrt((inv @ (m.T * u ** 2) @ m @ inv).diagonal() * n / (n - m.shape[1]))
    b0, s0 = hc1(np.column_stack([np.ones(n), t]))
    b1, s1 = hc1(np.column_stack([np.ones(n), t, xi, ~pre]))
    assert r["applied"] and r["raw_diff"] == pytest.approx(b0[1]) and r["raw_se"] == pytest.approx(s0[1])
    assert r["adj_diff"] == pytest.approx(b1[1]) and r["adj_se"] == pytest.approx(s1[1]) and r["theta"] == pytest.approx(b1[2])
    few = eu.cuped_adjust(d.withColumn("has_pre", F.lit(False)), [ex.Flag("f", (("control", 1), ("test", 1)))]).first()
    assert not few["applied"] and few["reason"] == "no_pre_period" and few["adj_se"] == few["raw_se"]


def test_mixed_units_are_left_out(spark):
    f = ex.Flag("f", (("control", 1), ("test", 1)), "buy")
    d = exp(spark, [("x", "a", 0, "control", {ex.P_BUCKET: "d"}), ("x", "b", 0, "test"), ("buy", "a", 9, None)])
    assert eu.cuped_units(d, [f], [eu.Outcome("f", "buy")]).count() == 0


def test_ratio_cluster_error_equals_delta_method(spark):
    rng = np.random.default_rng(5)
    rows = [("f", f"u{i}", "test" if i % 2 else "control", float(rng.gamma(2, 3)), float(rng.integers(1, 5))) for i in range(300)]
    d = spark.createDataFrame(rows, "flag string, unit string, variant string, num double, den double")
    for r in eu.ratio_metric(d, [ex.Flag("f", (("control", 1), ("test", 1)))]).collect():
        assert r["se"] == pytest.approx(r["se_cluster"], rel=1e-4)


def test_power_search_meets_its_own_rule(spark):
    d = spark.createDataFrame([("s", 5000, 100.0, 0.1, 20.0)], "segment string, units bigint, daily_units double, baseline double, mde_pct double")
    p = eu.power_search(eu.power_plan(d)).first()
    assert p["n_planned"] == 7678 and p["n_sequential"] > p["n_planned"] and p["recommended_days"] >= 14
    back = eu.power_plan(spark.createDataFrame([("s", 1, 1.0, 0.1, p["mde_for_units_pct"])], "segment string, units bigint, daily_units double, baseline double, mde_pct double")).first()
    assert abs(back["n_planned"] - 5000) <= 2
