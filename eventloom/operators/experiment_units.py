"""Per-unit tables behind variance reduction and ratio metrics, and the estimates on top of them."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import stats, values as v
from eventloom.functions.quantiles import exact_quantiles
from eventloom.model import between
from eventloom.operators import experiments as ex

# fixed values: when a variance adjustment is not worth reporting, and the default lookback
MIN_PRE, MIN_COVERAGE, MIN_REDUCTION, LOOKBACK_DAYS = 100, 0.05, 0.01, 7


def randomisation_unit(people: DataFrame) -> DataFrame:
    """(flag, unit_kind, mixed): exposures carrying both kinds of unit cannot be analysed."""
    none = F.col("bucket").isNull()
    g = people.groupBy("flag").agg(F.count(F.when(~none, 1)).alias("b"), F.count(F.when(none, 1)).alias("d"))
    return g.select("flag", F.when(F.col("b") > 0, "bucket_id").otherwise("distinct_id").alias("unit_kind"), ((F.col("b") > 0) & (F.col("d") > 0)).alias("mixed"))


def _units(df: DataFrame, flags, start, end) -> tuple[DataFrame, DataFrame]:
    """First exposures of unmixed flags, and the (flag, distinct_id, unit) map."""
    people = ex.exposed_people(df, flags, start, end)
    people = people.join(randomisation_unit(people).where("not mixed").select("flag"), "flag", "left_semi")
    who = ex.unit_map(people, latest=False)
    first = people.join(who, ["flag", "distinct_id"]).groupBy("flag", "unit").agg(F.min("first").alias("f"))
    return first.select("flag", "unit", "f.variant", F.col("f.timestamp").alias("exposed_at")).where("variant <> ''"), who


@dataclass(frozen=True)
class Outcome:
    flag: str
    goal: str
    covariate: str = ""
    lookback_days: int = LOOKBACK_DAYS
    count: bool = False            # count goal events instead of 0/1


def cuped_units(df: DataFrame, flags, outcomes, start=None, end=None) -> DataFrame:
    """(flag, goal, covariate, unit, variant, y, x, has_pre): outcome after exposure, covariate count just before it.

    A flag may have several outcomes; each is a row per unit of its own.
    """
    first, who = _units(df, flags, start, end)
    spec = df.sparkSession.createDataFrame([(o.flag, o.goal, o.covariate or o.goal, o.lookback_days, o.count) for o in outcomes],
                                           "flag string, goal string, cov string, lookback int, as_count boolean")
    names = sorted({o.goal for o in outcomes} | {o.covariate or o.goal for o in outcomes})
    # first sight needs every event but only one row per person
    seen = df.groupBy("distinct_id").agg(F.min("timestamp").alias("seen"))
    units = first.join(spec, "flag")
    born = who.join(seen, "distinct_id").groupBy("flag", "unit").agg(F.min("seen").alias("first_seen"))
    ev = df.where(F.col("name").isin(*names)).select("distinct_id", "timestamp", "name")
    j = ev.join(who, "distinct_id").join(units, ["flag", "unit"])
    t = F.col("timestamp")
    goal = (F.col("name") == F.col("goal")) & (t >= F.col("exposed_at"))
    if start is not None:
        goal = goal & (t >= F.lit(start).cast("timestamp"))
    if end is not None:
        goal = goal & (t < F.lit(end).cast("timestamp"))
    back = F.col("exposed_at") - F.make_dt_interval(F.col("lookback"))
    pre = (F.col("name") == F.col("cov")) & (t >= back) & (t < F.col("exposed_at"))
    own = ["flag", "goal", "cov", "lookback", "as_count", "unit"]
    n = j.groupBy(*own).agg(F.count(F.when(goal, 1)).alias("goals"), F.count(F.when(pre, 1)).alias("pre"))
    out = units.join(n, own, "left").join(born, ["flag", "unit"], "left")
    goals = F.coalesce("goals", F.lit(0))
    y = F.when(F.col("as_count"), goals).otherwise(F.when(goals > 0, 1).otherwise(0)).cast("double")
    return out.select("flag", "goal", F.col("cov").alias("covariate"), "unit", "variant", y.alias("y"), F.coalesce("pre", F.lit(0)).cast("double").alias("x"),
                      F.coalesce(F.col("first_seen") <= back, F.lit(False)).alias("has_pre"))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Coefficients of the plain and the adjusted regression from one row of cross-product sums."""
    out = []
    for r in pdf.itertuples():
        n, st, sy, sty = r.n, r.st, r.sy, r.sty
        raw = np.array([[n, st], [st, st]], float)
        mean = r.sx / r.n1 if r.n1 else 0.0
        n0, t0, y0 = n - r.n1, st - r.st1, sy - r.sy1
        sx, sxx, sxt, sxy = r.sx + n0 * mean, r.sxx + n0 * mean ** 2, r.sxt + t0 * mean, r.sxy + y0 * mean
        full = np.array([[n, st, sx, n0], [st, st, sxt, t0], [sx, sxt, sxx, n0 * mean], [n0, t0, n0 * mean, n0]], float)
        k = 4 if n0 else 3
        row = dict(flag=r.flag, goal=r.goal, covariate=r.covariate, treatment=r.treatment, mean=mean, k=k, raw=[], raw_inv=[], adj=[], adj_inv=[])
        for name, m, xy in (("raw", raw, [sy, sty]), ("adj", full[:k, :k], [sy, sty, sxy, y0][:k])):
            try:
                if np.linalg.matrix_rank(m) == m.shape[0]:
                    inv = np.linalg.inv(m)
                    row[name], row[name + "_inv"] = list(inv @ np.array(xy, float)), list(inv.ravel())
            except np.linalg.LinAlgError:
                pass
        out.append(row)
    return pd.DataFrame(out, columns=["flag", "goal", "covariate", "treatment", "mean", "k", "raw", "raw_inv", "adj", "adj_inv"])


def _robust(pdf: pd.DataFrame) -> pd.DataFrame:
    """HC1 standard errors from the residual-weighted cross products, and the decision whether to adjust."""
    out = []
    for r in pdf.itertuples():
        def se(inv, meat, k):
            if not len(inv):
                return None
            a = np.array(inv, float).reshape(k, k)
            m = np.array(meat, float).reshape(4, 4)[:k, :k]
            var = (a @ m @ a).diagonal() * r.n / (r.n - k)
            return np.sqrt(var) if (var >= 0).all() else None
        sr, sa = se(r.raw_inv, r.meat_raw, 2), se(r.adj_inv, r.meat_adj, int(r.k))
        d = r.n1 * r.sxx - r.sx ** 2, r.n1 * r.syy1 - r.sy1 ** 2
        rho = (r.n1 * r.sxy - r.sx * r.sy1) / np.sqrt(d[0] * d[1]) if d[0] > 0 and d[1] > 0 else 0.0
        row = dict(flag=r.flag, goal=r.goal, covariate=r.covariate, treatment=r.treatment, units=int(r.n), with_pre=int(r.n1), rho=float(rho), applied=False, reason="",
                   raw_diff=0.0, raw_se=0.0, adj_diff=0.0, adj_se=0.0, theta=0.0, variance_reduction_pct=0.0, extra_units=0)
        if r.n - r.st < 2 or r.st < 2:
            row["reason"] = "arm_too_small"
        elif sr is None:
            row["reason"] = "raw_not_estimable"
        else:
            row.update(raw_diff=r.raw[1], raw_se=sr[1], adj_diff=r.raw[1], adj_se=sr[1])
            cut = 1 - (sa[1] / sr[1]) ** 2 if sa is not None and sr[1] > 0 else 0.0
            if r.n1 == 0:
                row["reason"] = "no_pre_period"
            elif r.n1 < MIN_PRE:
                row["reason"] = "few_with_pre"
            elif r.n1 / r.n <= MIN_COVERAGE:
                row["reason"] = "low_coverage"
            elif abs(rho) <= 2 / np.sqrt(r.n1):
                row["reason"] = "weak_correlation"
            elif d[0] <= 0:
                row["reason"] = "constant_covariate"
            elif sa is None:
                row["reason"] = "collinear"
            elif not (sa[1] > 0 and sr[1] > 0) or sa[1] >= sr[1]:
                row["reason"] = "not_narrower"
            elif cut < MIN_REDUCTION:
                row["reason"] = "too_little_gain"
            else:
                row.update(applied=True, adj_diff=r.adj[1], adj_se=sa[1], theta=r.adj[2], variance_reduction_pct=float(np.floor(cut * 1000 + 0.5) / 10),
                           extra_units=int(np.floor(r.n * ((sr[1] / sa[1]) ** 2 - 1) + 0.5)))
        out.append(row)
    return pd.DataFrame(out)


_SOLVED = "flag string, goal string, covariate string, treatment string, mean double, k int, raw array<double>, raw_inv array<double>, adj array<double>, adj_inv array<double>"
_RESULT = ("flag string, goal string, covariate string, treatment string, units bigint, with_pre bigint, rho double, applied boolean, reason string, raw_diff double, raw_se double, "
           "adj_diff double, adj_se double, theta double, variance_reduction_pct double, extra_units bigint")


def cuped_adjust(units: DataFrame, flags) -> DataFrame:
    """Regression adjustment with robust errors per flag, outcome and treatment arm.

    Two passes of plain sums over the units; only the one-row-per-arm tables meet Python.
    """
    pairs = [(f.key, f.arms[0][0], k) for f in flags for k, _ in f.arms[1:]]
    arms = units.sparkSession.createDataFrame(pairs, "flag string, control string, treatment string")
    own = ["flag", "goal", "covariate", "treatment"]
    units = units.withColumns({c: F.lit("") for c in ("goal", "covariate") if c not in units.columns})
    u = units.join(F.broadcast(arms), "flag").where("variant = control or variant = treatment").withColumn("t", (F.col("variant") == F.col("treatment")).cast("double"))
    x, y, t, p = F.col("x"), F.col("y"), F.col("t"), F.col("has_pre").cast("double")
    s = lambda e, n: F.sum(e).alias(n)
    sums = u.groupBy(*own).agg(
        F.count("*").cast("double").alias("n"), s(t, "st"), s(y, "sy"), s(t * y, "sty"), s(p, "n1"), s(p * x, "sx"), s(p * x * x, "sxx"), s(p * x * t, "sxt"),
        s(p * x * y, "sxy"), s(p * t, "st1"), s(p * y, "sy1"), s(p * y * y, "syy1"))
    solved = sums.mapInPandas(lambda it: (_solve(b) for b in it), _SOLVED)
    j = u.join(F.broadcast(solved), own)     # a row per declared outcome and arm
    xi = F.when(F.col("has_pre"), x).otherwise(F.col("mean"))
    feats = [F.lit(1.0), t, xi, 1 - p]
    # coalesce: a side that could not be solved has no coefficients
    fit = lambda name, k: sum((F.coalesce(F.try_element_at(name, F.lit(i + 1)), F.lit(0.0)) * feats[i] for i in range(k)), F.lit(0.0))
    r_raw, r_adj = y - fit("raw", 2), y - fit("adj", 4)
    meats = []
    for name, r in (("meat_raw", r_raw), ("meat_adj", r_adj)):
        meats.append(F.array(*[F.sum(r * r * feats[a] * feats[b]) for a in range(4) for b in range(4)]).alias(name))
    m = j.groupBy(*own).agg(*meats)
    table = sums.join(solved, own).join(m, own)
    return table.mapInPandas(lambda it: (_robust(b) for b in it), _RESULT)


# ---- ratio metrics -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Ratio:
    numerator: str
    numerator_prop: str = ""          # sum this number instead of counting events
    denominator_event: str = ""
    denominator_prop: str = ""        # count distinct values of this property (the analysis unit)


def _ratio_rows(df: DataFrame, flags, spec: Ratio, start, end) -> tuple[DataFrame, DataFrame]:
    first, who = _units(df, flags, start, end)
    d = between(df, start, end)
    num = v.num_strict(d, spec.numerator_prop) if spec.numerator_prop else F.lit(1.0)
    au = v.text(d, spec.denominator_prop) if spec.denominator_prop else F.lit(None).cast("string")
    ev = d.select("distinct_id", "timestamp", "name", num.alias("num"), F.when(au != "", au).alias("au"))
    keep = F.col("name").isin(*[n for n in (spec.numerator, spec.denominator_event) if n])
    if spec.denominator_prop:
        keep = keep | F.col("au").isNotNull()
    j = ev.where(keep).join(who, "distinct_id").join(first, ["flag", "unit"]).where(F.col("timestamp") >= F.col("exposed_at"))
    return first, j.withColumn("is_num", (F.col("name") == spec.numerator) & F.col("num").isNotNull())


def ratio_analysis_units(df: DataFrame, flags, spec: Ratio, start=None, end=None) -> DataFrame:
    """(flag, unit, variant, au, value): one row per analysis unit of each randomised unit."""
    first, j = _ratio_rows(df, flags, spec, start, end)
    if spec.denominator_prop:
        return j.where("au is not null").groupBy("flag", "unit", "variant", "au").agg(F.sum(F.when(F.col("is_num"), F.col("num")).otherwise(0.0)).alias("value"))
    g = j.where("is_num").groupBy("flag", "unit").agg(F.sum("num").alias("value"))
    return first.join(g, ["flag", "unit"], "left").select("flag", "unit", "variant", F.lit("").alias("au"), F.coalesce("value", F.lit(0.0)).alias("value"))


def ratio_units(df: DataFrame, flags, spec: Ratio, start=None, end=None, values: DataFrame | None = None) -> DataFrame:
    """(flag, unit, variant, num, den) per randomised unit."""
    first, j = _ratio_rows(df, flags, spec, start, end)
    if spec.denominator_event and not spec.denominator_prop:
        g = j.groupBy("flag", "unit").agg(F.sum(F.when(F.col("is_num"), F.col("num")).otherwise(0.0)).alias("num"),
                                          F.count(F.when(F.col("name") == spec.denominator_event, 1)).cast("double").alias("den"))
    else:
        vals = values if values is not None else ratio_analysis_units(df, flags, spec, start, end)
        g = vals.groupBy("flag", "unit").agg(F.sum("value").alias("num"), F.count("*").cast("double").alias("den"))
    z = F.lit(0.0)
    return first.join(g, ["flag", "unit"], "left").select("flag", "unit", "variant", F.coalesce("num", z).alias("num"), F.coalesce("den", z).alias("den"))


def ratio_unattributed(df: DataFrame, flags, spec: Ratio, start=None, end=None) -> DataFrame:
    """(flag, unattributed): numerator events that belong to no analysis unit; any at all refuses the metric."""
    _, j = _ratio_rows(df, flags, spec, start, end)
    lost = F.col("is_num") & F.col("au").isNull() if spec.denominator_prop else F.lit(False)
    return j.groupBy("flag").agg(F.count(F.when(lost, 1)).alias("unattributed"))


def winsor_bounds(values: DataFrame, lo_pct: float = 1, hi_pct: float = 99) -> DataFrame:
    """(flag, lo, hi): linear-interpolated percentiles over every arm's values."""
    return exact_quantiles(values, ["flag"], "value", {"lo": ("linear", lo_pct / 100), "hi": ("linear", hi_pct / 100)}).drop("n")


def winsorize(values: DataFrame, lo_pct: float = 1, hi_pct: float = 99) -> DataFrame:
    b = winsor_bounds(values, lo_pct, hi_pct)
    j = values.join(b, "flag")
    capped = F.when(F.col("hi") > F.col("lo"), F.least("hi", F.greatest("lo", "value"))).otherwise(F.col("value"))
    return j.withColumn("value", capped).drop("lo", "hi")


def ratio_metric(units: DataFrame, flags, values: DataFrame | None = None) -> DataFrame:
    """Delta-method ratio per arm, cluster and naive errors beside it, relative interval against control."""
    s, n = F.col("num"), F.col("den")
    a = units.groupBy("flag", "variant").agg(F.count("*").alias("units"), F.sum(s).alias("s"), F.sum(n).alias("d"), F.var_samp(s).alias("vs"),
                                             F.var_samp(n).alias("vn"), F.covar_samp(s, n).alias("cv"), F.sum(s * s).alias("ss"), F.sum(s * n).alias("sn"), F.sum(n * n).alias("nn"))
    if values is not None:
        nv = values.groupBy("flag", "variant").agg(F.var_samp("value").alias("_v"), F.count("*").alias("_n"))
        a = a.join(nv, ["flag", "variant"], "left")
    else:
        a = a.withColumn("_v", F.lit(None).cast("double")).withColumn("_n", F.lit(None).cast("bigint"))
    k, ok = F.col("units"), (F.col("units") >= 2) & (F.col("d") > 0)
    th, mu = F.col("s") / F.col("d"), F.col("d") / F.col("units")
    a = a.where(ok).withColumn("ratio", th).withColumn("mu", mu)
    r = F.col("ratio")
    delta = F.greatest(F.lit(0.0), (F.col("vs") - 2 * r * F.col("cv") + r * r * F.col("vn")) / (k * F.col("mu") ** 2))
    sse = F.greatest(F.lit(0.0), F.col("ss") - 2 * r * F.col("sn") + r * r * F.col("nn"))
    a = a.withColumn("se", F.sqrt(delta)).withColumn("se_cluster", F.sqrt(sse / ((k - 1) * k * F.col("mu") ** 2)))
    a = a.withColumn("se_naive", F.when(F.col("_n") >= 2, F.sqrt(F.col("_v") / F.col("_n"))))
    ctl = units.sparkSession.createDataFrame([(f.key, f.arms[0][0]) for f in flags], "flag string, control string")
    a = a.join(ctl, "flag")
    c = a.where("variant = control").select("flag", F.col("ratio").alias("_cr"), F.col("se").alias("_cs"))
    j = a.join(c, "flag", "left")
    test = F.col("variant") != F.col("control")
    fine = test & (F.col("_cr") > 0) & ~((F.col("_cs") > 0) & (F.col("_cr") < 10 * F.col("_cs"))) & (r > 0)
    lp = F.log(r / F.col("_cr"))
    ls = F.sqrt((F.col("se") / r) ** 2 + (F.col("_cs") / F.col("_cr")) ** 2)
    pct = lambda e: F.when(fine, stats.round_to((F.exp(e) - 1) * 100, 1))
    z = F.when(fine & (ls > 0), F.abs(lp) / ls)
    rd = lambda e, nme: F.round(e, 6).alias(nme)
    return j.select("flag", "variant", "units", rd(F.col("s"), "num"), rd(F.col("d"), "den"), rd(r, "ratio"), rd(F.col("se"), "se"), rd(F.col("se_cluster"), "se_cluster"),
                    rd(F.col("se_naive"), "se_naive"), pct(lp).alias("delta_pct"), pct(lp - stats.Z95 * ls).alias("delta_lo"), pct(lp + stats.Z95 * ls).alias("delta_hi"), rd(z, "z"))


def ratio_p(metric: DataFrame) -> DataFrame:
    return metric.withColumn("p", F.when(F.col("z").isNotNull(), F.round(stats.normal_two_sided(F.coalesce("z", F.lit(0.0))), 4)))


# ---- power -------------------------------------------------------------------------------------
# fixed values: planning defaults, search limits and the heavy-tail rule
POWER, MIN_RUN_DAYS, MAX_SKEW, SKEW_FACTOR, MDE_LO, MDE_HI = 0.8, 14, 5.0, 355.0, 1e-6, 10.0


def power_baseline(df: DataFrame, goal: str, start: str, end: str, by: Column | None = None, value_prop: str = "") -> DataFrame:
    """Units, converters, rate, median daily units (empty days included) and value skewness, per group."""
    import datetime as dt
    days = max(1, -(-int((dt.datetime.fromisoformat(end) - dt.datetime.fromisoformat(start)).total_seconds()) // 86400))
    d = between(df, start, end)
    val = F.coalesce(v.num_strict(d, value_prop), F.lit(0.0)) if value_prop else F.lit(0.0)
    d = d.select("distinct_id", F.to_date("timestamp").alias("_d"), (F.col("name") == goal).alias("_g"), val.alias("_v"), (by if by is not None else F.lit("all")).alias("segment"))
    per_ud = d.groupBy("segment", "distinct_id", "_d").agg(F.max(F.col("_g").cast("int")).alias("_g"), F.sum(F.when(F.col("_g"), F.col("_v")).otherwise(0.0)).alias("_v"))
    u = per_ud.groupBy("segment", "distinct_id").agg(F.max("_g").alias("c"), F.sum("_v").alias("x"))
    b = u.groupBy("segment").agg(F.count("*").alias("units"), F.sum("c").alias("converters"), F.skewness("x").alias("skew"))
    daily = per_ud.groupBy("segment", "_d").agg(F.count("*").alias("n")).groupBy("segment").agg(F.collect_list("n").alias("n"))   # one entry per day
    padded = F.array_sort(F.concat("n", F.array_repeat(F.lit(0).cast("bigint"), F.lit(days) - F.size("n"))))
    mid = (F.element_at(padded, days // 2 + 1) + F.element_at(padded, (days + 1) // 2)) / 2
    j = b.join(daily.select("segment", mid.alias("daily_units")), "segment")
    skew = F.round(F.coalesce(F.when(F.isnan("skew"), 0.0).otherwise(F.col("skew")), F.lit(0.0)), 4) if value_prop else F.lit(0.0)
    return j.select("segment", F.lit(days).cast("bigint").alias("days"), "units", "converters", F.round(F.col("converters") / F.col("units"), 6).alias("rate"),
                    "daily_units", skew.alias("skewness"), (F.abs(skew) > MAX_SKEW).alias("heavy_tail"))


def power_plan(designs: DataFrame, alpha: float = 0.05, power: float = POWER, weights=(1, 1)) -> DataFrame:
    """designs(…, baseline, mde_pct, daily_units) → required units per arm, total and days.

    The first weight is control; the design is powered on the smallest other arm.
    """
    total, test = float(sum(weights)), float(min(weights[1:]))
    cf, ratio = weights[0] / total, test / weights[0]
    z = stats.z_at(1 - alpha / 2) + stats.z_at(power)
    pa = F.col("baseline")
    pb = pa * (1 + F.col("mde_pct") / 100)
    d = designs.where((pa > 0) & (pa < 1) & (pb < 1)).withColumn("target", pb)
    nc = F.lit(z * z) * (pa * (1 - pa) + F.col("target") * (1 - F.col("target")) / ratio) / ((F.col("target") - pa) ** 2)
    d = d.withColumn("_total", nc / cf)
    parts = [F.ceil(F.col("_total") * (w / total)) for w in weights]
    d = d.withColumn("n_control", parts[0]).withColumn("n_planned", sum(parts[1:], parts[0]))
    days = F.when(F.col("daily_units") > 0, F.ceil(F.col("n_planned") / F.col("daily_units"))).otherwise(F.lit(0))
    return d.withColumn("duration_days", days).withColumn("recommended_days", F.greatest(days, F.lit(MIN_RUN_DAYS))).drop("_total")


def _search(alpha: float, power: float, weights, n_tune: float | None):
    total, test = float(sum(weights)), float(min(weights[1:]))
    cf, ratio = weights[0] / total, test / weights[0]
    zp, zz = stats.z_at(power), stats.z_at(1 - alpha / 2) + stats.z_at(power)
    widen, mde_lo, mde_hi = stats.width_factor, MDE_LO, MDE_HI

    def sequential_n(pa: float, pb: float, n_ctrl: int, planned: int) -> int:
        tune = n_tune or planned
        def ok(n: int) -> bool:
            se = (pa * (1 - pa) / n + pb * (1 - pb) / (ratio * n)) ** 0.5
            return (widen(n * (1 + ratio), alpha, tune) + zp) * se <= pb - pa
        hi = n_ctrl
        while not ok(hi) and hi < 2 ** 62:
            hi *= 2
        lo = 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
        return int(np.ceil(lo / cf))

    def mde(pa: float, n: float) -> float | None:
        need = lambda r: zz * zz * (pa * (1 - pa) + pa * (1 + r) * (1 - pa * (1 + r)) / ratio) / (pa * r) ** 2 / cf
        hi, lo = min(mde_hi, (1 - 1e-9) / pa - 1), mde_lo
        if hi <= lo or need(hi) > n:
            return None
        if need(lo) < n:
            return 100 * lo
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if need(mid) > n else (lo, mid)
        return 100 * (lo + hi) / 2

    return sequential_n, mde


def power_search(plan: DataFrame, alpha: float = 0.05, power: float = POWER, weights=(1, 1), n_tune: float | None = None) -> DataFrame:
    """Adds the always-valid sample size, and the smallest lift the baseline's own units could detect."""
    seq, mde = _search(alpha, power, weights, n_tune)

    def run(it):
        for b in it:
            b["n_sequential"] = [seq(r.baseline, r.target, int(r.n_control), int(r.n_planned)) for r in b.itertuples()]
            b["mde_for_units_pct"] = [mde(r.baseline, r.units) if r.units > 0 else None for r in b.itertuples()]
            yield b
    schema = plan.schema.simpleString()[7:-1].replace(":", " ") + ",n_sequential bigint,mde_for_units_pct double"
    return plan.mapInPandas(run, schema)
