"""Flag assignment, exposure, measurement and the tests on the scorecard, for many flags at once."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import stats, values as v
from eventloom.model import between
from eventloom.operators import filters as flt

EXPOSURE, P_FLAG, P_VARIANT, P_BUCKET = "$feature_flag_called", "$feature_flag", "$feature_flag_response", "$bucket_id"
# fixed values: minimum arm size, SRM level, minimum expected per arm, default tuning size and guardrail margin
MIN_ARM, SRM_ALPHA, MIN_EXPECTED, N_TUNE, GUARDRAIL_MARGIN = 30, 0.001, 5, 5000, 10.0


@dataclass(frozen=True)
class Rule:
    filters: tuple = ()
    rollout_pct: int = 100


@dataclass(frozen=True)
class Guardrail:
    event: str
    direction: str = "not_worse"       # or not_better
    margin_pct: float = GUARDRAIL_MARGIN
    margin_pp: float = 0.0


@dataclass(frozen=True)
class Flag:
    key: str
    arms: tuple = ()                   # (variant, weight), control first
    goal: str = ""
    enabled: bool = True
    rules: tuple = ()
    holdout: str = ""
    holdout_pct: float = 0.0
    layer: str = ""
    slice: tuple = (0.0, 0.0)
    started: str = ""
    stopped: str = ""
    alpha: float = 0.05
    mode: str = "sequential"
    n_planned: int = 0
    guardrails: tuple = ()


# ---- assignment --------------------------------------------------------------------------------
def bucket(salt: str, unit: Column) -> Column:
    """Position in [0, 1): the top 60 bits of SHA-256(salt:unit)."""
    h = F.sha2(F.concat(F.lit(salt + ":"), unit), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint").cast("double") / float(1 << 60)


def variant_of(flag: Flag, unit: Column) -> Column:
    total = sum(w for _, w in flag.arms if w > 0)
    if total <= 0:
        return F.lit("on")
    r, cum, out = bucket(f"variant:{flag.key}", unit), 0, None
    for key, w in flag.arms:
        if w > 0:
            cum += w
            out = (F.when if out is None else out.when)(r < cum / total, F.lit(key))
    return out.otherwise(F.lit(flag.arms[-1][0]))


def _served(users: DataFrame, flag: Flag, unit: Column) -> Column:
    """The served variant, or '' when off."""
    off, serve = F.lit(""), variant_of(flag, unit)
    if not flag.enabled:
        return off
    chain = serve if not flag.rules else off
    for r in reversed(flag.rules):      # a filter miss moves on; a rollout miss stops
        hit = flt.matches(users, r.filters)
        inside = F.lit(r.rollout_pct >= 100) | (bucket(f"rollout:{flag.key}", unit) < r.rollout_pct / 100)
        chain = F.when(hit, F.when(F.lit(r.rollout_pct > 0) & inside, serve).otherwise(off)).otherwise(chain)
    gate = F.lit(True)
    if flag.holdout and flag.holdout_pct > 0:
        gate = gate & (F.lit(flag.holdout_pct < 100) & ~(bucket(f"holdout:{flag.holdout}", unit) < flag.holdout_pct / 100))
    if flag.layer and tuple(flag.slice) != (0.0, 0.0):
        p = bucket(f"layer:{flag.layer}", unit)
        gate = gate & (p >= flag.slice[0]) & (p < flag.slice[1])
    return F.when(gate, chain).otherwise(off)


def assign(users: DataFrame, flags, unit: str = "distinct_id") -> DataFrame:
    """(distinct_id, flag, variant, on) for every user and flag, from one pass over the users."""
    cells = [F.struct(F.lit(f.key).alias("flag"), _served(users, f, F.col(unit)).alias("variant")) for f in flags]
    d = users.select(unit, F.explode(F.array(*cells)).alias("a")).select(unit, "a.*")
    return d.withColumn("on", F.col("variant") != "")


def layer_overlaps(claims: DataFrame) -> DataFrame:
    """claims(layer, key, start, end) → neighbouring claims that overlap.

    Claims of one layer are compared in start order, each with the one before it.
    """
    w = W.partitionBy("layer").orderBy("start", "key")
    d = claims.where("not (start = 0 and end = 0)")
    d = d.withColumn("prev_key", F.lag("key").over(w)).withColumn("prev_end", F.lag("end").over(w))
    return d.where("start < prev_end").select("layer", "prev_key", "key", "start", F.least("end", "prev_end").alias("overlap_end"))


# ---- exposure and measurement ------------------------------------------------------------------
def exposed_people(df: DataFrame, flags, start=None, end=None, extra=()) -> DataFrame:
    """(flag, distinct_id, bucket, first, last, n): one row per person and bucket id.

    The only pass over the exposure events; everything about units is derived from this table.
    """
    d = between(df.where(F.col("name") == EXPOSURE), start, end)
    d = d.select("id", "timestamp", "distinct_id", v.text(d, P_FLAG).alias("flag"), F.coalesce(v.text(d, P_VARIANT), F.lit("")).alias("variant"),
                 F.when(v.text(d, P_BUCKET) != "", v.text(d, P_BUCKET)).alias("bucket"), *[v.text(d, p).alias(p) for p in extra])
    d = d.where(F.col("flag").isin(*[f.key for f in flags]))
    return d.groupBy("flag", "distinct_id", "bucket").agg(F.min(F.struct("timestamp", "id", "variant", *extra)).alias("first"),
                                                          F.max(F.struct("timestamp", "id")).alias("last"), F.count("*").alias("n"))


def unit_map(people: DataFrame, latest: bool = True) -> DataFrame:
    """(flag, distinct_id, unit): the bucket id of the person's exposures, else the distinct id."""
    has = F.col("bucket").isNotNull()
    pick = (F.max(F.when(has, F.struct("last", "bucket"))) if latest else F.min(F.when(has, F.struct("first.timestamp", "bucket"))))["bucket"]
    return people.groupBy("flag", "distinct_id").agg(F.coalesce(pick, F.col("distinct_id")).alias("unit"))


def exposure(df: DataFrame, flags, start=None, end=None, extra=(), people: DataFrame | None = None) -> DataFrame:
    """(flag, unit, variant, exposed_at, unit_kind): each unit's first exposure."""
    p = people if people is not None else exposed_people(df, flags, start, end, extra)
    kind = p.groupBy("flag").agg(F.when(F.count("bucket") > 0, "bucket_id").otherwise("distinct_id").alias("unit_kind"))
    first = p.join(unit_map(p), ["flag", "distinct_id"]).groupBy("flag", "unit").agg(F.min("first").alias("f"))
    return first.join(kind, "flag").select("flag", "unit", "f.variant", F.col("f.timestamp").alias("exposed_at"), "unit_kind", *[f"f.{x}" for x in extra])


def _arms(spark, flags) -> DataFrame:
    rows = [(f.key, k, i, float(w), f.arms[0][0]) for f in flags for i, (k, w) in enumerate(f.arms)]
    return spark.createDataFrame(rows, "flag string, variant string, idx int, weight double, control string")


def measure(df: DataFrame, flags, goals=None, start=None, end=None) -> DataFrame:
    """(flag, goal, variant, idx, control, exposed, converted): declared arms first, dead arms as zeros.

    A unit converts when its last goal event is at or after its first exposure.
    """
    spark = df.sparkSession
    pairs = spark.createDataFrame(goals or [(f.key, f.goal) for f in flags], "flag string, goal string")
    people = exposed_people(df, flags, start, end)
    who, first = unit_map(people), exposure(df, flags, people=people)
    done = between(df, start, end).select("name", "distinct_id", "timestamp", v.text(df, P_BUCKET).alias("b"))
    done = done.join(pairs.select("goal").distinct(), F.col("name") == F.col("goal"), "left_semi")
    done = done.groupBy("name", "distinct_id", "b").agg(F.max("timestamp").alias("last"))      # shrink before joining
    g = done.join(pairs, F.col("name") == F.col("goal")).join(who, ["flag", "distinct_id"], "left")
    unit = F.coalesce("unit", F.when(F.col("b") != "", F.col("b")), "distinct_id")
    g = g.select("flag", "goal", unit.alias("unit"), "last").groupBy("flag", "goal", "unit").agg(F.max("last").alias("last"))
    t = first.join(pairs, "flag").join(g, ["flag", "goal", "unit"], "left").groupBy("flag", "goal", "variant").agg(
        F.count("*").alias("exposed"), F.count(F.when(F.col("last") >= F.col("exposed_at"), 1)).alias("converted"))
    arms = _arms(spark, flags)
    declared = arms.join(pairs, "flag").select("flag", "goal", "variant", "idx")
    out = declared.join(t, ["flag", "goal", "variant"], "full")
    ctl = arms.select("flag", "control").distinct()
    z = F.lit(0).cast("bigint")
    return out.join(ctl, "flag").select("flag", "goal", "variant", F.coalesce("idx", F.lit(999)).alias("idx"), "control",
                                        F.coalesce("exposed", z).alias("exposed"), F.coalesce("converted", z).alias("converted"))


def rates(card: DataFrame) -> DataFrame:
    lo, hi = stats.wilson(F.col("converted"), F.col("exposed"), stats.Z95)
    rate = F.when(F.col("exposed") > 0, stats.round_to(F.col("converted") * 100 / F.col("exposed"), 1)).otherwise(F.lit(0.0))
    return card.select("flag", "goal", "variant", (F.col("variant") == F.col("control")).alias("is_control"), "exposed", "converted",
                       rate.alias("rate_pct"), lo.alias("ci_lo"), hi.alias("ci_hi"), (F.col("exposed") < MIN_ARM).alias("small_sample"))


def versus_control(card: DataFrame) -> DataFrame:
    """Test arms beside their control: (flag, goal, variant, ct, nt, cc, nc)."""
    c = card.where(F.col("variant") == F.col("control")).select("flag", "goal", F.col("converted").alias("cc"), F.col("exposed").alias("nc"))
    t = card.where(F.col("variant") != F.col("control")).select("flag", "goal", "variant", F.col("converted").alias("ct"), F.col("exposed").alias("nt"))
    return t.join(c, ["flag", "goal"])




def _four():
    return [F.col(x) for x in ("ct", "nt", "cc", "nc")]


def lift_intervals(pairs: DataFrame, z=stats.Z95) -> DataFrame:
    why = stats.lift_reason(*_four())
    lo, pt, hi = (F.when(F.col("reason") == "ok", x) for x in stats.lift(*_four(), z))
    return pairs.withColumn("reason", why).withColumns({"lift_lo": lo, "lift_pct": pt, "lift_hi": hi})


def diff_intervals(pairs: DataFrame, z=stats.Z95) -> DataFrame:
    ok = (F.col("nt") > 0) & (F.col("nc") > 0)
    lo, pt, hi = (F.when(ok, x) for x in stats.diff(*_four(), z))
    return pairs.withColumns({"diff_lo": lo, "diff_pp": pt, "diff_hi": hi})


def two_proportion(pairs: DataFrame) -> DataFrame:
    z = stats.pooled_z(*_four())
    return pairs.withColumn("z", F.round(z, 6)).withColumn("p", F.round(F.coalesce(stats.normal_two_sided(F.coalesce(z, F.lit(0.0))), F.lit(1.0)), 6))


def sequential(pairs: DataFrame, alpha: float = 0.05, n_planned: int = 0, mode: str = "sequential") -> DataFrame:
    """Always-valid interval on the difference in rates; a fixed-horizon test read early falls back to it."""
    z = stats.z_crit(alpha)
    p1, p2 = F.col("ct") / F.col("nt"), F.col("cc") / F.col("nc")
    d = pairs.where("nt > 0 and nc > 0").withColumn("diff", p1 - p2).withColumn("n", F.col("nt") + F.col("nc"))
    d = d.withColumn("se", F.sqrt(p1 * (1 - p1) / F.col("nt") + p2 * (1 - p2) / F.col("nc")))
    tune = F.lit(float(n_planned or N_TUNE))
    seq = F.lit(mode != "fixed") | F.lit(n_planned <= 0) | (F.col("n") < n_planned)
    k = F.when(seq, stats.width_factor_col(F.col("n"), alpha, tune) / F.lit(z)).otherwise(F.lit(1.0))
    d = d.withColumn("mode", F.when(seq, "sequential").otherwise("fixed")).withColumn("usable", F.col("se") > 0)
    d = d.withColumn("_k", F.when(F.col("usable"), k).otherwise(F.lit(1.0)))
    half = F.when(F.col("usable"), F.col("_k") * z * F.col("se")).otherwise(F.lit(0.0))
    lo, hi = F.col("diff") - half, F.col("diff") + half
    d = d.withColumn("excludes_zero", F.col("usable") & ((lo > 0) | (hi < 0)))
    return d.withColumns({"k": F.round("_k", 6), "half_width": F.round(half, 6), "lo": F.round(lo, 6), "hi": F.round(hi, 6)}).withColumn("_tune", tune)


def sequential_p(seq: DataFrame) -> DataFrame:
    return seq.withColumn("always_valid_p", F.round(stats.always_valid_p("diff", "se", F.col("n").cast("double"), "_tune"), 6))


# ---- guardrails --------------------------------------------------------------------------------
def guardrails(df: DataFrame, flags, start=None, end=None) -> DataFrame:
    """PASS / FAIL / INCONCLUSIVE per flag, guardrail and arm, one-sided, always-valid by default."""
    rules = [(f.key, g.event, g.direction, float(g.margin_pct), float(g.margin_pp), float(f.alpha), f.mode, float(f.n_planned or N_TUNE)) for f in flags for g in f.guardrails]
    card = measure(df, flags, sorted({(r[0], r[1]) for r in rules}), start, end)
    r = df.sparkSession.createDataFrame(rules, "flag string, goal string, direction string, margin_pct double, margin_pp double, alpha double, mode string, n_tune double")
    alphas = sorted({x[5] for x in rules})
    p = versus_control(card).join(r, ["flag", "goal"])
    n = F.col("nt") + F.col("nc")
    z = None
    for a in alphas:     # one branch per distinct level
        k = F.when(F.col("mode") == "fixed", F.lit(1.0)).otherwise(stats.width_factor_col(n, a, F.col("n_tune")) / stats.z_crit(a))
        z = (F.when if z is None else z.when)(F.col("alpha") == a, k * stats.z_at(1 - a))
    p = p.withColumn("_z", z).withColumn("_why", stats.lift_reason(*_four()))
    use_pp = (F.col("_why") == "control_near_zero") & (F.col("margin_pp") > 0)
    rl, _, rh = stats.lift(*_four(), F.col("_z"))
    dl, _, dh = stats.diff(*_four(), F.col("_z"))
    small = (F.col("nt") < MIN_ARM) | (F.col("nc") < MIN_ARM)
    usable = ~small & ((F.col("_why") == "ok") | use_pp)
    p = p.withColumn("absolute", use_pp & ~small).withColumn("lo", F.when(usable, F.when(use_pp, dl).otherwise(rl))).withColumn(
        "hi", F.when(usable, F.when(use_pp, dh).otherwise(rh)))
    margin = F.when(F.col("absolute"), F.col("margin_pp")).otherwise(F.col("margin_pct"))
    worse = F.col("direction") == "not_worse"
    th = F.when(worse, -margin).otherwise(margin)
    ok = F.when(worse, F.col("lo") > th).otherwise(F.col("hi") < th)
    bad = F.when(worse, F.col("hi") < th).otherwise(F.col("lo") > th)
    status = F.when(F.coalesce(ok, F.lit(False)), "PASS").when(F.coalesce(bad, F.lit(False)), "FAIL").otherwise("INCONCLUSIVE")
    return p.select("flag", F.col("goal").alias("event"), "variant", "ct", "nt", "cc", "nc", th.alias("threshold"), "lo", "hi", "absolute", status.alias("status"))


def confirmed_breaches(checks: DataFrame, warmup_s: int = 900, gap_s: int = 300) -> DataFrame:
    """checks(flag, event, variant, started, at, status) → the second FAIL in a row, far enough apart, after warm-up."""
    w = W.partitionBy("flag", "event", "variant").orderBy("at")
    d = checks.withColumn("_s", F.lag("status").over(w)).withColumn("_a", F.lag("at").over(w))
    sec = F.unix_seconds
    return d.where((F.col("status") == "FAIL") & (F.col("_s") == "FAIL") & (sec("at") - sec("_a") >= gap_s) & (sec("at") - sec("started") >= warmup_s)).select(
        "flag", "event", "variant", "at")


# ---- sample ratio ------------------------------------------------------------------------------
SRM_DIMS = ("device", "platform", "os", "browser", "country", "sdk", "$lib")


def _weighted(spark, flags) -> DataFrame:
    rows = [(f.key, k, w / sum(x for _, x in f.arms if x > 0)) for f in flags for k, w in f.arms if w > 0]
    return spark.createDataFrame(rows, "flag string, variant string, share double")


def _chi(obs: DataFrame, keys: list[str], arms: DataFrame) -> DataFrame:
    """χ² per key over the weighted arms; arms nobody saw count as zero."""
    seen = obs.groupBy(*keys).agg(F.sum("n").alias("total"))
    d = seen.join(arms, "flag").join(obs, [*keys, "variant"], "left")
    e = F.col("total") * F.col("share")
    o = F.coalesce("n", F.lit(0))
    return d.groupBy(*keys).agg(F.max("total").alias("total"), F.sum((o - e) * (o - e) / e).alias("chi"), (F.count("*") - 1).alias("df"), F.min(e).alias("min_expected"))


def srm_counts(df: DataFrame, flags, start=None, end=None) -> DataFrame:
    arms = _weighted(df.sparkSession, flags)
    first = _first_by_person(df, flags, start, end)
    obs = first.join(arms.select("flag", "variant"), ["flag", "variant"], "left_semi").groupBy("flag", "variant").agg(F.count("*").alias("n"))
    c = _chi(obs, ["flag"], arms).where("df >= 1")
    return c.withColumn("checked", F.col("min_expected") >= MIN_EXPECTED).withColumn("chi_square", F.round("chi", 3))


def srm(df: DataFrame, flags, start=None, end=None) -> DataFrame:
    c = srm_counts(df, flags, start, end)
    p = stats.chi_square_p(F.col("chi"), F.col("df"))
    c = c.withColumn("p", F.when(F.col("checked"), F.round(p, 6)))
    return c.select("flag", "total", "df", "checked", "chi_square", "p", F.coalesce(F.col("p") < SRM_ALPHA, F.lit(False)).alias("detected"))


def _first_by_person(df: DataFrame, flags, start, end, extra=()) -> DataFrame:
    p = exposed_people(df, flags, start, end, extra)
    f = p.groupBy("flag", "distinct_id").agg(F.min("first").alias("f"))
    return f.select("flag", "distinct_id", "f.variant", *[f"f.{p}" for p in extra])


def srm_worst_segment(df: DataFrame, flags, start=None, end=None, min_segment: int = 30, floor: float = 10.83) -> DataFrame:
    """Per flag: the segment whose split is furthest from the configured one, if it is really skewed."""
    arms = _weighted(df.sparkSession, flags)
    first = _first_by_person(df, flags, start, end, SRM_DIMS).join(arms.select("flag", "variant"), ["flag", "variant"], "left_semi")
    cells = F.array(*[F.struct(F.lit(p).alias("prop"), F.col(f"`{p}`").alias("value")) for p in SRM_DIMS])
    seg = first.select("flag", "variant", F.explode(cells).alias("s")).select("flag", "variant", "s.*").where("value <> ''")
    obs = seg.groupBy("flag", "prop", "value", "variant").agg(F.count("*").alias("n"))
    c = _chi(obs, ["flag", "prop", "value"], arms).where((F.col("total") >= min_segment) & (F.col("chi") >= floor))
    best = c.groupBy("flag").agg(F.min(F.struct((-F.col("chi")).alias("c"), "prop", "value", "total", "chi")).alias("b"))
    return best.select("flag", "b.prop", "b.value", F.col("b.total").alias("n"), F.round("b.chi", 3).alias("chi_square"))


# ---- many hypotheses ---------------------------------------------------------------------------
def benjamini_hochberg(tests: DataFrame, q: float = 0.05) -> DataFrame:
    """tests(experiment, variant, metric, p) → rank, adjusted p and rejections within each experiment."""
    up = W.partitionBy("experiment").orderBy("p", "variant", "metric")
    all_ = W.partitionBy("experiment")
    d = tests.withColumn("rank", F.row_number().over(up).cast("bigint")).withColumn("m", F.count("*").over(all_))
    d = d.withColumn("_raw", F.least(F.lit(1.0), F.col("m") / F.col("rank") * F.col("p")))
    d = d.withColumn("p_adjusted", F.min("_raw").over(W.partitionBy("experiment").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_k", F.max(F.when(F.col("p") <= F.col("rank") / F.col("m") * q, F.col("rank")).otherwise(0)).over(all_))
    return d.select("experiment", "variant", "metric", "p", "rank", F.round("p_adjusted", 6).alias("p_adjusted"), (F.col("rank") <= F.col("_k")).alias("rejected"))


def dead_experiments(df: DataFrame, flags, asof: str, min_people: int = 20, min_days: int = 14) -> DataFrame:
    """Experiments running two weeks or more where every arm is readable and none is significant."""
    import datetime as dt
    now = dt.datetime.fromisoformat(asof)
    live = [f for f in flags if f.goal and f.started and not f.stopped and (now - dt.datetime.fromisoformat(f.started)).days >= min_days]
    if not live:
        return df.sparkSession.createDataFrame([], "flag string, goal string, exposed bigint, best_delta_pct double")
    parts = []
    for start in sorted({f.started for f in live}):
        group = [f for f in live if f.started == start]
        pairs = versus_control(measure(df, group, None, start, asof))
        parts.append(sequential_p(sequential(pairs)))
    s = reduce(lambda a, b: a.unionByName(b), parts)
    alpha = F.element_at(F.create_map(*[x for f in live for x in (F.lit(f.key), F.lit(f.alpha))]), F.col("flag"))
    sig = (F.col("always_valid_p") < alpha) & (F.col("nt") >= MIN_ARM) & (F.col("nc") >= MIN_ARM)
    flat = ~sig & (F.col("nt") >= MIN_ARM) & (F.col("cc") > 0)
    delta = stats.round_to((F.col("ct") / F.col("nt") / (F.col("cc") / F.col("nc")) - 1) * 100, 1)
    g = s.groupBy("flag", "goal").agg((F.sum("nt") + F.max("nc")).alias("exposed"), F.min(flat.cast("int")).alias("_flat"), F.max(delta).alias("best_delta_pct"))
    return g.where((F.col("_flat") == 1) & (F.col("exposed") >= min_people)).drop("_flat")
