from pyspark.sql import functions as F

from eventloom.functions import stats
from eventloom.operators import experiment_units as eu, experiments as ex
from eventloom.operators.filters import Filter
from eventloom.plans.inputs import ASOF
from eventloom.plans.registry import plan
from eventloom.session import materialize

S = "2024-01-12 00:00:00"
F1 = ex.Flag("f1", (("control", 1), ("test", 1)), "upgrade", started=S, guardrails=(
    ex.Guardrail("error", "not_better", 10.0), ex.Guardrail("signup", "not_worse", 25.0), ex.Guardrail("rare", "not_better", 10.0, 5.0)))
F2 = ex.Flag("f2", (("control", 1), ("a", 1), ("b", 2), ("ghost", 0)), "upgrade", started=S)
F3 = ex.Flag("f3", (("control", 1), ("test", 1)), "rare", started=S)
FLAGS = [F1, F2, F3]


def B(salt, unit):
    return f"(CAST(CAST('0x'||substr(sha256('{salt}:'||{unit}),1,15) AS BIGINT) AS DOUBLE)/1152921504606846976)"


# Views from the 12th on are exposures of three flags; f2 buckets on a device id shared by two people, f3 is skewed in the US.
XP = f"""WITH x AS (SELECT id, us, ts, distinct_id, 'f1' AS flag, NULL AS bkt, device, browser, country, CASE WHEN {B('variant:f1', 'distinct_id')}<0.5 THEN 'control' ELSE 'test' END AS variant FROM pev WHERE name='view' AND ts>=TIMESTAMP '2024-01-12'
  UNION ALL SELECT id, us, ts, distinct_id, 'f2', 'b'||(uid//2), device, browser, country, CASE WHEN {B('variant:f2', "'b'||(uid//2)")}<0.25 THEN 'control' WHEN {B('variant:f2', "'b'||(uid//2)")}<0.5 THEN 'a' ELSE 'b' END FROM pev WHERE name='view' AND ts>=TIMESTAMP '2024-01-12'
  UNION ALL SELECT id, us, ts, distinct_id, 'f3', NULL, device, browser, country, CASE WHEN {B('variant:f3', 'distinct_id')}<CASE WHEN country='US' THEN 0.97 ELSE 0.5 END THEN 'control' ELSE 'test' END FROM pev WHERE name='view' AND ts>=TIMESTAMP '2024-01-12'),
 g AS (SELECT *, CASE WHEN name='purchase' AND k<5 THEN 'upgrade' WHEN name='purchase' AND k=99 THEN 'rare' WHEN name='error' AND k>=60 THEN 'crash' ELSE name END AS nm FROM pev WHERE name<>'view'),
 fe AS (SELECT flag, coalesce(bkt,distinct_id) AS unit, arg_min(variant,us) AS variant, min(us) AS xus FROM x GROUP BY 1,2),
 um AS (SELECT DISTINCT flag, distinct_id, coalesce(bkt,distinct_id) AS unit FROM x)"""
CARD = XP + """, goals AS (SELECT * FROM (VALUES ('f1','upgrade'),('f2','upgrade'),('f3','rare')) t(flag,goal)),
 lg AS (SELECT flag, goal, unit, max(us) AS last FROM goals JOIN g ON g.nm=goal JOIN um USING (flag, distinct_id) GROUP BY 1,2,3),
 arms AS (SELECT * FROM (VALUES ('f1','control'),('f1','test'),('f2','control'),('f2','a'),('f2','b'),('f2','ghost'),('f3','control'),('f3','test')) t(flag,variant)),
 card AS (SELECT a.flag, goals.goal, a.variant, count(fe.unit) AS exposed, count(*) FILTER (WHERE last>=xus) AS converted FROM arms a JOIN goals USING (flag) LEFT JOIN fe ON fe.flag=a.flag AND fe.variant=a.variant
   LEFT JOIN lg ON lg.flag=fe.flag AND lg.unit=fe.unit AND lg.goal=goals.goal GROUP BY 1,2,3),
 pr AS (SELECT t.flag, t.goal, t.variant, t.converted AS ct, t.exposed AS nt, c.converted AS cc, c.exposed AS nc FROM card t JOIN card c ON c.flag=t.flag AND c.variant='control' WHERE t.variant<>'control') """


def events(c):
    k, n = F.col("k"), F.col("name")
    goal = (F.when((n == "purchase") & (k < 5), "upgrade").when((n == "purchase") & (k == 99), "rare").when((n == "error") & (k >= 60), "crash").otherwise(n))
    base = c.prod.where(n != "view").select("id", goal.alias("name"), "distinct_id", "timestamp", "amount", "path", "device", "browser", "country",
                                            *[F.lit(None).cast("string").alias(p) for p in (ex.P_FLAG, ex.P_VARIANT, ex.P_BUCKET)])
    d = c.prod.where((n == "view") & (F.col("timestamp") >= S))
    dev = F.concat(F.lit("b"), F.floor(F.col("uid") / 2))
    skew = F.when(F.col("country") == "US", 0.97).otherwise(0.5)
    arms = F.array(F.struct(F.lit("f1").alias("f"), ex.variant_of(F1, F.col("distinct_id")).alias("v"), F.lit(None).cast("string").alias("b")),
                   F.struct(F.lit("f2").alias("f"), ex.variant_of(F2, dev).alias("v"), dev.alias("b")),
                   F.struct(F.lit("f3").alias("f"), F.when(ex.bucket("variant:f3", F.col("distinct_id")) < skew, "control").otherwise("test").alias("v"), F.lit(None).cast("string").alias("b")))
    x = d.withColumn("_a", F.explode(arms)).select("id", F.lit(ex.EXPOSURE).alias("name"), "distinct_id", "timestamp", "amount", "path", "device", "browser", "country",
                                                   F.col("_a.f").alias(ex.P_FLAG), F.col("_a.v").alias(ex.P_VARIANT), F.col("_a.b").alias(ex.P_BUCKET))
    return base.unionByName(x)


# ---- assignment ----------------------------------------------------------------------------------
TARGETED = [ex.Flag("t1", (("control", 1), ("x", 2)), rules=(ex.Rule((Filter("plan", "eq", "free"),), 30), ex.Rule((), 100)), holdout="h", holdout_pct=10),
            ex.Flag("t2", layer="l1", slice=(0.2, 0.7)), ex.Flag("t3", (("a", 1), ("b", 1)), enabled=False), ex.Flag("t4", (("a", 1), ("b", 1)), rules=(ex.Rule((Filter("device", "eq", "mobile"),), 50),))]


@plan("flag_assign", f"""WITH u AS (SELECT DISTINCT distinct_id, plan, device FROM pev),
 v AS (SELECT distinct_id, 't1' AS flag, CASE WHEN {B('holdout:h', 'distinct_id')}<0.1 THEN '' WHEN coalesce(plan='free',false) AND {B('rollout:t1', 'distinct_id')}>=0.3 THEN ''
   WHEN {B('variant:t1', 'distinct_id')}<1.0/3 THEN 'control' ELSE 'x' END AS variant FROM u
  UNION ALL SELECT distinct_id, 't2', CASE WHEN {B('layer:l1', 'distinct_id')}>=0.2 AND {B('layer:l1', 'distinct_id')}<0.7 THEN 'on' ELSE '' END FROM u
  UNION ALL SELECT distinct_id, 't3', '' FROM u
  UNION ALL SELECT distinct_id, 't4', CASE WHEN device='mobile' AND {B('rollout:t4', 'distinct_id')}<0.5 THEN CASE WHEN {B('variant:t4', 'distinct_id')}<0.5 THEN 'a' ELSE 'b' END ELSE '' END FROM u)
 SELECT *, variant<>'' AS "on" FROM v""")
def _(c):
    return ex.assign(c.prod.select("distinct_id", "plan", "device").distinct(), TARGETED)


@plan("layer_slices_check", """WITH s AS (SELECT p_brand AS layer, 'e'||p_partkey AS key, (p_partkey*37%1000)/1000.0 AS "start", (p_partkey*37%1000)/1000.0+p_size/2000.0 AS "end" FROM part),
 w AS (SELECT *, lag(key) OVER w AS prev_key, lag("end") OVER w AS prev_end FROM s WINDOW w AS (PARTITION BY layer ORDER BY "start", key))
 SELECT layer, prev_key, key, round(CAST("start" AS DOUBLE),6) AS "start", round(CAST(least("end",prev_end) AS DOUBLE),6) AS overlap_end FROM w WHERE "start"<prev_end""", base=None)
def _(c):
    st = F.col("p_partkey") * 37 % 1000
    p = c.table("part").select(F.col("p_brand").alias("layer"), F.concat(F.lit("e"), "p_partkey").alias("key"), (st / 1000).alias("start"), (st / 1000 + F.col("p_size") / 2000).alias("end"))
    return ex.layer_overlaps(p).withColumn("start", F.round("start", 6)).withColumn("overlap_end", F.round("overlap_end", 6))


# ---- exposure, measurement, intervals ---------------------------------------------------------------
@plan("experiment_exposure", XP + "SELECT flag, unit, variant, xus AS us, CASE flag WHEN 'f2' THEN 'bucket_id' ELSE 'distinct_id' END AS unit_kind FROM fe")
def _(c):
    return ex.exposure(events(c), FLAGS, S, ASOF).select("flag", "unit", "variant", F.unix_micros("exposed_at").alias("us"), "unit_kind")


@plan("asof_first_exposure", XP + """, l AS (SELECT flag, unit, max(us) AS last FROM g JOIN um USING (distinct_id) WHERE nm='upgrade' GROUP BY 1,2)
 SELECT flag, variant, count(*) AS units, count(*) FILTER (WHERE last>=xus) AS followed, count(*) FILTER (WHERE last<xus) AS before_only FROM fe LEFT JOIN l USING (flag, unit) WHERE flag<>'f2' GROUP BY 1,2""")
def _(c):
    e = events(c)
    first = ex.exposure(e, [F1, F3], S, ASOF)
    last = e.where("name = 'upgrade'").groupBy(F.col("distinct_id").alias("unit")).agg(F.max("timestamp").alias("last"))
    j = first.join(last, "unit", "left")
    return j.groupBy("flag", "variant").agg(F.count("*").alias("units"), F.count(F.when(F.col("last") >= F.col("exposed_at"), 1)).alias("followed"),
                                            F.count(F.when(F.col("last") < F.col("exposed_at"), 1)).alias("before_only"))


def card(c):
    return ex.measure(events(c), FLAGS, None, S, ASOF)


Z = stats.Z95


def W(c, n, z=Z):
    mid, half, den = f"(({c})/({n})+{z*z}/(2*({n})))", f"{z}*sqrt(({c})/({n})*(1-({c})/({n}))/({n})+{z*z}/(4.0*({n})*({n})))", f"(1+{z*z}/({n}))"
    return f"floor(greatest(0,({mid}-{half})/{den})*1000+0.5)/10", f"floor(least(1,({mid}+{half})/{den})*1000+0.5)/10"


_lo, _hi = W("converted", "exposed")


@plan("experiment_measure", CARD + """SELECT flag, goal, variant, variant='control' AS is_control, exposed, converted, CASE WHEN exposed>0 THEN floor(converted*1000/exposed+0.5)/10 ELSE 0 END AS rate_pct, exposed<30 AS small_sample FROM card""")
def _(c):
    return ex.rates(card(c)).drop("ci_lo", "ci_hi")


@plan("wilson_interval", CARD + f"SELECT flag, goal, variant, CASE WHEN exposed>0 THEN {_lo} ELSE 0 END AS ci_lo, CASE WHEN exposed>0 THEN {_hi} ELSE 0 END AS ci_hi FROM card")
def _(c):
    return ex.rates(card(c)).select("flag", "goal", "variant", "ci_lo", "ci_hi")


REASON = """CASE WHEN nt<=0 OR nc<=0 THEN 'no_sample' WHEN ct<=0 AND cc<=0 THEN 'no_conversions' WHEN ct<=0 THEN 'test_zero' WHEN cc<=0 THEN 'control_zero' WHEN ct>=nt OR cc>=nc THEN 'saturated'
 WHEN cc/nc<10*sqrt(cc/nc*(1-cc/nc)/nc) THEN 'control_near_zero' ELSE 'ok' END"""
RT = lambda e: f"(sign({e})*floor(abs({e})*10+0.5)/10)"


def _lift(sgn, z=Z):
    return RT(f"(exp(ln((ct/nt)/(cc/nc)){sgn}{z}*sqrt((1-ct/nt)/ct+(1-cc/nc)/cc))-1)*100")


@plan("lift_interval", CARD + f", r AS (SELECT *, {REASON} AS reason FROM pr) SELECT flag, goal, variant, ct, nt, cc, nc, reason, CASE WHEN reason='ok' THEN {_lift('-')} END AS lift_lo, CASE WHEN reason='ok' THEN {RT('(ct/nt/(cc/nc)-1)*100')} END AS lift_pct, CASE WHEN reason='ok' THEN {_lift('+')} END AS lift_hi FROM r")
def _(c):
    return ex.lift_intervals(ex.versus_control(card(c)))


_l1, _u1 = W("ct", "nt")
_l2, _u2 = W("cc", "nc")


@plan("diff_interval", CARD + f""", w AS (SELECT *, {_l1}/100 AS l1, {_u1}/100 AS u1, {_l2}/100 AS l2, {_u2}/100 AS u2, ct/nt AS p1, cc/nc AS p2 FROM pr WHERE nt>0 AND nc>0)
 SELECT flag, goal, variant, ct, nt, cc, nc, {RT('(p1-p2-sqrt((p1-l1)**2+(u2-p2)**2))*100')} AS diff_lo, {RT('(p1-p2)*100')} AS diff_pp, {RT('(p1-p2+sqrt((u1-p1)**2+(p2-l2)**2))*100')} AS diff_hi FROM w""")
def _(c):
    return ex.diff_intervals(ex.versus_control(card(c)).where("nt > 0 and nc > 0"))


@plan("two_proportion_test")
def _(c):
    return ex.two_proportion(ex.versus_control(card(c)))


@plan("two_proportion_z", CARD + "SELECT flag, goal, variant, round(CASE WHEN nt>0 AND nc>0 AND ct+cc>0 THEN abs(ct/nt-cc/nc)/sqrt((ct+cc)/(nt+nc)*(1-(ct+cc)/(nt+nc))*(1.0/nt+1.0/nc)) END,6) AS z FROM pr")
def _(c):
    return ex.two_proportion(ex.versus_control(card(c))).select("flag", "goal", "variant", "z")


A2 = f"({-2 * __import__('math').log(0.05)!r})"
WF = f"sqrt(2*(u+1)/u*ln(sqrt(u+1)/0.05))"
SEQ = CARD + f""", s AS (SELECT *, ct/nt-cc/nc AS diff, nt+nc AS n, sqrt(ct/nt*(1-ct/nt)/nt+cc/nc*(1-cc/nc)/nc) AS se, (nt+nc)*({A2}+ln({A2}+1))/5000 AS u FROM pr WHERE nt>0 AND nc>0)"""


@plan("sequential_interval", SEQ + f"""SELECT flag, goal, variant, n, round(CASE WHEN se>0 THEN {WF}/{Z} ELSE 1 END,6) AS k, round(CASE WHEN se>0 THEN {WF}*se ELSE 0 END,6) AS half_width, round(diff-CASE WHEN se>0 THEN {WF}*se ELSE 0 END,6) AS lo,
 round(diff+CASE WHEN se>0 THEN {WF}*se ELSE 0 END,6) AS hi, se>0 AND abs(diff)>{WF}*se AS excludes_zero FROM s""")
def _(c):
    return ex.sequential(ex.versus_control(card(c))).select("flag", "goal", "variant", "n", "k", "half_width", "lo", "hi", "excludes_zero")


@plan("sequential_test")
def _(c):
    return ex.sequential_p(ex.sequential(ex.versus_control(card(c)))).select("flag", "goal", "variant", "n", "mode", "k", "lo", "hi", "excludes_zero", "always_valid_p")


@plan("guardrail_evaluate")
def _(c):
    return ex.guardrails(events(c), [F1], S, ASOF)


@plan("guardrail_confirmed_breach", """WITH h AS (SELECT device AS flag, country AS variant, d, count(*) FILTER (WHERE name='error')*5>count(*) AS bad FROM pev GROUP BY 1,2,3)
 SELECT flag, 'error' AS event, variant, d FROM (SELECT *, lag(bad) OVER (PARTITION BY flag, variant ORDER BY d) AS p FROM h) WHERE bad AND p AND d>'2024-01-01'""")
def _(c):
    h = c.prod.groupBy(F.col("device").alias("flag"), F.col("country").alias("variant"), F.to_date("timestamp").alias("_d")).agg(
        (F.count(F.when(F.col("name") == "error", 1)) * 5 > F.count("*")).alias("bad"))
    checks = h.select("flag", F.lit("error").alias("event"), "variant", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started"), F.col("_d").cast("timestamp").alias("at"),
                      F.when(F.col("bad"), "FAIL").otherwise("PASS").alias("status"))
    return ex.confirmed_breaches(checks).select("flag", "event", "variant", F.date_format("at", "yyyy-MM-dd").alias("d"))


# ---- sample ratio, many hypotheses --------------------------------------------------------------------
SRM = XP + """, fp AS (SELECT flag, distinct_id, arg_min(variant,us) AS variant, arg_min(device,us) AS device, arg_min(browser,us) AS browser, arg_min(country,us) AS country FROM x GROUP BY 1,2),
 ws AS (SELECT * FROM (VALUES ('f1','control',0.5),('f1','test',0.5),('f2','control',0.25),('f2','a',0.25),('f2','b',0.5),('f3','control',0.5),('f3','test',0.5)) t(flag,variant,share)) """


@plan("srm_check")
def _(c):
    return ex.srm(events(c), FLAGS, S, ASOF)


@plan("srm_chi_square", SRM + """, t AS (SELECT flag, count(*) AS total FROM fp GROUP BY 1), o AS (SELECT flag, variant, count(*) AS n FROM fp GROUP BY 1,2)
 SELECT flag, max(total) AS total, count(*)-1 AS df, min(total*share)>=5 AS checked, round(CAST(sum((coalesce(n,0)-total*share)**2/(total*share)) AS DOUBLE),3) AS chi_square FROM ws JOIN t USING (flag) LEFT JOIN o USING (flag, variant) GROUP BY 1""")
def _(c):
    return ex.srm_counts(events(c), FLAGS, S, ASOF).select("flag", "total", "df", "checked", "chi_square")


@plan("srm_worst_segment", SRM + """, sg AS (SELECT flag, variant, 'device' AS prop, device AS value FROM fp UNION ALL SELECT flag, variant, 'browser', browser FROM fp UNION ALL SELECT flag, variant, 'country', country FROM fp),
 t AS (SELECT flag, prop, value, count(*) AS total FROM sg GROUP BY 1,2,3), o AS (SELECT flag, prop, value, variant, count(*) AS n FROM sg GROUP BY 1,2,3,4),
 z AS (SELECT flag, prop, value, max(total) AS n, CAST(sum((coalesce(o.n,0)-total*share)**2/(total*share)) AS DOUBLE) AS chi FROM t JOIN ws USING (flag) LEFT JOIN o USING (flag,prop,value,variant) GROUP BY 1,2,3)
 SELECT flag, prop, value, n, round(chi,3) AS chi_square FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY chi DESC, prop, value) AS r FROM z WHERE n>=30 AND chi>=10.83) WHERE r=1""")
def _(c):
    return ex.srm_worst_segment(events(c), FLAGS, S, ASOF)


BH = """WITH t AS (SELECT country AS experiment, browser AS variant, name AS metric, round((sum(k*k)%997)/9970.0 * CASE WHEN name IN ('view','click') THEN 0.05 ELSE 1 END,6) AS p FROM pev GROUP BY 1,2,3),"""


@plan("bh_correction", BH + """ r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY p, variant, metric) AS rank, count(*) OVER (PARTITION BY experiment) AS m FROM t)
 SELECT experiment, variant, metric, CAST(p AS DOUBLE) AS p, rank, round(CAST(min(least(1,m/rank*p)) OVER (PARTITION BY experiment ORDER BY rank DESC) AS DOUBLE),6) AS p_adjusted,
 rank<=max(CASE WHEN p<=rank/m*0.05 THEN rank ELSE 0 END) OVER (PARTITION BY experiment) AS rejected FROM r""")
def _(c):
    t = c.prod.groupBy(F.col("country").alias("experiment"), F.col("browser").alias("variant"), F.col("name").alias("metric")).agg(F.sum(F.col("k") * F.col("k")).alias("s"))
    p = F.col("s") % 997 / 9970.0 * F.when(F.col("metric").isin("view", "click"), 0.05).otherwise(1.0)
    return ex.benjamini_hochberg(t.select("experiment", "variant", "metric", F.round(p, 6).alias("p")))


@plan("dead_experiments")
def _(c):
    return ex.dead_experiments(events(c), FLAGS, ASOF)


# ---- variance reduction and ratios --------------------------------------------------------------------
OUT = [eu.Outcome("f1", "signup", count=True), eu.Outcome("f3", "purchase", "click", 5), eu.Outcome("f1", "purchase", "click", 5)]


@plan("cuped_units", XP + """, o AS (SELECT * FROM (VALUES ('f1','signup','signup',7,true),('f3','purchase','click',5,false),('f1','purchase','click',5,false)) t(flag,goal,cov,lb,cnt)),
 al AS (SELECT distinct_id, min(us) AS seen FROM (SELECT distinct_id, us FROM pev WHERE name<>'view' OR ts>=TIMESTAMP '2024-01-12') GROUP BY 1)
 SELECT flag, goal, cov AS covariate, unit, variant, CAST(CASE WHEN cnt THEN gs ELSE least(gs,1) END AS DOUBLE) AS y, CAST(px AS DOUBLE) AS x, seen<=xus-lb*86400000000 AS has_pre FROM
 (SELECT fe.flag, o.goal, o.cov, fe.unit, fe.variant, fe.xus, o.lb, o.cnt, al.seen, count(*) FILTER (WHERE g.nm=o.goal AND g.us>=fe.xus) AS gs, count(*) FILTER (WHERE g.nm=o.cov AND g.us<fe.xus AND g.us>=fe.xus-o.lb*86400000000) AS px
  FROM fe JOIN o USING (flag) JOIN al ON al.distinct_id=fe.unit LEFT JOIN g ON g.distinct_id=fe.unit GROUP BY ALL)""")
def _(c):
    return eu.cuped_units(events(c), [F1, F3], OUT, S, ASOF)


@plan("cuped_adjust")
def _(c):
    return eu.cuped_adjust(materialize(eu.cuped_units(events(c), [F1, F3], OUT, S, ASOF)), [F1, F3])


RATIO = eu.Ratio("signup", "amount", denominator_prop="path")
RV = XP + """, av AS (SELECT fe.flag, fe.unit, fe.variant, path AS au, coalesce(sum(amount) FILTER (WHERE e.name='signup'),0) AS value FROM fe JOIN um USING (flag, unit) JOIN pev e ON e.distinct_id=um.distinct_id AND e.us>=fe.xus
   WHERE fe.flag IN ('f1','f2') AND (e.name<>'view' OR e.ts>=TIMESTAMP '2024-01-12') GROUP BY 1,2,3,4),
 bd AS (SELECT flag, quantile_cont(value,0.01) AS lo, quantile_cont(value,0.99) AS hi FROM av GROUP BY 1), wv AS (SELECT av.* REPLACE (least(hi,greatest(lo,value)) AS value) FROM av JOIN bd USING (flag)) """


@plan("ratio_units", RV + "SELECT flag, unit, variant, round(sum(value),6) AS num, CAST(count(*) AS DOUBLE) AS den FROM av GROUP BY 1,2,3")
def _(c):
    return eu.ratio_units(events(c), [F1, F2], RATIO, S, ASOF).withColumn("num", F.round("num", 6))


@plan("winsorize", RV + "SELECT flag, variant, count(*) AS n, round(sum(value),4) AS total, round(min(value),6) AS lo, round(max(value),6) AS hi FROM wv GROUP BY 1,2")
def _(c):
    w = eu.winsorize(eu.ratio_analysis_units(events(c), [F1, F2], RATIO, S, ASOF))
    return w.groupBy("flag", "variant").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


RM = RV + f""", ru AS (SELECT flag, unit, variant, sum(value) AS s, count(*) AS n FROM wv GROUP BY 1,2,3),
 a AS (SELECT flag, variant, count(*) AS units, sum(s) AS sm, sum(n) AS d, sum(s)/sum(n) AS r, var_samp(s) AS vs, var_samp(n) AS vn, covar_samp(s,n) AS cv, sum(s*s) AS ss, sum(s*n) AS sn, sum(n*n) AS nn FROM ru GROUP BY 1,2),
 b AS (SELECT *, sqrt((vs-2*r*cv+r*r*vn)/(units*(d/units)**2)) AS se, sqrt((ss-2*r*sn+r*r*nn)/((units-1)*units*(d/units)**2)) AS sec FROM a),
 nv AS (SELECT flag, variant, sqrt(var_samp(value)/count(*)) AS sen FROM wv GROUP BY 1,2),
 q AS (SELECT b.*, sen, c.r AS cr, c.se AS cs, b.variant<>'control' AND NOT (c.r<10*c.se) AS fine, ln(b.r/c.r) AS lp, sqrt((b.se/b.r)**2+(c.se/c.r)**2) AS ls FROM b JOIN nv USING (flag, variant) JOIN b c ON c.flag=b.flag AND c.variant='control')
 SELECT flag, variant, units, round(sm,6) AS num, round(CAST(d AS DOUBLE),6) AS den, round(r,6) AS ratio, round(se,6) AS se, round(sec,6) AS se_cluster, round(sen,6) AS se_naive, CASE WHEN fine THEN {RT('(exp(lp)-1)*100')} END AS delta_pct,
 CASE WHEN fine THEN {RT(f'(exp(lp-{Z}*ls)-1)*100')} END AS delta_lo, CASE WHEN fine THEN {RT(f'(exp(lp+{Z}*ls)-1)*100')} END AS delta_hi, round(CASE WHEN fine THEN abs(lp)/ls END,6) AS z FROM q"""


def _ratio(c):
    e = events(c)
    w = eu.winsorize(materialize(eu.ratio_analysis_units(e, [F1, F2], RATIO, S, ASOF)))
    return eu.ratio_metric(eu.ratio_units(e, [F1, F2], RATIO, S, ASOF, values=w), [F1, F2], w)


@plan("ratio_metric", RM)
def _(c):
    return _ratio(c)


@plan("ratio_metric_p")
def _(c):
    return eu.ratio_p(_ratio(c)).select("flag", "variant", "ratio", "z", "p")


# ---- power ----------------------------------------------------------------------------------------------
PB = """WITH w AS (SELECT * FROM pev WHERE ts>=TIMESTAMP '2024-01-03' AND ts<TIMESTAMP '2024-02-04'), u AS (SELECT country AS segment, distinct_id, max(CASE WHEN name='purchase' AND k<5 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN name='purchase' AND k<5 THEN amount ELSE 0 END) AS x FROM w GROUP BY 1,2),
 dd AS (SELECT country AS segment, strftime(b,'%Y-%m-%d') AS d FROM (SELECT DISTINCT country FROM pev), range(TIMESTAMP '2024-01-03', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) t(b)),
 dm AS (SELECT segment, median(n) AS daily_units FROM (SELECT dd.segment, dd.d, count(DISTINCT distinct_id) AS n FROM dd LEFT JOIN w ON w.country=dd.segment AND w.d=dd.d GROUP BY 1,2) GROUP BY 1),
 mo AS (SELECT segment, avg(x) AS m FROM u GROUP BY 1),
 pb AS (SELECT segment, CAST(32 AS BIGINT) AS days, count(*) AS units, CAST(sum(c) AS BIGINT) AS converters, round(sum(c)/count(*),6) AS rate, any_value(daily_units) AS daily_units, coalesce(round(CASE WHEN avg((x-m)**2)>0 THEN avg((x-m)**3)/power(avg((x-m)**2),1.5) END,4),0) AS skewness FROM u JOIN mo USING (segment) JOIN dm USING (segment) GROUP BY 1) """


def _baseline(c):
    d = c.prod.withColumn("name", F.when((F.col("name") == "purchase") & (F.col("k") < 5), "upgrade").otherwise(F.col("name")))
    return eu.power_baseline(d, "upgrade", "2024-01-03 00:00:00", "2024-02-04 00:00:00", F.col("country"), "amount")


@plan("power_baseline", PB + "SELECT *, abs(skewness)>5 AS heavy_tail FROM pb")
def _(c):
    return _baseline(c)


def _designs(c):
    b = _baseline(c).where("not heavy_tail")
    return b.select("segment", "units", "daily_units", F.col("rate").alias("baseline"), F.explode(F.array(*[F.lit(x) for x in (5.0, 10.0, 20.0, 50.0)])).alias("mde_pct"))


ZZ = (stats.z_at(0.975) + stats.z_at(0.8)) ** 2


@plan("power_plan", PB + f""", ds AS (SELECT segment, units, daily_units, rate AS baseline, m AS mde_pct, rate*(1+m/100) AS target FROM pb, (VALUES (5.0::DOUBLE),(10),(20),(50)) t(m) WHERE abs(skewness)<=5 AND rate>0 AND rate*(1+m/100)<1),
 n AS (SELECT *, {ZZ!r}*(baseline*(1-baseline)+target*(1-target))/((target-baseline)**2) AS nc FROM ds), t AS (SELECT *, CAST(ceil(nc*2*0.5) AS BIGINT) AS n_control, CAST(2*ceil(nc*2*0.5) AS BIGINT) AS n_planned FROM n)
 SELECT segment, units, daily_units, baseline, mde_pct, round(target,6) AS target, n_control, n_planned, CAST(ceil(n_planned/daily_units) AS BIGINT) AS duration_days, CAST(greatest(ceil(n_planned/daily_units),14) AS BIGINT) AS recommended_days FROM t""")
def _(c):
    return eu.power_plan(_designs(c)).withColumn("target", F.round("target", 6))


@plan("power_search")
def _(c):
    return eu.power_search(eu.power_plan(_designs(c)))
