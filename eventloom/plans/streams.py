from pyspark.sql import functions as F

from eventloom.operators import experiments as ex, ops, sketches as sk
from eventloom.operators.scope import scope_production
from eventloom.plans.registry import plan
from eventloom.plans.sequences import CHAIN, H6, STEPS
from eventloom.plans.source_jobs import NOW, REASON, raw_lines
from eventloom.sources import refresh
from eventloom.streaming import jobs

US = lambda c: F.unix_micros(c)


def live(c):
    return scope_production(c.stream())


def _lines(c):
    """Raw client lines as a stream; every third row repeats the id before it."""
    from types import SimpleNamespace
    s = c.stream()
    s = s.withColumn("id", F.concat(F.lit("e"), F.col("eid") - F.col("eid") % 3)).withColumn("eid", (F.col("eid") - F.col("eid") % 3)).withColumn("distinct_id", F.concat(F.lit("s"), F.col("eid") % 50)).withColumn("name", F.lit("sent"))
    return raw_lines(SimpleNamespace(events=s))


@plan("stream_ingest", f"""WITH s AS (SELECT eid-eid%3 AS eid FROM ev), r AS (SELECT DISTINCT eid, {REASON} AS reason FROM s), x AS (SELECT {REASON} AS reason FROM s)
 SELECT 'accepted' AS outcome, count(*) AS rows FROM r WHERE reason='accepted' AND eid%5<>0 UNION ALL SELECT reason, count(*) FROM x WHERE reason<>'accepted' GROUP BY 1""", base="ev")
def _(c):
    ok, bad = jobs.ingest(_lines(c), NOW, "400 days")
    a = jobs.run(ok, "ingest").where("length(id) < 32").agg(F.lit("accepted").alias("outcome"), F.count("*").alias("rows"))
    return a.unionByName(jobs.run(bad, "rejected").groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("rows")))


@plan("stream_trend", """SELECT epoch_us(date_trunc('hour',ts)) AS start_us, name, count(*) AS n FROM pev WHERE date_trunc('hour',ts)+INTERVAL 1 HOUR <= (SELECT max(ts) FROM pev)-INTERVAL 1 HOUR GROUP BY 1,2""")
def _(c):
    return jobs.run(jobs.trend(live(c)), "trend").select(US("start").alias("start_us"), "name", "n")


@plan("stream_active_users", """WITH w AS (SELECT distinct_id, unnest(generate_series(us//60000000-4, us//60000000))*60000000 AS start_us FROM pev)
 SELECT start_us, count(DISTINCT distinct_id) AS live FROM w WHERE start_us+300000000 <= (SELECT max(us) FROM pev)-3600000000 GROUP BY 1""")
def _(c):
    path = jobs.work_dir(c.spark, "active")
    jobs.active_users(live(c), path)
    return c.spark.read.schema(jobs.LIVE_OUT).parquet(f"{path}/data").select(US("start").alias("start_us"), "live")


@plan("stream_sessions", """WITH f AS (SELECT *, CASE WHEN us-lag(us) OVER w<=1800000000 THEN 0 ELSE 1 END AS o FROM pev WINDOW w AS (PARTITION BY distinct_id ORDER BY us,id)), n AS (SELECT *, sum(o) OVER (PARTITION BY distinct_id ORDER BY us,id) AS sid FROM f),
 ss AS (SELECT distinct_id, min(us) AS start_us, max(us) AS last_us, count(*) AS events FROM n GROUP BY distinct_id, sid) SELECT * FROM ss WHERE last_us+1800000000 <= (SELECT max(us) FROM pev)-3600000000""")
def _(c):
    return jobs.run(jobs.sessions(live(c)), "sessions").select("distinct_id", US("start").alias("start_us"), US("last").alias("last_us"), "events")


ALERTS = [("a1", "count", "purchase", None, "gt", 70.0, 24), ("a2", "count", "error", None, "lt", 60.0, 24), ("a3", "relative", "view", None, "gt", 5.0, 48),
          ("a4", "ratio", "error", "view", "gt", 95.0, 12), ("a5", "count", "never", None, "lt", 1.0, 72), ("a6", "anomaly", None, None, None, None, 24)]


@plan("stream_alerts", """WITH dp AS (SELECT us//3600000000 AS h, CASE WHEN name='purchase' AND ts>=TIMESTAMP '2024-01-28' AND k%4<>0 THEN 'late_purchase' ELSE name END AS name, us FROM pev),
 hrs AS (SELECT h, name, count(*) AS n FROM dp WHERE (h+2)*3600000000 <= (SELECT max(us) FROM pev) GROUP BY 1,2), b AS (SELECT min(h) AS lo, max(h)+1 AS hi FROM hrs),
 r(id,kind,event,against,op,threshold,w) AS (VALUES ('a1','count','purchase',NULL,'gt',70.0,24),('a2','count','error',NULL,'lt',60.0,24),('a3','relative','view',NULL,'gt',5.0,48),('a4','ratio','error','view','gt',95.0,12),('a5','count','never',NULL,'lt',1.0,72),('a6','anomaly',NULL,NULL,NULL,NULL,24)),
 e AS (SELECT r.*, unnest(generate_series((lo//w+1)*w, (hi//w)*w, w)) AS e FROM r, b),
 c AS (SELECT id, kind, event, op, threshold, w, e, coalesce(sum(n) FILTER (WHERE name=event AND h>=e-w),0) AS cur, coalesce(sum(n) FILTER (WHERE name=event AND h<e-w),0) AS prev, coalesce(sum(n) FILTER (WHERE name=against AND h>=e-w),0) AS den
  FROM e LEFT JOIN hrs ON h>=e-2*w AND h<e WHERE kind<>'anomaly' GROUP BY ALL),
 x AS (SELECT e, name, sum(n) AS volume, coalesce(sum(n) FILTER (WHERE h>=e-24),0) AS last24, sum(n) FILTER (WHERE h<e-24) AS base, count(DISTINCT (e-25-h)//24) FILTER (WHERE h<e-24) AS obs FROM e JOIN hrs ON h>=e-192 AND h<e WHERE kind='anomaly' GROUP BY 1,2),
 t AS (SELECT *, (last24-base/obs)/(base/obs) AS dev FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY volume DESC, name) AS rn FROM x) WHERE rn<=6 AND obs>=5 AND base>=20 AND base/obs>=3),
 z AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY abs(dev) DESC, volume DESC, name) AS best FROM t WHERE abs(dev)>=0.4)
 SELECT id, kind, event, (e-w)*3600000000 AS start_us, CAST(cur AS BIGINT) AS n, CAST(CASE kind WHEN 'ratio' THEN round(cur/den*100,6) ELSE cur END AS DOUBLE) AS value FROM c
 WHERE CASE kind WHEN 'count' THEN CASE op WHEN 'gt' THEN cur>threshold ELSE cur<threshold END WHEN 'relative' THEN prev>0 AND (cur-prev)/prev*100>=threshold ELSE den>0 AND cur/den*100>threshold END
 UNION ALL SELECT 'a6','anomaly',NULL,(e-24)*3600000000,CAST(last24 AS BIGINT),CAST(sign(dev)*round(abs(dev)*100) AS DOUBLE) FROM z WHERE best=1 AND dev<0""")
def _(c):
    """All four kinds, windows of 12 to 72 hours, an event that never comes and a dip of purchases."""
    n = F.col("name")
    d = live(c).withColumn("name", F.when((n == "purchase") & (F.col("timestamp") >= "2024-01-28") & (F.col("k") % 4 != 0), "late_purchase").otherwise(n))
    path = jobs.work_dir(c.spark, "alerts")
    jobs.alerts(d, c.spark.createDataFrame(ALERTS, ops.ALERT_DDL), path)
    return c.spark.read.schema(jobs.ALERT_OUT).parquet(f"{path}/data").select("id", "kind", "event", US("start").alias("start_us"), "n", "value")


B1 = "(CAST(CAST('0x'||substr(sha256('variant:f1:'||distinct_id),1,15) AS BIGINT) AS DOUBLE)/1152921504606846976)"


@plan("stream_experiment_tally", f"""WITH x AS (SELECT distinct_id, min(us) AS f, CASE WHEN {B1}<0.5 THEN 'control' ELSE 'test' END AS variant FROM pev WHERE name='view' GROUP BY 1), g AS (SELECT distinct_id, max(us) AS l FROM pev WHERE name='purchase' AND k<5 GROUP BY 1)
 SELECT 'f1' AS flag, variant, count(*) AS exposed, count(*) FILTER (WHERE l>=f) AS converted FROM x LEFT JOIN g USING (distinct_id) GROUP BY 2""")
def _(c):
    return _tallied(c, ex.Flag("f1", (("control", 1), ("test", 1)), "upgrade"))


def _tallied(c, f, **how):
    n = F.col("name")
    name = F.when(n == "view", ex.EXPOSURE).when((n == "purchase") & (F.col("k") < 5), "upgrade").otherwise(n)
    d = live(c).withColumn("name", name).withColumn(ex.P_FLAG, F.when(F.col("name") == ex.EXPOSURE, "f1")).withColumn(ex.P_VARIANT, ex.variant_of(f, F.col("distinct_id")))
    r = jobs.run(jobs.experiment_tally(d, [f], **how), "tally")
    return r.groupBy("flag", "variant").agg(F.sum("exposed").alias("exposed"), F.sum("converted").alias("converted"))


@plan("stream_experiment_until", f"""WITH b AS (SELECT * FROM pev WHERE ts < TIMESTAMP '2024-01-16'), x AS (SELECT distinct_id, min(us) AS f, CASE WHEN {B1}<0.5 THEN 'control' ELSE 'test' END AS variant FROM b WHERE name='view' GROUP BY 1), g AS (SELECT distinct_id, max(us) AS l FROM b WHERE name='purchase' AND k<5 GROUP BY 1)
 SELECT 'f1' AS flag, variant, count(*) AS exposed, count(*) FILTER (WHERE l>=f) AS converted FROM x LEFT JOIN g USING (distinct_id) GROUP BY 2""")
def _(c):
    """The same flag, stopped halfway: later events do not count, and its units leave the state."""
    return _tallied(c, ex.Flag("f1", (("control", 1), ("test", 1)), "upgrade", stopped="2024-01-16 00:00:00"), delay="60 days")


@plan("stream_funnel_state", CHAIN + "SELECT distinct_id, CAST(reached AS BIGINT) AS reached FROM o")
def _(c):
    r = jobs.run(jobs.funnel_state(live(c), STEPS, H6), "funnel")
    return r.groupBy("distinct_id").agg(F.max("reached").alias("reached"))


@plan("stream_active_sketches", """WITH w AS (SELECT distinct_id, unnest(generate_series(us//60000000-4, us//60000000))*60000000 AS start_us FROM pev WHERE (us//60000000+1)*60000000 <= (SELECT max(us) FROM pev)-3600000000)
 SELECT start_us, count(DISTINCT distinct_id) AS live, TRUE AS within FROM w GROUP BY 1""")
def _(c):
    """People of sliding five-minute windows, united from one streamed sketch per minute, beside the exact count of the same minutes."""
    minutes = jobs.run(jobs.people_sketches(live(c)), "people-sketches")
    guess = jobs.united(minutes, 60, 300).select(US("start").alias("_s"), F.col("live").alias("_live"))
    done = minutes.select(F.unix_micros("start").alias("_m"))
    own = c.prod.withColumn("_m", F.floor(F.unix_micros("timestamp") / 60_000_000) * 60_000_000).join(done, "_m", "left_semi")
    spread = own.select("distinct_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("_m") - i * 60_000_000)).alias("start_us"))
    exact = spread.groupBy("start_us").agg(F.count_distinct("distinct_id").alias("live"))
    return exact.join(guess, F.col("start_us") == F.col("_s"), "left").select("start_us", "live", F.coalesce(sk.within(F.col("_live"), F.col("live")), F.lit(False)).alias("within"))


@plan("late_days_refresh", """WITH l AS (SELECT DISTINCT d FROM pev WHERE ts<TIMESTAMP '2024-01-12' AND k%10=3)
 SELECT pev.d AS day, name, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(DISTINCT distinct_id) AS people, TRUE AS within, pev.d IN (SELECT d FROM l) AS late FROM pev GROUP BY pev.d, name""")
def _(c):
    """Two streams feed one store; the second brings rows of the first eleven days late. ``late``: the second refresh has rewritten the day."""
    store = jobs.work_dir(c.spark, "late")
    late = (F.col("timestamp") < "2024-01-12") & F.coalesce(F.col("k") % 10 == 3, F.lit(False))
    columns = ["id", "name", "distinct_id", "timestamp"]
    refresh.run(live(c).where(~late).select(columns), "ontime", store)
    refresh.append(c.prod.where(late).select(columns), "late-0", store)
    again = refresh.refresh(c.spark, store).select(F.col("day").alias("_again"))
    d = refresh.daily(c.spark, store).join(again, F.col("day") == F.col("_again"), "left")
    sure = c.prod.groupBy(F.to_date("timestamp").alias("_d"), F.col("name").alias("_m")).agg(F.count_distinct("distinct_id").alias("people"))
    j = d.select("day", "name", "n", "first", "last", F.hll_sketch_estimate("people").alias("_p"), F.col("_again").isNotNull().alias("late")).join(sure, (F.col("day") == F.col("_d")) & (F.col("name") == F.col("_m")), "left")
    return j.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "name", "n", US("first").alias("first_us"), US("last").alias("last_us"), "people", F.coalesce(sk.within(F.col("_p"), F.col("people")), F.lit(False)).alias("within"), "late")
