from pyspark.sql import functions as F

from eventloom.operators import changes as ch, insights as ins
from eventloom.plans.ai_reports import DEPLOY_SQL, deploys
from eventloom.plans.inputs import ASOF
from eventloom.operators.deploys import around
from eventloom.plans.registry import plan
from eventloom.session import materialize

# From the 16th, Safari purchases and a quarter of the rest are recorded under another name: a real step down.
# From the 22nd, sign-ups stop being sent at all: lost tracking.
REG = """WITH rg AS (SELECT * REPLACE (CASE WHEN name='purchase' AND ts>=TIMESTAMP '2024-01-16' AND (browser='Safari' OR k%4=0) THEN 'browse' WHEN name='signup' AND ts>=TIMESTAMP '2024-01-22' THEN '$click'
   WHEN name='view' THEN '$pageview' ELSE name END AS name) FROM pev)"""


def regressed(c):
    n, t = F.col("name"), F.col("timestamp")
    moved = (n == "purchase") & (t >= "2024-01-16") & ((F.col("browser") == "Safari") | (F.col("k") % 4 == 0))
    d = c.prod.withColumn("name", F.when(moved, "browse").when((n == "signup") & (t >= "2024-01-22"), "$click").when(n == "view", "$pageview").otherwise(n))
    return d.drop("k", "uid", "eid")


def step_sql(asof_day, src="cnt", keys="name", window=30):
    """Step detection over (keys, dn, c); asof_day is an SQL expression for the last day."""
    return f"""sp AS (SELECT {keys}, min(dn) AS a, max({asof_day}) AS b FROM {src} GROUP BY {keys}),
 gd AS (SELECT {keys}, unnest(range(a, b+1)) AS dn FROM sp), ds AS (SELECT gd.*, coalesce(s.c,0) AS c FROM gd LEFT JOIN {src} s USING ({keys}, dn)),
 ix AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n, sum(c) OVER (PARTITION BY {keys}) AS t, coalesce(sum(c) OVER (PARTITION BY {keys} ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pre FROM ds WINDOW w AS (PARTITION BY {keys} ORDER BY dn)),
 sc AS (SELECT *, round(i*(n-i)/n*power((t-pre)/(n-i)-pre/i,2),9) AS score FROM ix WHERE n>=6 AND i>=3 AND i<=n-3),
 ct AS (SELECT {keys}, dn AS day, i AS ci FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, i) AS r FROM sc) WHERE r=1),
 md AS (SELECT {keys}, any_value(day) AS day, any_value(n) AS days, median(c) FILTER (WHERE i<ci) AS b, median(c) FILTER (WHERE i>=ci) AS a FROM ix JOIN ct USING ({keys}) GROUP BY {keys}),
 st AS (SELECT {keys}, day, days, round(b,1) AS before, round(a,1) AS after, CASE WHEN a=0 AND b=0 THEN NULL WHEN b=0 THEN 100 ELSE round((a-b)/b*100,1) END AS pct, CASE WHEN b>0 AND a<b THEN 'drop' ELSE 'spike' END AS direction,
  NOT (a=0 AND b=0) AND abs(a-b)/greatest(b,1)>=0.25 AS found FROM md),
 fd AS (SELECT {keys}, day, CASE direction WHEN 'drop' THEN 'regression' ELSE 'surge' END AS kind, before, after, pct, CAST(floor(abs(before-after)*30) AS BIGINT) AS people FROM st WHERE found AND before>=5 AND floor(abs(before-after)*30)>=20) """


CNT = REG + ", cnt AS (SELECT name, dn, count(*) AS c FROM rg WHERE NOT starts_with(name,'$') AND dn>19753-30 GROUP BY 1,2), " + step_sql("19753")
NAME_DAY = "strftime(make_date(CAST(day AS INTEGER)),'%Y-%m-%d')"


@plan("step_change", CNT + f"SELECT name, day, days, before, after, CAST(pct AS DOUBLE) AS pct, direction, found, found AND after=0 AS stopped FROM st")
def _(c):
    return ch.detect(regressed(c), ASOF)


@plan("investigate_findings", CNT + """, rv AS (SELECT name, sum(amount)/count(DISTINCT distinct_id) AS pp FROM rg WHERE ts>=TIMESTAMP '2024-01-01' GROUP BY 1),
 rc AS (SELECT f.name, f.kind='regression' AND 19753-day>=4 AND count(*) FILTER (WHERE us>=(19753-3)*86400000000)/3>=0.9*count(*) FILTER (WHERE us>=(day-3)*86400000000 AND us<day*86400000000)/3 AND count(*) FILTER (WHERE us>=(day-3)*86400000000 AND us<day*86400000000)>0 AS rec FROM fd f JOIN rg USING (name) GROUP BY f.name, f.kind, day)
 SELECT name, strftime(make_date(CAST(day AS INTEGER)),'%Y-%m-%d') AS day, kind, before, after, CAST(pct AS DOUBLE) AS pct, people, round(pp*people,2) AS usd_per_month, rec AS recovered, kind='regression' AND NOT rec AS needs_you,
 row_number() OVER (ORDER BY rec, round(pp*people,2) DESC, kind='regression' AND NOT rec DESC, people DESC, name) AS rank FROM fd JOIN rv USING (name) JOIN rc USING (name)""")
def _(c):
    return ch.investigate(regressed(c), ASOF).drop("cause_dim", "cause_value", "cause_share")


@plan("below_floor_notes", """WITH r AS (SELECT name||browser AS name, count(*)/30 AS rate FROM (SELECT *, CASE WHEN k<12 THEN 'x' ELSE 'y' END AS b FROM pev WHERE name='error' AND k<9 AND ts>=TIMESTAMP '2024-01-01') GROUP BY 1)
 SELECT name, round(rate,1) AS per_day, CAST(5 AS BIGINT) AS need_per_day FROM r WHERE rate>0 AND rate<5""")
def _(c):
    d = c.prod.withColumn("name", F.when((F.col("name") == "error") & (F.col("k") < 9), F.concat("name", "browser")).otherwise(F.concat(F.lit("$"), "name")))
    return ch.below_floor(d, ASOF)


@plan("recovery_mark", CNT + """SELECT f.name, day, round(count(*) FILTER (WHERE us>=(day-3)*86400000000 AND us<day*86400000000)/3,6) AS before_mean, round(count(*) FILTER (WHERE us>=(19753-3)*86400000000)/3,6) AS current_mean,
 19753-day>=4 AND count(*) FILTER (WHERE us>=(day-3)*86400000000 AND us<day*86400000000)>0 AND count(*) FILTER (WHERE us>=(19753-3)*86400000000)>=0.9*count(*) FILTER (WHERE us>=(day-3)*86400000000 AND us<day*86400000000) AS recovered FROM fd f JOIN rg USING (name) WHERE kind='regression' GROUP BY 1,2""")
def _(c):
    d = regressed(c)
    return ch.recovery(d, ASOF, materialize(ch.findings(d, ASOF)))


@plan("revenue_sizing", REG + "SELECT name, 'amount' AS prop, round(sum(CASE WHEN amount>0 THEN amount END)/count(DISTINCT distinct_id),6) AS per_person, count(*) AS events, count(DISTINCT distinct_id) AS people FROM rg WHERE ts>=TIMESTAMP '2024-01-01' AND NOT starts_with(name,'$') GROUP BY 1 HAVING count(*)>=20")
def _(c):
    return ch.revenue_per_person(regressed(c), ASOF)


@plan("segment_concentration", CNT + """, sn AS (SELECT f.name, f.day, least((day*86400000000-min(us))//86400000000, (max(us)-day*86400000000)//86400000000, 7) AS span FROM fd f JOIN rg USING (name) GROUP BY 1,2),
 wn AS (SELECT s.day, r.* FROM sn s JOIN rg r USING (name) WHERE span>0 AND us>=(day-span)*86400000000 AND us<(day+span)*86400000000),
 dm AS (SELECT name, day, us, 0 AS prio, 'browser' AS dim, browser AS value FROM wn UNION ALL SELECT name, day, us, 2, 'device', device FROM wn UNION ALL SELECT name, day, us, 3, 'path', path FROM wn UNION ALL SELECT name, day, us, 4, 'country', country FROM wn
  UNION ALL SELECT name, day, us, 5, 'referrer', referrer FROM wn UNION ALL SELECT name, day, us, CASE WHEN (SELECT count(account) FROM wn w2 WHERE w2.name=wn.name)>=(SELECT count(plan) FROM wn w2 WHERE w2.name=wn.name) THEN 7 ELSE 8 END, 'account', account FROM wn
  UNION ALL SELECT name, day, us, CASE WHEN (SELECT count(account) FROM wn w2 WHERE w2.name=wn.name)>=(SELECT count(plan) FROM wn w2 WHERE w2.name=wn.name) THEN 8 ELSE 7 END, 'plan', plan FROM wn),
 c AS (SELECT name, day, prio, dim, value, sum(CASE WHEN us<day*86400000000 THEN 1 ELSE -1 END) AS lost FROM dm WHERE value IS NOT NULL GROUP BY ALL),
 t AS (SELECT name, day, prio, dim, sum(lost) AS net, max(lost) AS ml, min(value) FILTER (WHERE lost=m) AS value FROM (SELECT *, max(lost) OVER (PARTITION BY name, dim) AS m FROM c) GROUP BY ALL),
 z AS (SELECT *, least(1, ml/net) AS share, row_number() OVER (PARTITION BY name ORDER BY prio) AS r FROM t WHERE net>0 AND ml>0 AND least(1, ml/net)>=0.55)
 SELECT name, day, dim, value, round(CAST(share AS DOUBLE),6) AS share FROM z WHERE r=1""")
def _(c):
    d = regressed(c)
    return ch.concentration(d, materialize(ch.findings(d, ASOF)))


IMP = REG + f""", {DEPLOY_SQL}, sp AS (SELECT name, dn, count(*) AS c FROM rg WHERE dn>19753-30 GROUP BY 1,2), sr AS (SELECT n.name, g.dn, coalesce(sp.c,0) AS c FROM (SELECT DISTINCT name FROM sp) n CROSS JOIN (SELECT unnest(range(19753-29, 19754)) AS dn) g LEFT JOIN sp ON sp.name=n.name AND sp.dn=g.dn),
 im AS (SELECT s.name, deploy, dat, avg(p.c) FILTER (WHERE p.dn<s.d0) AS b, count(*) FILTER (WHERE p.dn<s.d0) AS nb, avg(p.c) FILTER (WHERE p.dn>=s.d0) AS a, count(*) FILTER (WHERE p.dn>=s.d0) AS na FROM (SELECT DISTINCT name, deploy, dat, epoch_us(dat)//86400000000 AS d0 FROM sr, dep) s
  JOIN sr x ON x.name=s.name AND x.dn=s.d0 JOIN sr p ON p.name=s.name AND p.dn BETWEEN s.d0-3 AND s.d0+2 GROUP BY 1,2,3),
 ip AS (SELECT name, deploy, dat, round(b,6) AS before, round(a,6) AS after, round(CASE WHEN b>0 THEN (a-b)/b WHEN a=0 THEN 0 END,6) AS delta, CASE WHEN b=0 AND a>0 THEN 'improvement' WHEN b=0 OR abs((a-b)/b)<0.25 THEN 'flat' WHEN a<b THEN 'regression' ELSE 'improvement' END AS direction, nb=3 AND na=3 AND b>0 AND abs((a-b)/b)>=0.25 AS significant FROM im) """


def _impacts(c):
    return ch.impacts(regressed(c), deploys(c), ASOF)


@plan("deploy_impact", IMP + "SELECT name, deploy, before, after, delta, direction, significant FROM ip")
def _(c):
    return _impacts(c).drop("at")


@plan("interval_join_deploys", DEPLOY_SQL.replace("dep AS", "WITH dep AS") + """ SELECT deploy, name, count(*) FILTER (WHERE ts<dat) AS before, count(*) FILTER (WHERE ts>=dat) AS after FROM dep JOIN pev ON ts>=dat-INTERVAL 2 DAY AND ts<dat+INTERVAL 2 DAY GROUP BY 1,2""")
def _(c):
    j = around(c.prod.select("name", "timestamp"), deploys(c), 2)
    return j.groupBy("deploy", "name").agg(F.count(F.when(~F.col("after"), 1)).alias("before"), F.count(F.when(F.col("after"), 1)).alias("after"))


@plan("deploy_headline", IMP + "SELECT name, deploy, delta, direction FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY direction='regression' DESC, dat DESC) AS r FROM ip WHERE significant) WHERE r=1")
def _(c):
    return ch.headline(_impacts(c))


@plan("ship_near_change", CNT + ", " + DEPLOY_SQL + """, sr AS (SELECT name, dn, count(*) AS c FROM rg WHERE ts>=TIMESTAMP '2024-01-01' GROUP BY 1,2),
 im AS (SELECT s.name, deploy, dat, avg(p.c) FILTER (WHERE p.dn<s.d0) AS b, count(*) FILTER (WHERE p.dn<s.d0) AS nb, avg(p.c) FILTER (WHERE p.dn>=s.d0) AS a, count(*) FILTER (WHERE p.dn>=s.d0) AS na FROM (SELECT DISTINCT name, deploy, dat, epoch_us(dat)//86400000000 AS d0 FROM sr, dep) s
  JOIN sr x ON x.name=s.name AND x.dn=s.d0 JOIN sr p ON p.name=s.name AND p.dn BETWEEN s.d0-3 AND s.d0+2 GROUP BY 1,2,3)
 SELECT name, day, deploy, delta FROM (SELECT f.name, f.day, deploy, round((im.a-im.b)/im.b,6) AS delta, row_number() OVER (PARTITION BY f.name ORDER BY abs((im.a-im.b)/im.b) DESC, dat DESC) AS r FROM fd f JOIN im USING (name)
  WHERE nb=3 AND na=3 AND abs((im.a-im.b)/im.b)>=0.25 AND abs(epoch_us(dat)-f.day*86400000000)<=48*3600000000) WHERE r=1""")
def _(c):
    d = regressed(c)
    return ch.ship_near(d, materialize(ch.findings(d, ASOF)), deploys(c), ASOF)


@plan("tracking_break", CNT + """, o AS (SELECT f.name, f.day, count(*) FILTER (WHERE us<day*86400000000)/14 AS b, count(*) FILTER (WHERE us>=day*86400000000)/(19753-day) AS a FROM fd f JOIN rg USING (name) WHERE kind='regression' AND us>=(day-14)*86400000000 GROUP BY 1,2),
 fl AS (SELECT *, greatest(1.0, 0.02*b) AS fr FROM o), lo AS (SELECT fl.name, count(*) AS loud FROM (SELECT name, dn, count(*) AS c FROM rg GROUP BY 1,2) x JOIN fl ON fl.name=x.name AND x.dn>=fl.day AND x.c>fr GROUP BY 1),
 t AS (SELECT fl.name, count(*) FILTER (WHERE us>=(day-14)*86400000000 AND us<day*86400000000)/14 AS tb, count(*) FILTER (WHERE us>=day*86400000000)/(19753-day) AS ta FROM fl, rg GROUP BY fl.name, day)
 SELECT name, day, CASE WHEN name NOT IN ('signup','purchase') THEN 'not_planned' WHEN a>fr THEN 'still_arriving' WHEN 19753-day<2 THEN 'too_fresh' WHEN 19753-day>21 THEN 'too_old' WHEN 19753-day-coalesce(loud,0)<3 THEN 'not_quiet_long' WHEN tb-b<5 THEN 'no_witness' WHEN ta-a<0.9*(tb-b) THEN 'witness_fell' ELSE 'tracking_broke' END AS verdict,
 round(b,6) AS before, round(a,6) AS after, 19753-day-coalesce(loud,0) AS quiet, 'other_events' AS witness, round(tb-b,6) AS witness_before, round(ta-a,6) AS witness_after FROM fl LEFT JOIN lo USING (name) JOIN t USING (name)""")
def _(c):
    d = regressed(c)
    planned = c.spark.createDataFrame([("signup",), ("purchase",)], "event string")
    return ch.tracking_break(d, materialize(ch.findings(d, ASOF)), planned, ASOF)


BT = REG + """, base AS (SELECT name, dn, count(*) AS c FROM rg WHERE NOT starts_with(name,'$') GROUP BY 1,2), av AS (SELECT unnest(range(19753-20, 19754)) AS asof_day),
 cnt AS (SELECT asof_day, name, dn, c FROM base JOIN av ON dn<asof_day AND dn>asof_day-30), """ + step_sql("asof_day", keys="asof_day, name")


@plan("backtest", BT + """SELECT kind, name, strftime(make_date(CAST(day AS INTEGER)),'%Y-%m-%d') AS day, strftime(make_date(CAST(min(asof_day) AS INTEGER)),'%Y-%m-%d') AS first_seen, min(asof_day)-day AS lag_days, arg_min(people, asof_day) AS people FROM fd GROUP BY kind, name, fd.day""")
def _(c):
    return ch.backtest(regressed(c), ASOF, window_days=20)


@plan("metric_movements")
def _(c):
    return ch.movements(regressed(c), ASOF, 30)


@plan("metric_movement_z", REG + """, w AS (SELECT *, ts>=TIMESTAMP '2024-01-16' AS late FROM rg WHERE ts>=TIMESTAMP '2024-01-01'), a AS (SELECT count(DISTINCT CASE WHEN NOT late THEN distinct_id END) AS na, count(DISTINCT CASE WHEN late THEN distinct_id END) AS nb FROM w),
 m AS (SELECT name, count(DISTINCT CASE WHEN NOT late THEN distinct_id END) AS ca, count(DISTINCT CASE WHEN late THEN distinct_id END) AS cb FROM w WHERE NOT starts_with(name,'$') GROUP BY 1)
 SELECT name, cb AS people, floor(ca*1000/na+0.5)/10 AS before, floor(cb*1000/nb+0.5)/10 AS after, round(CASE WHEN (ca+cb)/(na+nb)<1 THEN abs(ca/na-cb/nb)/sqrt((ca+cb)/(na+nb)*(1-(ca+cb)/(na+nb))*(1.0/na+1.0/nb)) END,6) AS z FROM m, a""")
def _(c):
    return ch.movements(regressed(c), ASOF, 30).select("name", "people", "before", "after", "z")


# ---- digest -----------------------------------------------------------------------------------------
def dipped(c):
    """Purchases mostly fall silent on the last day."""
    n, t = F.col("name"), F.col("timestamp")
    return c.prod.withColumn("name", F.when((n == "purchase") & (t >= "2024-01-30") & (F.col("k") % 4 != 0), "late_purchase").otherwise(n))


DIP = "WITH dp AS (SELECT * REPLACE (CASE WHEN name='purchase' AND ts>=TIMESTAMP '2024-01-30' AND k%4<>0 THEN 'late_purchase' ELSE name END AS name) FROM pev)"
ANOM = DIP + """, s AS (SELECT name, count(*) AS volume, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-30') AS last24, count(*) FILTER (WHERE ts<TIMESTAMP '2024-01-30' AND ts>=TIMESTAMP '2024-01-23') AS base, count(DISTINCT CASE WHEN ts<TIMESTAMP '2024-01-30' AND ts>=TIMESTAMP '2024-01-23' THEN dn END) AS obs FROM dp GROUP BY 1),
 t AS (SELECT * FROM s ORDER BY volume DESC, name LIMIT 6), b AS (SELECT *, base/obs AS daily, (last24-base/obs)/(base/obs) AS dev FROM t WHERE obs>=5 AND base>=20 AND base/obs>=3),
 z AS (SELECT * FROM b WHERE abs(dev)>=0.4 ORDER BY abs(dev) DESC, volume DESC, name LIMIT 1) """


@plan("anomaly_24h", ANOM + "SELECT name AS metric, CASE WHEN dev<0 THEN 'warn' ELSE 'info' END AS severity, CAST(sign(dev)*round(abs(dev)*100) AS BIGINT) AS rate, base AS n, last24, round(daily,6) AS daily FROM z")
def _(c):
    return ins.anomaly(dipped(c), ASOF)


@plan("alert_anomaly", ANOM + "SELECT CAST(coalesce(max(sign(dev)*round(abs(dev)*100)),0) AS DOUBLE) AS value, count(*)>0 AS met FROM z WHERE dev<0")
def _(c):
    return ins.alert_anomaly(dipped(c), ASOF)


@plan("week_over_week", """WITH a AS (SELECT count(*) FILTER (WHERE ts>TIMESTAMP '2024-01-24') AS cur, count(*) FILTER (WHERE ts<=TIMESTAMP '2024-01-24' AND ts>TIMESTAMP '2024-01-17') AS prev FROM pev WHERE name='signup')
 SELECT 'signup' AS metric, CASE WHEN round((cur-prev)/prev*100)<=-15 THEN 'warn' ELSE 'info' END AS severity, CAST(round((cur-prev)/prev*100) AS BIGINT) AS rate, prev AS n, cur AS current FROM a""")
def _(c):
    return ins.week_over_week(c.prod, ASOF)


from eventloom.plans.sequences import CHAIN, H6, STEPS  # noqa: E402


@plan("worst_dropoff", CHAIN + """SELECT (['view','click'])[i] AS from_step, (['click','purchase'])[i] AS to_step, CAST(floor(u/p*100+0.5) AS BIGINT) AS rate, p AS n, p-u AS dropped FROM (SELECT i, ([c1,c2])[i] AS u, ([c0,c1])[i] AS p FROM c, range(1,3) t(i)) WHERE p>=20 ORDER BY dropped DESC, i LIMIT 1""")
def _(c):
    return ins.worst_dropoff(c.prod, STEPS, H6)


# Purchases by German visitors are renamed, so Germany converts far worse.
@plan("segment_blame", """WITH b AS (SELECT * REPLACE (CASE WHEN name='purchase' AND country='DE' AND k%10<>0 THEN 'other' ELSE name END AS name) FROM pev),
 s AS (SELECT distinct_id, us, id, name, min(us) FILTER (WHERE name='purchase') OVER (PARTITION BY distinct_id ORDER BY us,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p FROM b WHERE name IN ('view','purchase')),
 o AS (SELECT distinct_id, max(CASE WHEN p-us<=3600000000 THEN 2 ELSE 1 END) AS reached FROM s WHERE name='view' GROUP BY 1),
 t AS (SELECT distinct_id, arg_min(country,us) AS country, arg_min(device,us) AS device, arg_min(browser,us) AS browser, arg_min(plan,us) FILTER (WHERE plan IS NOT NULL) AS plan, arg_min(path,us) AS path, arg_min(split_part(replace(replace(referrer,'https://',''),'www.',''),'/',1),us) FILTER (WHERE referrer IS NOT NULL) AS referrer FROM b GROUP BY 1),
 kv AS (SELECT distinct_id, 'plan' AS prop, 2 AS p, plan AS value FROM t UNION ALL SELECT distinct_id,'device',4,device FROM t UNION ALL SELECT distinct_id,'country',6,country FROM t UNION ALL SELECT distinct_id,'browser',7,browser FROM t UNION ALL SELECT distinct_id,'path',99,path FROM t UNION ALL SELECT distinct_id,'referrer',99,referrer FROM t),
 g AS (SELECT prop, p, value, count(*) AS n, count(*) FILTER (WHERE reached=2)/count(*) AS r FROM kv JOIN o USING (distinct_id) WHERE value IS NOT NULL GROUP BY 1,2,3), a AS (SELECT count(*) FILTER (WHERE reached=2)/count(*) AS ov FROM o)
 SELECT prop, value, CAST(floor(r*100+0.5) AS BIGINT) AS rate, n, CAST(floor(ov*100+0.5) AS BIGINT) AS overall FROM g, a WHERE n>=20 AND r<0.7*ov ORDER BY r, p, prop, n DESC, value LIMIT 1""")
def _(c):
    d = c.prod.withColumn("name", F.when((F.col("name") == "purchase") & (F.col("country") == "DE") & (F.col("k") % 10 != 0), "other").otherwise(F.col("name")))
    return ins.segment_blame(d.select("id", "name", "distinct_id", "timestamp", "path", "country", "device", "browser", "referrer", "plan"), ["view", "purchase"], 0, 3600)


@plan("notable_findings")
def _(c):
    return ins.notable(dipped(c).drop("k", "uid", "eid", "amount"), ASOF)


@plan("fix_evidence")
def _(c):
    return ins.fix_evidence(c.web, ["$pageview", "$click", "purchase"], ASOF)
