from pyspark.sql import functions as F

from eventloom.operators import cohorts, funnel as fn, journeys, paths, retention as rt, sessions as se
from eventloom.operators.filters import Filter
from eventloom.plans.inputs import ASOF
from eventloom.plans.registry import plan

STEPS = ["view", "click", "purchase"]
H6 = 6 * 3600

# Greedy ordered chain in SQL: next row of step i+1 after each row, anchors kept at view.
CHAIN = """WITH s AS (SELECT distinct_id, us, id, name, CASE name WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS r
  FROM pev WHERE name IN ('view','click','purchase')),
 a AS (SELECT *, min(CASE WHEN name='purchase' THEN us END) OVER w AS p FROM s
   WINDOW w AS (PARTITION BY distinct_id ORDER BY us,r,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT *, arg_min(p, us) FILTER (WHERE name='click') OVER w AS cp, min(us) FILTER (WHERE name='click') OVER w AS c FROM a
   WINDOW w AS (PARTITION BY distinct_id ORDER BY us,r,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 anchors AS (SELECT distinct_id, us, c, cp, CASE WHEN c-us<=21600000000 THEN CASE WHEN cp-us<=21600000000 THEN 3 ELSE 2 END ELSE 1 END AS reached
   FROM b WHERE name='view'),
 o AS (SELECT distinct_id, max(reached) AS reached, arg_min(cp-us, us) FILTER (WHERE reached=3) AS dur FROM anchors GROUP BY 1),
 c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE reached>1) AS c1, count(*) FILTER (WHERE reached>2) AS c2 FROM o)"""
STEP_ROWS = """SELECT CAST(i AS BIGINT) AS step, (['view','click','purchase'])[i] AS event, u AS users,
  round(u/c0,6) AS from_top, round(CASE WHEN p>0 THEN u/p ELSE 0 END,6) AS from_prev, p-u AS dropped
 FROM (SELECT i, c0, ([c0,c1,c2])[i] AS u, ([c0,c0,c1])[i] AS p FROM c, range(1,4) t(i))"""


@plan("funnel_ordered", CHAIN + STEP_ROWS)
def _(c):
    return fn.funnel(c.prod, STEPS, H6)


@plan("funnel_timing", CHAIN + """SELECT count(*) AS converted, round(median(dur/1e6),6) AS median_secs,
  round(quantile_disc(dur/1e6,0.25),6) AS p25_secs, round(quantile_disc(dur/1e6,0.75),6) AS p75_secs,
  round(quantile_disc(dur/1e6,0.9),6) AS p90_secs, count(*)<5 AS anecdote FROM o WHERE reached=3""")
def _(c):
    return fn.funnel_timing(c.prod, STEPS, H6)


# ---- funnel variants -------------------------------------------------------------------------
@plan("funnel_strict", """WITH s AS (SELECT distinct_id, us, name, lead(name,1) OVER w AS n1, lead(us,1) OVER w AS t1,
  lead(name,2) OVER w AS n2, lead(us,2) OVER w AS t2 FROM pev WINDOW w AS (PARTITION BY distinct_id ORDER BY us,id)),
 o AS (SELECT distinct_id, max(CASE WHEN n1='click' AND t1-us<=21600000000 THEN CASE WHEN n2='purchase' AND t2-us<=21600000000
   THEN 3 ELSE 2 END ELSE 1 END) AS reached FROM s WHERE name='view' GROUP BY 1),
 c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE reached>1) AS c1, count(*) FILTER (WHERE reached>2) AS c2 FROM o)""" + STEP_ROWS)
def _(c):
    return fn.funnel(c.prod, STEPS, H6, order="strict")


@plan("funnel_unordered", """WITH s AS (SELECT distinct_id, us, id, name,
   CASE WHEN name='view' THEN us ELSE min(us) FILTER (WHERE name='view') OVER w END AS t0,
   CASE WHEN name='click' THEN us ELSE min(us) FILTER (WHERE name='click') OVER w END AS t1,
   CASE WHEN name='purchase' THEN us ELSE min(us) FILTER (WHERE name='purchase') OVER w END AS t2
   FROM pev WHERE name IN ('view','click','purchase')
   WINDOW w AS (PARTITION BY distinct_id ORDER BY us,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 o AS (SELECT distinct_id, max(CASE WHEN NOT coalesce(t0-us<=21600000000,false) THEN 0 WHEN NOT coalesce(t1-us<=21600000000,false)
   THEN 1 WHEN NOT coalesce(t2-us<=21600000000,false) THEN 2 ELSE 3 END) AS reached FROM s GROUP BY 1 HAVING reached>0),
 c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE reached>1) AS c1, count(*) FILTER (WHERE reached>2) AS c2 FROM o)""" + STEP_ROWS)
def _(c):
    return fn.funnel(c.prod, STEPS, H6, order="unordered")


@plan("funnel_exclusions", """WITH s AS (SELECT distinct_id, us, id, name, CASE name WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS r
  FROM pev WHERE name IN ('view','click','purchase','error')),
 a AS (SELECT *, min(us) FILTER (WHERE name='purchase') OVER w AS p, min(us) FILTER (WHERE name='error') OVER w AS nx FROM s
   WINDOW w AS (PARTITION BY distinct_id ORDER BY us,r,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT *, arg_min(p, us) FILTER (WHERE name='click') OVER w AS cp, min(us) FILTER (WHERE name='click') OVER w AS c FROM a
   WINDOW w AS (PARTITION BY distinct_id ORDER BY us,r,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 anchors AS (SELECT distinct_id, us, cp, nx, CASE WHEN c-us<=21600000000 THEN CASE WHEN cp-us<=21600000000 THEN 3 ELSE 2 END ELSE 1 END AS reached
   FROM b WHERE name='view'),
 o AS (SELECT distinct_id, max(reached) AS reached FROM anchors
   WHERE NOT coalesce(CASE WHEN reached=3 THEN nx<=cp ELSE nx-us<=21600000000 END, false) GROUP BY 1),
 c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE reached>1) AS c1, count(*) FILTER (WHERE reached>2) AS c2 FROM o)""" + STEP_ROWS)
def _(c):
    return fn.funnel(c.prod, STEPS, H6, exclude=["error"])


@plan("funnel_step_filters", CHAIN.replace(
    "FROM pev WHERE name IN ('view','click','purchase')",
    "FROM pev WHERE (name='view' AND device='mobile') OR name='click' OR (name='purchase' AND plan='pro')") + STEP_ROWS)
def _(c):
    return fn.funnel(c.prod, [fn.Step("view", {"device": "mobile"}), "click", fn.Step("purchase", {"plan": "pro"})], H6)


@plan("funnel_breakdown", CHAIN.rsplit(",\n c AS", 1)[0] + """,
 seg AS (SELECT distinct_id, arg_min(browser, us) AS segment FROM pev WHERE name='view' GROUP BY 1),
 c AS (SELECT segment, count(*) AS c0, count(*) FILTER (WHERE reached>1) AS c1, count(*) FILTER (WHERE reached>2) AS c2 FROM o JOIN seg USING (distinct_id) GROUP BY 1)
 SELECT segment, CAST(i AS BIGINT) AS step, (['view','click','purchase'])[i] AS event, u AS users,
  round(u/c0,6) AS from_top, round(CASE WHEN p>0 THEN u/p ELSE 0 END,6) AS from_prev, p-u AS dropped
 FROM (SELECT segment, i, c0, ([c0,c1,c2])[i] AS u, ([c0,c0,c1])[i] AS p FROM c, range(1,4) t(i))""")
def _(c):
    return fn.funnel_breakdown(c.prod, STEPS, "browser", H6, limit=10)


@plan("funnel_users", CHAIN + "SELECT distinct_id, CAST(reached AS BIGINT) AS reached, reached=3 AS converted FROM o")
def _(c):
    return fn.outcomes(c.prod, STEPS, H6).drop("dur_us")


@plan("funnel_users_dropped", CHAIN + "SELECT distinct_id, CAST(reached AS BIGINT) AS reached, false AS converted FROM o WHERE reached=2")
def _(c):
    return fn.users_at(c.prod, STEPS, 2, "dropped", H6)


# ---- retention -------------------------------------------------------------------------------
def _grid_sql(bs: int, m: int, where: str = "", rolling: bool = False) -> str:
    cells = (f"SELECT first, n, count(*) AS c FROM (SELECT first, unnest(range(0, least(last-first,{m})+1)) AS n FROM "
             f"(SELECT distinct_id, min(p) AS first, max(p) AS last FROM act GROUP BY 1)) GROUP BY 1,2" if rolling else
             f"SELECT first, p-first AS n, count(*) AS c FROM (SELECT distinct_id, p, min(p) OVER (PARTITION BY distinct_id) AS first FROM act) WHERE p-first<={m} GROUP BY 1,2")
    return f"""WITH act AS (SELECT DISTINCT distinct_id, CAST(floor(epoch_us(ts)/{bs}000000.0) AS BIGINT) AS p FROM pev {where}),
 cells AS ({cells}), g AS (SELECT strftime(make_timestamp(first*{bs}000000),'%Y-%m-%d') AS cohort, first AS cohort_num, t.n,
  coalesce(c.c,0) AS returned, z.c AS size FROM (SELECT DISTINCT first FROM cells) f CROSS JOIN (SELECT unnest(range(0,{m}+1)) AS n) t
  LEFT JOIN cells c USING (first, n) LEFT JOIN (SELECT first, c FROM cells WHERE n=0) z USING (first)) """


@plan("retention_grid", _grid_sql(7 * 86400, 4) + "SELECT * FROM g")
def _(c):
    return rt.grid(c.prod, 4, bucket="week")


@plan("retention_rolling", _grid_sql(86400, 14, rolling=True) + "SELECT * FROM g")
def _(c):
    return rt.grid(c.prod, 14, rolling=True)


@plan("retention_event_filter", _grid_sql(86400, 14, "WHERE name='purchase'") + "SELECT * FROM g")
def _(c):
    return rt.grid(c.prod, 14, event="purchase")


@plan("retention_observable", _grid_sql(86400, 30) + """SELECT cohort, cohort_num, n, size,
  CASE WHEN n<=0 OR cohort_num+n < epoch(TIMESTAMP '2024-01-31')//86400 THEN CAST(returned AS DOUBLE) END AS returned FROM g""")
def _(c):
    return rt.observable(rt.grid(c.prod, 30), ASOF)


@plan("retention_summary", _grid_sql(86400, 30) + """SELECT n, CAST(sum(returned) AS BIGINT) AS retained, CAST(sum(size) AS BIGINT) AS cohort_users,
  CAST(floor(sum(returned)/sum(size)*100+0.5) AS BIGINT) AS pct FROM g WHERE n IN (1,7,30) AND cohort_num+n < 19753 GROUP BY 1""")
def _(c):
    return rt.summary(c.prod, ASOF)


# ---- paths, sessions, journeys ---------------------------------------------------------------
@plan("paths_after", """WITH st AS (SELECT distinct_id, min(us) AS s FROM pev WHERE name='signup' GROUP BY 1),
 nx AS (SELECT e.name AS step, row_number() OVER (PARTITION BY distinct_id ORDER BY us,id) AS depth FROM pev e JOIN st USING (distinct_id) WHERE us>s)
 SELECT depth, step, count(*) AS users, (SELECT count(*) FROM st) AS start_users FROM nx WHERE depth<=3 GROUP BY 1,2""")
def _(c):
    return paths.after(c.prod, "signup", 3)


@plan("paths_pages", """WITH pv AS (SELECT distinct_id, us, id, path FROM web WHERE name='$pageview'),
 st AS (SELECT distinct_id, min(us) AS s FROM pv WHERE path='/p1' GROUP BY 1),
 mv AS (SELECT distinct_id, us, id, path, lag(path) OVER (PARTITION BY distinct_id ORDER BY us,id) AS prev FROM pv JOIN st USING (distinct_id) WHERE us>=s),
 nx AS (SELECT path AS step, row_number() OVER (PARTITION BY distinct_id ORDER BY us,id) AS depth FROM mv WHERE prev IS NOT NULL AND path<>prev)
 SELECT depth, step, count(*) AS users, (SELECT count(*) FROM st) AS start_users FROM nx WHERE depth<=4 GROUP BY 1,2""", base="web")
def _(c):
    return paths.pages(c.web, "/p1", 4)


SESS = """WITH f AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS o FROM {t} WINDOW w AS (PARTITION BY distinct_id ORDER BY us,id)),
 n AS (SELECT *, sum(o) OVER (PARTITION BY distinct_id ORDER BY us,id) AS sid FROM f),
 ss AS (SELECT distinct_id, min(us) AS start_us, max(us) AS end_us, (max(us)-min(us))//1000000 AS duration_s, count(*) AS events,
  count(DISTINCT path) AS pages, count(*) FILTER (WHERE name='$rageclick') AS rage_clicks, arg_min(path,us) AS entry_path, arg_max(path,us) AS exit_path
  FROM n GROUP BY distinct_id, sid) """


@plan("sessions", SESS.format(t="web") + "SELECT * FROM ss", base="web")
def _(c):
    return se.sessions(c.web)


@plan("sessions_recent", SESS.format(t="web") + "SELECT * FROM ss ORDER BY start_us DESC, distinct_id LIMIT 100", base="web")
def _(c):
    return se.recent(c.web, limit=100)


@plan("session_timeline", SESS.format(t="web") + """, pick AS (SELECT min(us) AS m FROM n WHERE distinct_id='u7'), cur AS (SELECT sid FROM n, pick WHERE distinct_id='u7' AND us=m)
 SELECT (us-m)//1000 AS t_ms, name, path, x, y, CAST(vw AS BIGINT) AS vw, '' AS text FROM n, pick, cur WHERE distinct_id='u7' AND n.sid=cur.sid""", base="web")
def _(c):
    start = c.web.where("distinct_id = 'u7'").agg(F.min(F.unix_seconds("timestamp"))).first()[0]
    return se.timeline(c.web, "u7", start)


@plan("journey_detect", """WITH f AS (SELECT distinct_id, name, min(us) AS us FROM pev GROUP BY 1,2), s AS (SELECT distinct_id, min(us) AS us0 FROM pev GROUP BY 1),
 o AS (SELECT name, (us-us0)/1e6 AS secs, row_number() OVER (PARTITION BY name ORDER BY us-us0) AS rn, count(*) OVER (PARTITION BY name) AS n FROM f JOIN s USING (distinct_id)),
 c AS (SELECT name AS event, n AS coverage, round(secs,6) AS median_secs FROM o WHERE rn=n//2+1 AND n>=greatest(3,(SELECT count(*)//20 FROM s)) ORDER BY n DESC, name LIMIT 4)
 SELECT row_number() OVER (ORDER BY median_secs, coverage DESC, event) AS step, * FROM c""")
def _(c):
    return journeys.detect(c.prod)


@plan("propose_page_funnel", """WITH f AS (SELECT distinct_id, path, min(us//1000000) AS t FROM web WHERE name='$pageview' GROUP BY 1,2),
 n AS (SELECT path, count(*) AS n FROM f GROUP BY 1), e AS (SELECT path FROM n ORDER BY n DESC, path LIMIT 1),
 r AS (SELECT a.distinct_id, a.t AS ta, b.t AS tb FROM f a LEFT JOIN f b ON a.distinct_id=b.distinct_id AND b.path='/checkout' WHERE a.path=(SELECT path FROM e)),
 k AS (SELECT count(*) AS n0, count(*) FILTER (WHERE tb>=ta) AS n2 FROM r)
 SELECT CAST(i AS BIGINT) AS step, CASE i WHEN 1 THEN (SELECT path FROM e) ELSE '/checkout' END AS path, CASE i WHEN 1 THEN n0 ELSE n2 END AS people,
  n2<n0 AND n2*4<=n0 AND n2>=5 AS confident FROM k, range(1,3) t(i) WHERE (SELECT path FROM e)<>'/checkout'""", base="web")
def _(c):
    return journeys.propose_page_funnel(c.web)


# ---- cohorts ---------------------------------------------------------------------------------
@plan("cohort_membership", """SELECT distinct_id FROM pev WHERE name IN ('signup','purchase') AND amount>150 GROUP BY 1 HAVING count(DISTINCT name)=2""")
def _(c):
    return cohorts.membership(c.events, ["signup", "purchase"], "all", [Filter("amount", "gt", 150)])


COHORT_SEQ = """WITH s AS (SELECT * FROM pev WHERE name IN ('signup','view','purchase','error')),
 a AS (SELECT *, min(us) FILTER (WHERE name='purchase') OVER w AS p, min(us) FILTER (WHERE name='error') OVER w AS nx FROM s
   WINDOW w AS (PARTITION BY distinct_id ORDER BY us,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT *, arg_min(p, us) FILTER (WHERE name='view') OVER w AS last FROM a
   WINDOW w AS (PARTITION BY distinct_id ORDER BY us,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 f AS (SELECT distinct_id, min(us) AS f0, count(*) FILTER (WHERE name='purchase') AS np FROM pev GROUP BY 1),
 m AS (SELECT DISTINCT distinct_id FROM b JOIN f USING (distinct_id) WHERE name='signup' AND last-us<=172800000000 AND last-f0<=1728000000000
   AND coalesce(nx>last,true) AND np>=2) """


def _seq(c):
    return cohorts.sequence(c.events, ["signup", "view", cohorts.SequenceStep("purchase", count=2)], within_ms=172_800_000,
                            within_first_ms=1_728_000_000, exclude=["error"])


@plan("cohort_sequence", COHORT_SEQ + "SELECT * FROM m")
def _(c):
    return _seq(c)


@plan("cohort_filter", COHORT_SEQ + "SELECT name, count(*) AS events, count(DISTINCT distinct_id) AS users FROM pev SEMI JOIN m USING (distinct_id) GROUP BY 1")
def _(c):
    return (cohorts.keep_members(c.prod, _seq(c)).groupBy("name")
            .agg(F.count("*").alias("events"), F.count_distinct("distinct_id").alias("users")))
