from pyspark.sql import functions as F

from eventloom.operators import goals as gl, search, web
from eventloom.plans.inputs import ASOF
from eventloom.plans.registry import plan
from eventloom.plans.population import CHANNEL

S, E = web.calendar_days(14, "2024-01-30 12:00:00")
HOST = r"coalesce(nullif(regexp_replace(split_part(regexp_replace(referrer,'^https://',''),'/',1),'^www\.',''),''),'direct')"
PV = f"WITH pv AS (SELECT *, {HOST} AS host FROM web WHERE name='$pageview' AND ts>=TIMESTAMP '{S}' AND ts<TIMESTAMP '{E}')"


@plan("web_overview", PV + "SELECT count(*) AS pageviews, count(DISTINCT distinct_id) AS visitors, CAST(14 AS BIGINT) AS period_days FROM pv", base="web")
def _(c):
    return web.overview(c.web, S, E)


@plan("web_top_pages", PV + """SELECT path AS value, count(*) AS count, count(DISTINCT distinct_id) AS visitors FROM pv GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", base="web")
def _(c):
    return web.top(c.web, "path", S, E)


@plan("web_top_titles", PV + """SELECT 'Title of '||path||' '||browser AS value, count(*) AS count, count(DISTINCT distinct_id) AS visitors FROM pv GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", base="web")
def _(c):
    return web.top(c.web.withColumn("title", F.concat(F.lit("Title of "), "path", F.lit(" "), "browser")), "title", S, E)


FIRST = PV + """, f AS (SELECT distinct_id, arg_min(struct_pack(r:=host,u:=utm_source,d:=device,b:=browser,c:=country), us) AS x FROM pv GROUP BY 1),
 dims AS (SELECT distinct_id, 'referrer' AS dim, x.r AS value FROM f UNION ALL SELECT distinct_id,'utm_source',x.u FROM f UNION ALL SELECT distinct_id,'device',x.d FROM f
  UNION ALL SELECT distinct_id,'browser',x.b FROM f UNION ALL SELECT distinct_id,'country',x.c FROM f) """


@plan("web_first_touch_dims", FIRST + """SELECT dim, value, count(*) AS visitors, (SELECT count(*) FROM dims e WHERE e.dim=dims.dim AND value IS NOT NULL) AS recorded
 FROM dims WHERE value IS NOT NULL GROUP BY 1,2""", base="web")
def _(c):
    return web.first_touch_dims(c.web, S, E)


@plan("web_entry_exit_pages", PV + """, s AS (SELECT distinct_id||d AS s, any_value(distinct_id) AS u, arg_min(path,us) AS a, arg_max(path,us) AS b FROM pv GROUP BY 1),
 x AS (SELECT 'entry' AS dim, a AS value, u FROM s UNION ALL SELECT 'exit', b, u FROM s)
 SELECT dim, value, count(*) AS sessions, count(DISTINCT u) AS visitors, (SELECT count(*) FROM s) AS recorded FROM x GROUP BY 1,2""", base="web")
def _(c):
    return web.entry_exit(c.web, S, E)


@plan("web_recorded_totals", FIRST + """SELECT d.dim, coalesce(n,0) AS recorded FROM (VALUES ('referrer'),('utm_source'),('utm_medium'),('utm_campaign'),('device'),('browser'),('os'),('country'),('path'),('title')) d(dim)
 LEFT JOIN (SELECT dim, count(*) AS n FROM dims WHERE value IS NOT NULL GROUP BY 1 UNION ALL SELECT 'path', count(*) FROM pv) USING (dim)""", base="web")
def _(c):
    return web.recorded_totals(c.web, S, E)


@plan("web_engagement", f"""WITH w AS (SELECT * FROM web WHERE ts>=TIMESTAMP '{S}' AND ts<TIMESTAMP '{E}'),
 u AS (SELECT distinct_id, sum(CASE WHEN name='signup' AND amount>0 THEN amount*100 END) AS ms, count(*) FILTER (WHERE name='$pageview' AND path='/p3') AS pv
   FROM w WHERE name='signup' OR (name='$pageview' AND path='/p3') GROUP BY 1)
 SELECT CAST(floor(sum(ms)/count(ms)/1000) AS BIGINT) AS avg_engaged_secs,
  CAST(floor(count(*) FILTER (WHERE pv=1 AND coalesce(ms,0)<10000)/count(*) FILTER (WHERE pv>0)*100+0.5) AS BIGINT) AS bounce_rate_pct FROM u""", base="web")
def _(c):
    # signups stand in for engagement pings; only /p3 views count as pageviews here, so single-view visitors exist
    d = c.web.withColumn("name", F.when((F.col("name") == "$pageview") & ~F.coalesce(F.col("path") == "/p3", F.lit(False)), "other_view").otherwise(F.col("name"))).withColumn("engaged_ms", F.when(F.col("name") == "signup", F.col("amount") * 100))
    return web.engagement(d.withColumn("name", F.when(F.col("name") == "signup", "$engagement").otherwise(F.col("name"))), S, E)


@plan("web_live_now", """SELECT count(DISTINCT distinct_id) AS live FROM web WHERE name='$pageview' AND ts>=(SELECT max(ts) FROM web) - INTERVAL 5 MINUTE""", base="web")
def _(c):
    last = c.web.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return web.live_now(c.web, last)


@plan("ai_referral_visitors", FIRST + "SELECT value, count(*) AS visitors FROM dims WHERE dim='referrer' AND value='chatgpt.com' GROUP BY 1", base="web")
def _(c):
    return web.ai_referrals(c.web, S, E)


@plan("channel_conversion", f"""WITH f AS (SELECT distinct_id, arg_min({CHANNEL}, us) AS channel, max(CASE WHEN name='signup' AND k<4 THEN 1 ELSE 0 END) AS conv FROM web GROUP BY 1),
 g AS (SELECT channel, count(*) AS users, CAST(sum(conv) AS BIGINT) AS converted FROM f GROUP BY 1)
 SELECT *, round(converted/users,6) AS rate, channel=(SELECT channel FROM g ORDER BY converted/users DESC, users DESC, channel DESC LIMIT 1) AS best FROM g""", base="web")
def _(c):
    d = c.web.withColumn("name", F.when((F.col("name") == "signup") & (F.col("k") < 4), "trial_signup").otherwise(F.col("name"))).drop("source")
    return web.channel_conversion(d, "trial_signup")


@plan("geo_breakdown", """SELECT CASE WHEN country IN ('ZZ','XX') THEN '(unresolved)' ELSE country END AS country, count(DISTINCT distinct_id) AS visitors, count(*) AS views FROM web WHERE name='$pageview' GROUP BY 1""", base="web")
def _(c):
    return web.geo(c.web)


@plan("page_stats", "SELECT count(*) AS pageviews, count(DISTINCT distinct_id) AS visitors FROM web WHERE name='$pageview' AND path='/checkout'", base="web")
def _(c):
    return web.page_stats(c.web, "/checkout")


GOALS = [gl.Goal("bought", "event", "purchase"), gl.Goal("reached checkout", "path", "/check*")]
G_SQL = f"""WITH p AS (SELECT distinct_id, arg_min({HOST}, us) AS ref, arg_min(struct_pack(u:=utm_source), us).u AS utm,
  max(CASE WHEN name='purchase' THEN 1 ELSE 0 END) AS a, max(CASE WHEN name='$pageview' AND path='/checkout' THEN 1 ELSE 0 END) AS b
  FROM web WHERE ts>=TIMESTAMP '2024-01-24' AND ts<=TIMESTAMP '2024-01-31' GROUP BY 1), """


@plan("goal_report", G_SQL + """r AS (SELECT 'bought' AS goal, sum(a) AS n FROM p UNION ALL SELECT 'reached checkout', sum(b) FROM p)
 SELECT goal, CAST(n AS BIGINT) AS conversions, (SELECT count(*) FROM p) AS visitors, CAST(floor(n/(SELECT count(*) FROM p)*100+0.5) AS BIGINT) AS conversion_pct FROM r""", base="web")
def _(c):
    return gl.report(c.web, GOALS, ASOF, 7)


@plan("goal_attribution", G_SQL + """r AS (SELECT 'bought' AS goal, ref, utm FROM p WHERE a=1 UNION ALL SELECT 'reached checkout', ref, utm FROM p WHERE b=1)
 SELECT goal, 'referrer' AS dim, ref AS value, count(*) AS users FROM r GROUP BY ALL UNION ALL SELECT goal, 'utm_source', utm, count(*) FROM r WHERE utm IS NOT NULL GROUP BY ALL""", base="web")
def _(c):
    return gl.attribution(c.web, GOALS, ASOF, 7)


@plan("heatmap", """WITH g AS (SELECT (y+sy)//20 AS row, least(x*40//vw,39) AS col, count(*) AS n FROM web WHERE name='$click' AND path='/p1' GROUP BY 1,2)
 SELECT *, (SELECT CAST(sum(n) AS BIGINT) FROM g) AS clicks, (SELECT max(n) FROM g) AS hottest, (SELECT max(row) FROM g) AS max_row FROM g""", base="web")
def _(c):
    return gl.heatmap(c.web, "/p1")


@plan("heatmap_targets", "SELECT 'button#b'||(k%16) AS label, count(*) AS n FROM web WHERE name='$click' AND path='/p1' AND vw>1024 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", base="web")
def _(c):
    d = c.web.drop("id").withColumn("id", F.concat(F.lit("b"), F.col("k") % 16)).withColumn("tag", F.lit("button"))
    return gl.heatmap_targets(d, "/p1", "desktop")


# ---- search console: one row per (query, page) from views (impressions) and clicks --------------------
def search_rows(c, keys, late=None):
    d = c.web.where(F.col("name").isin("$pageview", "$click"))
    if late is not None:
        d = d.where((F.col("timestamp") >= "2024-01-16") if late else (F.col("timestamp") < "2024-01-16"))
    d = d.withColumn("query", F.concat(F.lit("q"), F.col("uid") % 25)).withColumn("page", F.col("path"))
    return d.groupBy(*keys).agg((F.count(F.when(F.col("name") == "$pageview", 1)) * 20).alias("impressions"),
                                F.count(F.when((F.col("name") == "$click") & (F.col("k") % 7 == 0), 1)).alias("clicks"),
                                (F.avg("amount") / 9).alias("position"))


def _rows_sql(keys, where="true"):
    return f"""(SELECT {keys}, count(*) FILTER (WHERE name='$pageview')*20 AS impressions, count(*) FILTER (WHERE name='$click' AND k%7=0) AS clicks, avg(amount)/9 AS position
 FROM (SELECT *, 'q'||(uid%25) AS query, path AS page FROM web) WHERE name IN ('$pageview','$click') AND {where} GROUP BY {keys})"""


@plan("search_movers", f"""SELECT query, clicks, clicks-coalesce(pc,0) AS delta FROM {_rows_sql('query', "ts>='2024-01-16'")} LEFT JOIN
 (SELECT query, clicks AS pc FROM {_rows_sql('query', "ts<'2024-01-16'")}) USING (query) WHERE clicks-coalesce(pc,0)<>0 ORDER BY abs(clicks-coalesce(pc,0)) DESC, query LIMIT 5""", base="web")
def _(c):
    return search.movers(search_rows(c, ["query"], True), search_rows(c, ["query"], False))


@plan("search_quick_wins", f"SELECT page, query, round(position,6) AS position, impressions, clicks FROM {_rows_sql('query, page')} WHERE position BETWEEN 4 AND 15 ORDER BY impressions DESC, page, query LIMIT 10", base="web")
def _(c):
    return search.quick_wins(search_rows(c, ["query", "page"]))


@plan("search_ctr_problems", f"""SELECT page, query, round(position,6) AS position, impressions, floor(clicks/impressions*100*10+0.5)/10 AS ctr_pct, CAST(e AS DOUBLE) AS expected_ctr_pct FROM
 (SELECT *, CASE WHEN position<=3 THEN 8 WHEN position<=6 THEN 4 WHEN position<=10 THEN 2 ELSE 1 END AS e FROM {_rows_sql('query, page')} WHERE impressions>=100)
 WHERE clicks/impressions*100 < e/2 ORDER BY impressions DESC, page, query LIMIT 10""", base="web")
def _(c):
    return search.ctr_problems(search_rows(c, ["query", "page"]))


@plan("search_cannibalization", f"""WITH r AS {_rows_sql('query, page')}, q AS (SELECT query, count(*) AS pages, CAST(sum(clicks) AS BIGINT) AS total_clicks FROM r WHERE clicks>0 GROUP BY 1 HAVING count(*)>=2 ORDER BY total_clicks DESC, query LIMIT 5)
 SELECT query, pages, total_clicks, page, clicks, round(position,6) AS position FROM r JOIN q USING (query) WHERE clicks>0""", base="web")
def _(c):
    return search.cannibalization(search_rows(c, ["query", "page"]))
