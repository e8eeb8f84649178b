from pyspark.sql import functions as F

from eventloom.operators import aicrawl as ac, aivis as av
from eventloom.plans.inputs import ASOF, pick
from eventloom.plans.registry import plan

# Clicks stand in for crawler fetches; a site scan rides on the latest signups.
CRAWL_SQL = """WITH cr AS (SELECT id, ts, us, d, (['GPTBot','ClaudeBot','PerplexityBot'])[k%3+1] AS crawler, (['OpenAI','Anthropic','Perplexity'])[k%3+1] AS operator,
   (['training','search','user'])[k%3+1] AS purpose, CASE WHEN k%17=0 THEN '/.env' WHEN k%8=7 THEN '/docs' ELSE path END AS path, k%11=0 AS bad FROM pev WHERE name='click'),
 w AS (SELECT *, path='/.env' AS probe FROM cr WHERE ts>=TIMESTAMP '2024-01-17' AND ts<=TIMESTAMP '2024-01-30 18:00:00'), g AS (SELECT * FROM w WHERE NOT probe) """
AS2 = "2024-01-30 18:00:00"


def crawl_events(c):
    k, n = F.col("k"), F.col("name")
    crawl, scan = n == "click", n == "signup"
    raw = F.when(crawl & (k % 17 == 0), "/.env").when(crawl & (k % 8 == 7), "https://site.example/docs/?q=1").when(crawl, F.concat("path", F.lit("?ref=x"))).otherwise(F.col("path"))
    return c.prod.select(
        "id", F.when(crawl, "$ai_crawl").when(scan, "$site_readable").when(n == "view", "$pageview").otherwise(n).alias("name"), "distinct_id", "timestamp",
        F.when(crawl, pick(["GPTBot", "ClaudeBot", "PerplexityBot"], k % 3)).alias("crawler"), F.when(crawl, pick(["OpenAI", "Anthropic", "Perplexity"], k % 3)).alias("operator"),
        F.when(crawl, pick(["training", "search", "user"], k % 3)).alias("purpose"), raw.alias("path"), F.when(crawl, F.when(k % 11 == 0, 404).otherwise(200)).alias("status"),
        F.when(scan, "/p5, /private").alias("robots_disallow"), F.when(scan, k % 2 == 0).alias("robots_blocks_ai"),
        F.when(scan, F.lit(False)).alias("renders_without_js"), F.when(scan, k * 3).alias("words_without_js"))


def _ua(k, kind):
    forms = ["Mozilla/5.0 (compatible; GPTBot/1.2)", "Mozilla/5.0 claude-searchbot/1.0 claudebot", "Mozilla/5.0 AppleWebKit Chrome/120",
             "Applebot-Extended applebot", "PERPLEXITYBOT/1.0"]
    return pick(forms, k % 5) if kind == "spark" else "([" + ",".join(f"'{x}'" for x in forms) + f"])[{k}%5+1]"


@plan("crawler_identify", """SELECT coalesce(x[1],'') AS crawler, coalesce(x[2],'') AS operator, coalesce(x[3],'') AS purpose, count(*) AS hits FROM
 (SELECT (CASE k%5 WHEN 0 THEN ['GPTBot','OpenAI','training'] WHEN 1 THEN ['Claude-SearchBot','Anthropic','search'] WHEN 3 THEN ['Applebot-Extended','Apple','training'] WHEN 4 THEN ['PerplexityBot','Perplexity','search'] END) AS x FROM pev) GROUP BY 1,2,3""")
def _(c):
    d = c.prod.withColumn("_c", ac.identify(_ua(F.col("k"), "spark")))
    txt = lambda f: F.coalesce(F.col(f"_c.{f}"), F.lit("")).alias(f)
    return d.groupBy(txt("crawler"), txt("operator"), txt("purpose")).agg(F.count("*").alias("hits"))


@plan("crawl_by_crawler", CRAWL_SQL + """SELECT crawler, any_value(operator) AS operator, any_value(purpose) AS purpose, count(*) AS hits, count(DISTINCT path) AS pages, count(*) FILTER (WHERE bad) AS errors, max(us) AS last_us, arg_max(path,us) AS last_path FROM g GROUP BY 1""")
def _(c):
    return ac.by_crawler(crawl_events(c), 14, AS2)


@plan("crawl_by_operator", CRAWL_SQL + """SELECT operator, count(*) AS hits, count(DISTINCT path) AS pages, count(*) FILTER (WHERE purpose='training') AS training, count(*) FILTER (WHERE purpose='search') AS search, count(*) FILTER (WHERE purpose='user') AS "user", max(us) AS last_us FROM g GROUP BY 1""")
def _(c):
    return ac.by_operator(crawl_events(c), 14, AS2)


@plan("crawl_by_path", CRAWL_SQL + "SELECT path, count(*) AS hits, count(DISTINCT crawler) AS crawlers, count(*) FILTER (WHERE bad) AS errors, max(us) AS last_us FROM g GROUP BY 1 ORDER BY hits DESC, path LIMIT 25")
def _(c):
    return ac.by_path(crawl_events(c), 14, AS2)


@plan("crawl_daily", CRAWL_SQL + """SELECT strftime(b,'%Y-%m-%d') AS day, count(g.id) AS hits, count(*) FILTER (WHERE purpose='training') AS training, count(*) FILTER (WHERE purpose='search') AS search, count(*) FILTER (WHERE purpose='user') AS "user"
 FROM range(TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(b) LEFT JOIN g ON g.d=strftime(b,'%Y-%m-%d') GROUP BY 1""")
def _(c):
    return ac.daily(crawl_events(c), 14, AS2)


@plan("crawl_totals", CRAWL_SQL + """SELECT count(*) FILTER (WHERE NOT probe) AS hits, count(*) FILTER (WHERE bad AND NOT probe) AS errors, count(*) FILTER (WHERE probe) AS probes, count(DISTINCT CASE WHEN NOT probe THEN path END) AS pages,
 count(*) FILTER (WHERE NOT probe AND purpose='training') AS training, count(*) FILTER (WHERE NOT probe AND purpose='search') AS search, count(*) FILTER (WHERE NOT probe AND purpose='user') AS "user" FROM w""")
def _(c):
    return ac.totals(crawl_events(c), 14, AS2)


# Gap pages: views get per-browser copies of two paths, one disallowed and one private copy.
def gap_events(c):
    return crawl_events(c).withColumn("path", F.when(F.col("name") == "$pageview", F.when(F.col("path").startswith("/p3"), "/guide/a/").when(
        F.col("path").startswith("/p4"), "/app/home").when(F.col("path").startswith("/p5"), "/p5/deep").otherwise(F.col("path"))).otherwise(F.col("path")))


@plan("crawl_gaps", CRAWL_SQL + """, pv AS (SELECT CASE path WHEN '/p3' THEN '/guide/a' WHEN '/p4' THEN '/app/home' WHEN '/p5' THEN '/p5/deep' ELSE path END AS path, distinct_id FROM pev WHERE name='view' AND ts>=TIMESTAMP '2024-01-17' AND ts<=TIMESTAMP '2024-01-30 18:00:00')
 SELECT path, count(*) AS views, count(DISTINCT distinct_id) AS visitors FROM pv WHERE path NOT IN (SELECT path FROM g) AND NOT starts_with(path,'/p5') AND NOT starts_with(path,'/private') AND NOT starts_with(path,'/app/') GROUP BY 1 HAVING count(DISTINCT distinct_id)>=2 ORDER BY views DESC, path LIMIT 25""")
def _(c):
    return ac.gaps(gap_events(c), 14, AS2)


@plan("crawl_findings", """WITH cr AS (SELECT *, (['GPTBot','ClaudeBot','BingBot'])[k%3+1] AS crawler, k%3=1 AND k%2=0 AS bad, CASE WHEN k%8=7 THEN '/docs' ELSE path END AS p2 FROM pev WHERE name='click' AND k%17<>0 AND (k%3<>0 OR ts<TIMESTAMP '2024-01-20') AND ts>=TIMESTAMP '2024-01-01' AND ts<=TIMESTAMP '2024-01-30 18:00:00'),
 c AS (SELECT crawler, count(*) AS hits, count(*) FILTER (WHERE bad) AS errors, max(us) AS last_us FROM cr GROUP BY 1),
 pv AS (SELECT CASE path WHEN '/p3' THEN '/guide/a' WHEN '/p4' THEN '/app/home' WHEN '/p5' THEN '/p5/deep' ELSE path END AS path, count(*) AS views, count(DISTINCT distinct_id) AS u FROM pev WHERE name='view' AND ts<=TIMESTAMP '2024-01-30 18:00:00' GROUP BY 1)
 SELECT 'crawl_errors' AS kind, 'warn' AS severity, crawler AS subject, CAST(floor(errors/hits*100+0.5) AS BIGINT) AS rate, hits AS n FROM c WHERE hits>=12 AND floor(errors/hits*100+0.5)>=30
 UNION ALL SELECT 'crawl_stopped','warn',crawler,(epoch_us(TIMESTAMP '2024-01-30 18:00:00')-last_us)//86400000000,hits FROM c WHERE hits>=12 AND (epoch_us(TIMESTAMP '2024-01-30 18:00:00')-last_us)//86400000000>=7
 UNION ALL SELECT 'crawl_absent','info','Perplexity',0,CAST(sum(hits) AS BIGINT) FROM c
 UNION ALL (SELECT 'crawl_gap','info',path,views,(SELECT count(DISTINCT p2) FROM cr) FROM pv WHERE path NOT IN (SELECT p2 FROM cr) AND path NOT IN ('/app/home','/p5/deep') AND u>=2 AND views>=20 ORDER BY views DESC, path LIMIT 1)""")
def _(c):
    # one crawler is refused often, one goes silent on the 20th, Perplexity never comes
    e = gap_events(c).join(c.prod.select("id", "k"), "id")
    e = e.withColumn("name", F.when(F.expr("name = '$ai_crawl' and k % 3 = 0 and timestamp >= '2024-01-20'"), "other_visit").otherwise(F.col("name")))
    crawl = F.col("name") == "$ai_crawl"
    e = (e.withColumn("crawler", F.when(crawl, pick(["GPTBot", "ClaudeBot", "BingBot"], F.col("k") % 3)))
         .withColumn("operator", F.when(crawl, pick(["OpenAI", "Anthropic", "Microsoft"], F.col("k") % 3)))
         .withColumn("status", F.when(crawl, F.when((F.col("k") % 3 == 1) & (F.col("k") % 2 == 0), 403).otherwise(200))))
    return ac.findings(e, AS2)


@plan("site_readability", """SELECT CASE WHEN k%2=0 THEN 'robots' ELSE 'render' END AS metric, 'warn' AS severity, CASE WHEN k%2=0 THEN 0 ELSE k*3 END AS words FROM pev WHERE name='signup' AND us=(SELECT max(us) FROM pev WHERE name='signup')""")
def _(c):
    return ac.site_readability(crawl_events(c), ASOF)


# ---- AI visibility ------------------------------------------------------------------------------------
GEO = """WITH ck AS (SELECT *, (['chatgpt','claude-grounded','gemini'])[k%3+1] AS engine, 'p'||(k%4) AS prompt, k<40 AS mentioned, k<15 AS recommended, k%6 AS rank,
   'v'||eid AS verbatim, 'm'||(uid%2) AS model, 'b'||(k%12)||', c'||(uid%5) AS competitors, (['positive','neutral','negative','absent','odd'])[k%5+1] AS sentiment, k%5=0 AS cited,
   strftime(date_trunc('week',ts),'%Y-%m-%d') AS week FROM pev WHERE name='view') """
_PCT = "CAST(floor(count(*) FILTER (WHERE mentioned)/count(*)*100+0.5) AS BIGINT) AS mentioned_pct, CAST(floor(count(*) FILTER (WHERE recommended)/count(*)*100+0.5) AS BIGINT) AS recommended_pct"
_RATE = f"count(*) AS runs, count(*) FILTER (WHERE mentioned) AS mentioned, count(*) FILTER (WHERE recommended) AS recommended, {_PCT}"


def geo_checks(c, mentioned=None):
    k, u = F.col("k"), F.col("uid")
    check = F.col("name") == "view"
    on = lambda x: F.when(check, x)
    return c.prod.select(
        "id", on(F.lit("$geo_check")).otherwise(F.when(F.col("name") == "click", "$ai_crawl").otherwise(F.col("name"))).alias("name"), "distinct_id", "timestamp",
        on(pick(["chatgpt", "claude-grounded", "gemini"], k % 3)).alias("engine"), on(F.concat(F.lit("p"), k % 4)).alias("prompt"),
        on(k < 40 if mentioned is None else mentioned).alias("mentioned"), on(k < 15).alias("recommended"), on(k % 6).alias("rank"),
        on(F.concat(F.lit("v"), "eid")).alias("verbatim"), on(F.concat(F.lit("m"), u % 2)).alias("model_version"),
        on(F.concat(F.lit("b"), k % 12, F.lit(", c"), u % 5)).alias("competitors"),
        on(pick(["positive", "neutral", "negative", "absent", "odd"], k % 5)).alias("sentiment"), on(k % 5 == 0).alias("cited_domain"))


@plan("aivis_engines", GEO + f"""SELECT engine, {_RATE}, count(*) FILTER (WHERE rank>=1) AS ranked, floor(avg(rank) FILTER (WHERE rank>=1)*10+0.5)/10 AS avg_rank,
 arg_max(verbatim,us) AS latest_verbatim, arg_max(model,us) AS latest_model FROM ck GROUP BY 1""")
def _(c):
    return av.engines(geo_checks(c), 90, ASOF)


@plan("aivis_prompts", GEO + f"SELECT prompt, {_RATE} FROM ck GROUP BY 1")
def _(c):
    return av.prompts(geo_checks(c), 90, ASOF)


@plan("aivis_trend", GEO + f"SELECT week, {_RATE} FROM ck GROUP BY 1")
def _(c):
    return av.trend(geo_checks(c), 90, ASOF)


@plan("aivis_share_of_voice", GEO + """, m AS (SELECT 'you' AS brand, week FROM ck WHERE mentioned UNION ALL SELECT 'b'||(k%12), week FROM ck UNION ALL SELECT 'c'||(uid%5), week FROM ck),
 b AS (SELECT brand, count(*) AS total, CAST(floor(count(*)/(SELECT count(*) FROM m)*100+0.5) AS BIGINT) AS share, row_number() OVER (ORDER BY brand='you' DESC, count(*) DESC, brand) AS r FROM m GROUP BY 1),
 l AS (SELECT *, CASE WHEN r<=8 OR (SELECT count(*) FROM b)<=9 THEN brand ELSE ((SELECT count(*) FROM b)-8)||' others' END AS line FROM b),
 t AS (SELECT line, CAST(sum(total) AS BIGINT) AS total, CAST(sum(share) AS BIGINT) AS share_pct FROM l GROUP BY 1)
 SELECT line AS brand, week, count(*) AS mentions, any_value(t.total) AS total, any_value(t.share_pct) AS share_pct FROM m JOIN l USING (brand) JOIN t USING (line) GROUP BY 1,2""")
def _(c):
    return av.share_of_voice(geo_checks(c), 90, ASOF)


@plan("aivis_sentiment", GEO + "SELECT " + ", ".join(f"count(*) FILTER (WHERE sentiment='{s}') AS {s}" for s in ("positive", "neutral", "negative", "absent")) + ", count(*) FILTER (WHERE sentiment<>'odd') AS rated FROM ck")
def _(c):
    return av.sentiment(geo_checks(c), 90, ASOF)


@plan("aivis_rank_dist", GEO + "SELECT (['1st','2nd','3rd','4+'])[least(rank,4)] AS label, count(*) AS runs, CAST(floor(count(*)/(SELECT count(*) FROM ck WHERE rank>=1)*100+0.5) AS BIGINT) AS pct FROM ck WHERE rank>=1 GROUP BY 1")
def _(c):
    return av.rank_distribution(geo_checks(c), 90, ASOF)


@plan("aivis_citation", GEO + """SELECT count(*) FILTER (WHERE cited) AS cited_runs, count(*) AS ground_runs, count(*) FILTER (WHERE cited AND recommended) AS cited_recommended,
 CAST(floor(count(*) FILTER (WHERE cited)/count(*)*100+0.5) AS BIGINT) AS cited_rate, count(*) FILTER (WHERE cited AND NOT recommended) AS cited_not_recommended FROM ck WHERE engine LIKE '%-grounded'""")
def _(c):
    return av.citation(geo_checks(c), 90, ASOF)


DEPLOYS = [("d1", "2024-01-08 00:00:00"), ("d2", "2024-01-15 00:00:00"), ("d3", "2024-01-22 00:00:00")]
DEPLOY_SQL = "dep AS (SELECT * FROM (VALUES ('d1',TIMESTAMP '2024-01-08'),('d2',TIMESTAMP '2024-01-15'),('d3',TIMESTAMP '2024-01-22')) t(deploy, dat))"


def deploys(c):
    return c.spark.createDataFrame(DEPLOYS, "deploy string, at string").withColumn("at", F.col("at").cast("timestamp"))


@plan("aivis_by_deploy", GEO + f""", {DEPLOY_SQL}, x AS (SELECT ts, true AS ck, CASE WHEN ts>=TIMESTAMP '2024-01-15' THEN k<70 ELSE k<40 END AS m, k<15 AS r FROM pev WHERE name='view' UNION ALL SELECT ts, false, false, false FROM pev WHERE name='click'),
 j AS (SELECT deploy, ts>=dat AS aft, ck, m, r FROM dep JOIN x ON ts>=dat-INTERVAL 7 DAY AND ts<dat+INTERVAL 7 DAY),
 g AS (SELECT deploy, count(*) FILTER (WHERE ck AND NOT aft) AS runs_before, count(*) FILTER (WHERE ck AND aft) AS runs_after, count(*) FILTER (WHERE NOT ck AND NOT aft) AS crawl_before, count(*) FILTER (WHERE NOT ck AND aft) AS crawl_after,
  CAST(floor(count(*) FILTER (WHERE m AND NOT aft)/count(*) FILTER (WHERE ck AND NOT aft)*100+0.5) AS BIGINT) AS mentioned_before, CAST(floor(count(*) FILTER (WHERE m AND aft)/count(*) FILTER (WHERE ck AND aft)*100+0.5) AS BIGINT) AS mentioned_after,
  CAST(floor(count(*) FILTER (WHERE r AND NOT aft)/count(*) FILTER (WHERE ck AND NOT aft)*100+0.5) AS BIGINT) AS recommended_before, CAST(floor(count(*) FILTER (WHERE r AND aft)/count(*) FILTER (WHERE ck AND aft)*100+0.5) AS BIGINT) AS recommended_after FROM j GROUP BY 1),
 h AS (SELECT *, runs_before<20 OR runs_after<20 AS thin, mentioned_after-mentioned_before AS md, recommended_after-recommended_before AS rd FROM g)
 SELECT deploy, runs_before, runs_after, crawl_before, crawl_after, mentioned_before, mentioned_after, recommended_before, recommended_after, NOT thin AND greatest(abs(md),abs(rd))>=15 AS significant,
  CASE WHEN thin THEN 'unknown' WHEN greatest(abs(md),abs(rd))<15 THEN 'flat' WHEN (CASE WHEN abs(md)>abs(rd) THEN md ELSE rd END)>0 THEN 'improvement' ELSE 'regression' END AS direction FROM h""")
def _(c):
    m = F.when(F.col("timestamp") >= "2024-01-15", F.col("k") < 70).otherwise(F.col("k") < 40)
    return av.by_deploy(geo_checks(c, m), deploys(c), ASOF, 7)


@plan("aivis_shift", """WITH ck AS (SELECT *, (['chatgpt','claude-grounded','gemini'])[k%3+1] AS engine, CASE WHEN ts>=TIMESTAMP '2024-01-24' AND k%3=0 THEN k<75 ELSE k<40 END AS m, k<15 AS r FROM pev WHERE name='view' AND ts>=TIMESTAMP '2024-01-17'),
 g AS (SELECT engine, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-24') AS cr, count(*) FILTER (WHERE ts<=TIMESTAMP '2024-01-24') AS pr, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-24' AND m) AS cm, count(*) FILTER (WHERE ts<=TIMESTAMP '2024-01-24' AND m) AS pm,
  count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-24' AND r) AS cc, count(*) FILTER (WHERE ts<=TIMESTAMP '2024-01-24' AND r) AS pc FROM ck GROUP BY 1),
 h AS (SELECT engine, cr, pr, abs(cm/cr-pm/pr)>abs(cc/cr-pc/pr) AS um, cm, pm, cc, pc FROM g WHERE cr>=20 AND pr>=20 AND greatest(cr,pr)<=2*least(cr,pr)),
 i AS (SELECT *, CASE WHEN um THEN cm ELSE cc END AS x, CASE WHEN um THEN pm ELSE pc END AS y FROM h),
 z AS (SELECT *, abs(x/cr-y/pr) AS mv, 2*sqrt(((x+1)/(cr+2)*(1-(x+1)/(cr+2))/cr + (y+1)/(pr+2)*(1-(y+1)/(pr+2))/pr)*2.3) AS band FROM i)
 SELECT engine, CASE WHEN um THEN 'mentions' ELSE 'recommends' END AS metric, CAST(floor(x/cr*100+0.5) AS BIGINT) AS current_pct, CAST(floor(y/pr*100+0.5) AS BIGINT) AS previous_pct, cr AS runs, pr AS previous_runs,
  CASE WHEN x/cr<y/pr THEN 'warn' ELSE 'info' END AS severity FROM z WHERE mv*100>=15 AND mv>=band ORDER BY mv DESC LIMIT 1""")
def _(c):
    k = F.col("k")
    return av.shift(geo_checks(c, F.when((F.col("timestamp") >= "2024-01-24") & (k % 3 == 0), k < 75).otherwise(k < 40)), ASOF)


@plan("aivis_cited_not_recommended", GEO + """SELECT 'warn' AS severity, 'cited_not_recommended' AS metric, CAST(floor(count(*) FILTER (WHERE NOT recommended)/count(*)*100+0.5) AS BIGINT) AS rate, count(*) AS n FROM ck
 WHERE engine LIKE '%-grounded' AND cited AND ts>=TIMESTAMP '2024-01-01' HAVING count(*)>=8 AND count(*) FILTER (WHERE NOT recommended)*100>=count(*)*70""")
def _(c):
    return av.cited_not_recommended(geo_checks(c), ASOF)
