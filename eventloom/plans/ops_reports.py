from pyspark.sql import functions as F

from eventloom.operators import agents as ag, errors as er, explore as ex, ops, surveys as sv
from eventloom.plans.inputs import ASOF, pick
from eventloom.plans.registry import plan


# ---- agents ------------------------------------------------------------------------------------------
def tool_events(c):
    k, bad = F.col("k"), F.col("name") == "error"
    return c.prod.select("id", F.lit("agent_tool_call").alias("name"), "distinct_id", "timestamp", pick(["search", "write", None], k % 3).alias("tool"),
                         F.col("amount").alias("latency_ms"), bad.alias("error"), F.when(bad, pick(["timeout", "refused"], k % 2)).alias("error_type"), "device",
                         F.concat(F.lit("c"), F.col("uid") % 2).alias("client"))


TOOLS = "WITH t AS (SELECT coalesce((['search','write',NULL])[k%3+1],'(none)') AS tool, name='error' AS bad, amount, CASE WHEN name='error' THEN (['timeout','refused'])[k%2+1] ELSE '(none)' END AS error_type, 'c'||(uid%2) AS client FROM pev) "


@plan("agent_tool_health", TOOLS + """SELECT tool, count(*) AS calls, count(*) FILTER (WHERE bad) AS errors, round(count(*) FILTER (WHERE bad)/count(*),6) AS error_rate,
 round(quantile_disc(amount,0.5),6) AS p50, round(quantile_disc(amount,0.9),6) AS p90, round(quantile_disc(amount,0.99),6) AS p99 FROM t GROUP BY 1""")
def _(c):
    return ag.tool_health(tool_events(c))


@plan("agent_tool_clients", TOOLS + "SELECT tool, client, count(*) AS calls FROM t GROUP BY 1,2")
def _(c):
    return ag.tool_clients(tool_events(c))


@plan("agent_error_taxonomy", TOOLS + "SELECT error_type, count(*) AS count FROM t WHERE bad AND tool='search' GROUP BY 1")
def _(c):
    return ag.error_taxonomy(tool_events(c), "search")


def turn_events(c):
    t = c.table("conversations")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    n = F.length("text")
    return t.select(F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn").alias("id"), F.lit("agent_turn").alias("name"), F.concat(F.lit("c"), "conv_id").alias("distinct_id"),
                    ts.alias("timestamp"), F.concat(F.lit("c"), "conv_id").alias("conversation_id"), "role", "text",
                    F.when(F.col("role") == "assistant", n.cast("double")).alias("ttft_ms"), F.when(F.col("role") == "assistant", n % 5 == 0).alias("resolved"))


TURNS = "WITH tn AS (SELECT 'c'||conv_id AS cid, turn, role, text, 1704067200000000+(conv_id*3600+turn*60)*1000000 AS us, CASE WHEN role='assistant' THEN length(text) END AS ttft, role='assistant' AND length(text)%5=0 AS res FROM conversations)"


@plan("agent_conversations", TURNS + """, l AS (SELECT *, lag(role) OVER (PARTITION BY cid ORDER BY us) AS p FROM tn),
 c AS (SELECT cid, count(*) AS n, max(CASE WHEN role='user' AND p='user' THEN 1 ELSE 0 END) AS re, arg_max(role,us) AS last, max(res) AS res FROM l GROUP BY 1)
 SELECT count(*) AS conversations, CAST(sum(n) AS BIGINT) AS turns, round(median(n),6) AS median_turns, CAST(quantile_disc(n,0.9) AS DOUBLE) AS p90_turns, round(sum(re)/count(*),6) AS reask_rate,
 round(count(*) FILTER (WHERE last='user')/count(*),6) AS abandon_rate, CAST((SELECT quantile_disc(ttft,0.5) FROM tn) AS DOUBLE) AS ttft_p50, CAST((SELECT quantile_disc(ttft,0.9) FROM tn) AS DOUBLE) AS ttft_p90,
 CAST((SELECT quantile_disc(ttft,0.99) FROM tn) AS DOUBLE) AS ttft_p99, round(count(*) FILTER (WHERE res)/count(*),6) AS resolution_rate FROM c""", base=None)
def _(c):
    return ag.conversations(turn_events(c))


def label_events(c):
    l = c.table("labels")
    return l.select(F.concat(F.lit("l"), "doc_id").alias("id"), F.lit("agent_label").alias("name"), F.lit("labeler").alias("distinct_id"),
                    F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 977 * 60).alias("timestamp"),
                    F.concat(F.lit("c"), F.col("doc_id") % 140).alias("conversation_id"), F.concat(F.lit("q"), "quality").alias("intent"))


@plan("label_breakdown", TURNS + """, w AS (SELECT 'c'||(doc_id%140) AS cid, arg_max('q'||quality, (doc_id%977)*1000000000 + 0) AS v0, max(struct_pack(t:=doc_id%977, id:='l'||doc_id, v:='q'||quality)).v AS v FROM labels WHERE 'c'||(doc_id%140) IN (SELECT cid FROM tn) GROUP BY 1)
 SELECT v AS value, count(*) AS conversations, (SELECT count(DISTINCT cid) FROM tn) AS total, (SELECT count(*) FROM w) AS labeled FROM w GROUP BY 1""", base=None)
def _(c):
    return ag.label_breakdown(turn_events(c).unionByName(label_events(c), allowMissingColumns=True), "intent")


@plan("conversation_sample", TURNS + """, c AS (SELECT cid, count(*) AS turn_count, min(us) AS start_us, max(us) AS end_us FROM tn GROUP BY 1 ORDER BY end_us DESC, cid LIMIT 20)
 SELECT cid AS conversation_id, any_value(turn_count) AS turn_count, CAST(0 AS BIGINT) AS turns_omitted, any_value(start_us) AS start_us, any_value(end_us) AS end_us, count(*) FILTER (WHERE text<>'') AS with_text,
 cid IN (SELECT 'c'||(doc_id%140) FROM labels) AS labeled, string_agg(role||': '||substring(text,1,500), chr(10) ORDER BY us) AS transcript FROM tn JOIN c USING (cid) GROUP BY 1""", base=None)
def _(c):
    return ag.sample(turn_events(c).unionByName(label_events(c), allowMissingColumns=True))


# ---- surveys -----------------------------------------------------------------------------------------
def survey_events(c):
    n = F.col("name")
    return c.prod.where(n.isin("signup", "view")).select("id", F.when(n == "signup", "$survey_response").otherwise("$survey_shown").alias("name"), "distinct_id", "timestamp",
                                                         F.concat(F.lit("s"), F.col("k") % 3).alias("survey_id"), F.when(n == "signup", (F.col("k") % 11).cast("string")).alias("answer"))


SURV = "WITH r AS (SELECT 's'||(k%3) AS survey, distinct_id, us, id, name='signup' AS resp, k%11 AS a FROM pev WHERE name IN ('signup','view') AND ts>=TIMESTAMP '2024-01-03')"


@plan("survey_results", SURV + """, g AS (SELECT survey, count(DISTINCT CASE WHEN NOT resp THEN distinct_id END) AS shown, count(DISTINCT CASE WHEN resp THEN distinct_id END) AS responses,
  count(*) FILTER (WHERE resp AND a>=9) AS promoters, count(*) FILTER (WHERE resp AND a IN (7,8)) AS passives, count(*) FILTER (WHERE resp AND a<7) AS detractors, avg(a) FILTER (WHERE resp) AS av FROM r GROUP BY 1)
 SELECT survey, shown, responses, floor(responses*100/shown*10+0.5)/10 AS rate_pct, promoters, passives, detractors, CAST(round((promoters-detractors)*100/(promoters+passives+detractors)) AS DOUBLE) AS nps, floor(av*10+0.5)/10 AS average FROM g""")
def _(c):
    return sv.results(survey_events(c), ASOF, 28)


@plan("survey_choices", SURV + "SELECT survey, CAST(a AS VARCHAR) AS answer, count(*) AS n FROM r WHERE resp GROUP BY 1,2")
def _(c):
    return sv.choices(survey_events(c), ASOF, 28)


@plan("survey_recent_texts", SURV + "SELECT survey, rank, answer FROM (SELECT survey, CAST(a AS VARCHAR) AS answer, row_number() OVER (PARTITION BY survey ORDER BY us DESC, id DESC) AS rank FROM r WHERE resp) WHERE rank<=20")
def _(c):
    return sv.recent_texts(survey_events(c), ASOF, 28)


# ---- errors ------------------------------------------------------------------------------------------
ERR = r"""WITH e AS (SELECT *, regexp_replace('fail '||k||' at '||(k%4), '\b\d+\b', '<n>', 'g') AS title FROM web WHERE name='$exception'),
 x AS (SELECT *, substr(md5(title||'|'||source||CASE WHEN lineno>0 THEN '|'||lineno ELSE '' END),1,16) AS fingerprint FROM e) """


@plan("error_groups", ERR + """, w AS (SELECT *, ts>=TIMESTAMP '2024-01-29' AS cur FROM x WHERE ts>=TIMESTAMP '2024-01-27' AND ts<TIMESTAMP '2024-01-31'),
 p AS (SELECT fingerprint, string_agg(path, ',' ORDER BY n DESC, path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY n DESC, path) AS r FROM (SELECT fingerprint, path, count(*) AS n FROM w WHERE cur GROUP BY 1,2)) WHERE r<=5 GROUP BY 1)
 SELECT fingerprint, any_value(title) AS title, any_value(source) AS source, any_value(lineno) AS line, count(*) FILTER (WHERE cur) AS count, count(DISTINCT CASE WHEN cur THEN distinct_id END) AS users, any_value(paths) AS paths,
 min(us) FILTER (WHERE cur) AS first_us, max(us) FILTER (WHERE cur) AS last_us, count(*) FILTER (WHERE NOT cur)=0 AS is_new FROM w LEFT JOIN p USING (fingerprint) GROUP BY 1 HAVING count(*) FILTER (WHERE cur)>0""", base="web")
def _(c):
    return er.groups(c.web, "2024-01-29 00:00:00", ASOF, "2024-01-27 00:00:00")


@plan("error_summary", """SELECT CAST(sum(e) AS BIGINT) AS total, count(*) AS users, count(*) FILTER (WHERE e>0) AS affected, floor(count(*) FILTER (WHERE e=0)*100/count(*)*10+0.5)/10 AS crash_free_pct
 FROM (SELECT distinct_id, count(*) FILTER (WHERE name='$exception') AS e FROM web WHERE ts>=TIMESTAMP '2024-01-30 21:00:00' GROUP BY 1)""", base="web")
def _(c):
    return er.summary(c.web, "2024-01-30 21:00:00", ASOF)


@plan("error_funnel_impact", ERR + """, s AS (SELECT distinct_id, us, id, name, min(us) FILTER (WHERE name='purchase') OVER (PARTITION BY distinct_id ORDER BY us,id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p FROM web WHERE name IN ('$pageview','purchase')),
 o AS (SELECT distinct_id, max(CASE WHEN p-us<=3600000000 THEN 2 ELSE 1 END) AS reached FROM s WHERE name='$pageview' GROUP BY 1),
 h AS (SELECT DISTINCT fingerprint, title, distinct_id FROM x), g AS (SELECT fingerprint, any_value(title) AS title, count(*) AS an, count(*) FILTER (WHERE reached=2) AS ac, max(reached) AS f FROM h JOIN o USING (distinct_id) GROUP BY 1),
 t AS (SELECT count(*) AS n, count(*) FILTER (WHERE reached=2) AS c FROM o), z AS (SELECT g.*, n-an AS cn, c-ac AS cc FROM g, t)
 SELECT fingerprint, title, an AS affected_users, cn AS clean_users, floor(ac/an*1000+0.5)/10 AS affected_conv, floor(coalesce(cc/nullif(cn,0),0)*1000+0.5)/10 AS clean_conv, round((coalesce(cc/nullif(cn,0),0)-ac/an)*100,6) AS gap_pct, an<20 OR cn<20 AS thin, CASE f WHEN 2 THEN 'purchase' ELSE '$pageview' END AS step FROM z""", base="web")
def _(c):
    return er.funnel_impact(c.web, ["$pageview", "purchase"], 3600)


# ---- alerts ------------------------------------------------------------------------------------------
def _alerts(c, kind):
    rows = {"count": [("a1", "count", "purchase", None, "gt", 50.0, 24), ("a2", "count", "signup", None, "lt", 5.0, 24)],
            "relative": [("b1", "relative", "view", None, "lt", 10.0, 72), ("b2", "relative", "error", None, "gt", 1.0, 48), ("b3", "relative", "never", None, "lt", 1.0, 24)],
            "ratio": [("c1", "ratio", "error", "view", "gt", 90.0, 24), ("c2", "ratio", "purchase", "never", "gt", 1.0, 24)]}[kind]
    return c.spark.createDataFrame(rows, ops.ALERT_DDL)


AL = """WITH n AS (SELECT name, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-30') AS c24, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-29') AS c48, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-28') AS c72,
 count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-27' AND ts<TIMESTAMP '2024-01-29') AS p48, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-25' AND ts<TIMESTAMP '2024-01-28') AS p72 FROM pev GROUP BY 1) """


@plan("alert_count", AL + """SELECT 'a1' AS id, 'count' AS kind, CAST(c24 AS DOUBLE) AS value, c24>50 AS met, CAST(NULL AS DOUBLE) AS change_pct FROM (SELECT c24 FROM n WHERE name='purchase')
 UNION ALL SELECT 'a2','count',CAST(c24 AS DOUBLE),c24<5,NULL FROM n WHERE name='signup'""")
def _(c):
    return ops.evaluate_alerts(c.prod, _alerts(c, "count"), ASOF).withColumn("change_pct", F.lit(None).cast("double"))


@plan("alert_relative", AL + """SELECT 'b1' AS id, 'relative' AS kind, CAST(c72 AS DOUBLE) AS value, (c72-p72)/p72*100<=-10 AS met, round((c72-p72)/p72*100,6) AS change_pct FROM n WHERE name='view'
 UNION ALL SELECT 'b2','relative',CAST(c48 AS DOUBLE),(c48-p48)/p48*100>=1,round((c48-p48)/p48*100,6) FROM n WHERE name='error' UNION ALL SELECT 'b3','relative',0,false,NULL""")
def _(c):
    return ops.evaluate_alerts(c.prod, _alerts(c, "relative"), ASOF)


@plan("alert_ratio", AL + """SELECT 'c1' AS id, 'ratio' AS kind, round(e.c24/v.c24*100,6) AS value, e.c24/v.c24*100>90 AS met FROM n e, n v WHERE e.name='error' AND v.name='view' UNION ALL SELECT 'c2','ratio',0,false""")
def _(c):
    return ops.evaluate_alerts(c.prod, _alerts(c, "ratio"), ASOF).drop("change_pct")


# ---- evidence ----------------------------------------------------------------------------------------
@plan("rows_behind", """WITH m AS (SELECT * FROM pev WHERE name='purchase' AND plan='pro'),
 p AS (SELECT count(*) AS total, count(DISTINCT distinct_id) AS users, CAST(sum(CAST('0x'||substr(sha256(id||chr(0)||name||chr(0)||distinct_id||chr(0)||us),1,12) AS BIGINT)) AS VARCHAR) AS digest FROM m)
 SELECT id, name, distinct_id, us, total, users, digest, CAST(total AS DOUBLE) AS recomputed, true AS matches FROM (SELECT * FROM m ORDER BY us, id, name LIMIT 500), p""")
def _(c):
    return ops.rows_behind(c.prod, (F.col("name") == "purchase") & (F.col("plan") == "pro"))


@plan("who_behind", """WITH g AS (SELECT distinct_id, count(*) AS events, max(us) AS last_us FROM pev WHERE name='purchase' AND d='2024-01-10' GROUP BY 1)
 SELECT *, (SELECT count(*) FROM g) AS total_users FROM g ORDER BY last_us DESC, distinct_id LIMIT 200""")
def _(c):
    return ops.who_behind(c.prod, (F.col("name") == "purchase") & (F.date_format("timestamp", "yyyy-MM-dd") == "2024-01-10"))


@plan("instrumentation_health", """SELECT * FROM (SELECT name AS event, CASE WHEN name IN ('view','signup') THEN 'flowing' ELSE 'unplanned' END AS status, count(*) AS count,
 CASE name WHEN 'signup' THEN 'seats' ELSE '' END AS missing_properties FROM pev GROUP BY 1) UNION ALL SELECT 'refund','MISSING',0,''""")
def _(c):
    wanted = c.spark.createDataFrame([("view", ["path"]), ("signup", ["plan", "seats"]), ("refund", ["amount"])], "event string, properties array<string>")
    return ops.instrumentation_health(c.variant_events.join(c.prod.select("id"), "id", "left_semi"), wanted)


# ---- change records: documents stand in for pull requests ----------------------------------------------
def pull_requests(c):
    d, i, body = c.table("documents"), F.col("doc_id"), F.col("text")
    files = F.when(i % 7 == 0, F.array(F.lit("docs/a.md"), F.lit("README.md"))).when(i % 7 == 1, F.array(F.lit("src/app.ts"))).otherwise(F.array(F.lit("src/app.ts"), F.lit("web/x_test.ts")))
    named = F.filter(F.array(*[F.when(body.rlike(rf"\b{e}\b"), F.lit(e)) for e in ("click", "error", "purchase", "signup", "view")]), lambda x: x.isNotNull())
    title = F.concat(pick(["feat: add thing", "chore: tidy", "Fix the flow", "rename stuff", "work"], i % 5), F.lit(" "), i)
    inst = F.when(i % 11 == 0, F.array(F.lit("src/app.ts"))).otherwise(F.array().cast("array<string>"))
    return d.select(i.alias("pr"), title.alias("title"), body.alias("body"), files.alias("files"), inst.alias("instrumented"), named.alias("events"))


CLAIM = f"""WITH q AS (SELECT doc_id, text, (['feat: add thing','chore: tidy','Fix the flow','rename stuff','work'])[doc_id%5+1]||' '||doc_id AS title, regexp_matches(text,'\\b(click|error|purchase|signup|view)\\b') AS ev FROM documents),
 v AS (SELECT doc_id, text, CASE WHEN doc_id%5=1 OR doc_id%7=0 THEN 'no_measurable_intent' WHEN ev THEN 'claimable' WHEN doc_id%11=0 THEN 'touches_instrumented' WHEN regexp_matches(title||chr(10)||text,'{ops.CHORE_WORDS}') THEN 'no_measurable_intent'
  WHEN regexp_matches(title||chr(10)||text,'{ops.USER_FACING}') THEN 'unclear' ELSE 'no_measurable_intent' END AS verdict FROM q) """


@plan("pr_claim_yield", CLAIM + """, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE verdict='claimable') AS claimable, count(*) FILTER (WHERE verdict='touches_instrumented') AS touches_instrumented,
 count(*) FILTER (WHERE verdict='unclear') AS unclear, count(*) FILTER (WHERE verdict='no_measurable_intent') AS no_measurable_intent FROM v)
 SELECT *, floor(claimable*100/total*10+0.5)/10 AS strict_pct, floor((claimable+touches_instrumented)*100/total*10+0.5)/10 AS broad_pct, floor((claimable+touches_instrumented+unclear)*100/total*10+0.5)/10 AS ceiling_pct FROM a""", base=None)
def _(c):
    return ops.claim_yield(pull_requests(c))


@plan("pr_claim_verdicts", CLAIM + """SELECT doc_id AS pr, verdict, CASE WHEN verdict='claimable' THEN CASE WHEN regexp_matches(text,'\\bclick\\b') THEN 'click' WHEN regexp_matches(text,'\\berror\\b') THEN 'error' WHEN regexp_matches(text,'\\bpurchase\\b') THEN 'purchase'
 WHEN regexp_matches(text,'\\bsignup\\b') THEN 'signup' ELSE 'view' END ELSE '' END AS metric FROM v""", base=None)
def _(c):
    return ops.claim_verdicts(pull_requests(c))


@plan("action_log", """SELECT id, CASE name WHEN 'error' THEN 'guardrail_revert' ELSE 'tracking_pr' END AS kind, CASE name WHEN 'error' THEN 'f'||(k%3) ELSE 'e'||(k%5) END AS subject,
 CASE name WHEN 'error' THEN 'g'||(k%2) ELSE 'https://x.example/'||k END AS detail, us FROM pev WHERE (name='error' AND k%4<>0 OR name='signup' AND k%2=0) AND ts>=TIMESTAMP '2024-01-01' ORDER BY us DESC, id LIMIT 10""")
def _(c):
    k, rev, pr = F.col("k"), F.col("name") == "error", F.col("name") == "signup"
    d = c.prod.select("id", F.when(rev, "$experiment_reverted").when(pr, "$tracking_pr_opened").otherwise(F.col("name")).alias("name"), "distinct_id", "timestamp",
                      F.when(rev, F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("f"), k % 3))).alias("flag"), F.when(rev, F.concat(F.lit("g"), k % 2)).alias("guardrail"),
                      F.when(pr, F.concat(F.lit("e"), k % 5)).alias("event"), F.when(pr, F.when(k % 2 == 0, F.concat(F.lit("https://x.example/"), k)).otherwise("none")).alias("pr_url"))
    return ops.action_log(d, ASOF)


# ---- catalogue and explore -----------------------------------------------------------------------------
@plan("scan_range", "SELECT id, name, distinct_id, us FROM ev WHERE ts>=TIMESTAMP '2024-01-10' AND ts<TIMESTAMP '2024-01-12'", base="ev")
def _(c):
    return ex.scan_range(c.events, "2024-01-10 00:00:00", "2024-01-12 00:00:00").select("id", "name", "distinct_id", F.unix_micros("timestamp").alias("us"))


@plan("event_names", "SELECT name, count(*) AS events FROM ev GROUP BY 1", base="ev")
def _(c):
    return ex.event_names(c.events)


@plan("usage_summary", """SELECT count(*) AS events, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-01') AS events_30d, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-01') AS events_month, count(DISTINCT distinct_id) AS users FROM pev WHERE NOT (name='error' AND k<60)""")
def _(c):
    from eventloom.plans.population import sampled
    return ex.usage(sampled(c), ASOF)


@plan("recent_events", "SELECT id, name, distinct_id, us FROM pev ORDER BY us DESC, id LIMIT 100")
def _(c):
    return ex.recent(c.prod).select("id", "name", "distinct_id", F.unix_micros("timestamp").alias("us"))


@plan("user_timeline", "SELECT id, name, us, path FROM pev WHERE distinct_id='u7' ORDER BY us DESC, id LIMIT 100")
def _(c):
    return ex.recent(c.prod.where("distinct_id = 'u7'")).select("id", "name", F.unix_micros("timestamp").alias("us"), "path")


@plan("user_timeline_counts", "SELECT name, count(*) AS events, max(us) AS last_us FROM pev WHERE distinct_id='u7' GROUP BY 1")
def _(c):
    return ex.user_counts(c.prod, "u7")


@plan("user_timeline_properties", """SELECT key, value FROM (SELECT 'path' AS key, arg_max(path,us) AS value FROM pev WHERE distinct_id='u7' UNION ALL SELECT 'browser', arg_max(browser,us) FROM pev WHERE distinct_id='u7'
 UNION ALL SELECT 'device', arg_max(device,us) FROM pev WHERE distinct_id='u7' UNION ALL SELECT 'utm_source', arg_max(utm_source,us) FILTER (WHERE utm_source IS NOT NULL) FROM pev WHERE distinct_id='u7') WHERE value IS NOT NULL""")
def _(c):
    return ex.user_properties(c.prod.select("id", "name", "distinct_id", "timestamp", "path", "browser", "device", "utm_source"), "u7")
