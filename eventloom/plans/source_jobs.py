from pyspark.sql import functions as F

from eventloom.sources import idindex as ix, importers as im, ingest as ig, payments as pay, snapshots as sn, tables as tb
from eventloom.plans.inputs import ASOF, pick
from eventloom.plans.population import ALIASED, aliased, counts
from eventloom.plans.registry import plan
from eventloom.streaming.jobs import work_dir

NOW = "2024-01-20 12:00:00"


# ---- ingest ------------------------------------------------------------------------------------------
def raw_lines(c, *extra):
    """Each event as a client would send it: some broken, nameless, oversized, badly dated or without an id."""
    e, k = F.col("eid"), F.col("k")
    ts = F.when(e % 13 == 0, "1999-05-01T00:00:00Z").when(e % 29 == 0, F.lit(None)).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    props = F.struct("path", "amount", F.when(e % 31 == 0, F.repeat(F.lit("x"), 9000)).alias("big"))
    good = F.to_json(F.struct(F.when(e % 5 != 0, F.col("id")).alias("id"), F.when(e % 7 != 0, F.col("name")).alias("name"), F.when(e % 11 != 0, F.col("distinct_id")).alias("distinct_id"), ts.alias("timestamp"), props.alias("properties")))
    return c.events.select(F.when(e % 17 == 0, F.lit('{"name": ')).otherwise(good).alias("value"), *extra)


REASON = "CASE WHEN eid%17=0 THEN 'invalid JSON' WHEN eid%7=0 THEN 'missing event name' WHEN eid%31=0 THEN 'property too large' WHEN eid%11=0 THEN 'missing distinct_id' ELSE 'accepted' END"


@plan("ingest_normalize", f"""WITH r AS (SELECT *, {REASON} AS reason, CASE WHEN eid%13=0 OR eid%29=0 OR ts>TIMESTAMP '{NOW}' THEN epoch_us(TIMESTAMP '{NOW}') ELSE us END AS t FROM ev)
 SELECT reason, CASE WHEN reason='accepted' THEN name ELSE '' END AS name, count(*) AS events, count(DISTINCT CASE WHEN reason='accepted' THEN distinct_id END) AS users, max(CASE WHEN reason='accepted' THEN t ELSE 0 END) AS last_us, CAST(sum(CASE WHEN reason='accepted' THEN t%1000000007 ELSE 0 END) AS BIGINT) AS check_us FROM r GROUP BY 1,2""", base="ev")
def _(c):
    d = ig.normalize(raw_lines(c), NOW)
    ok = F.col("reason").isNull()
    us = F.when(ok, F.unix_micros("timestamp")).otherwise(F.lit(0))
    return d.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"), F.when(ok, F.col("name")).otherwise("").alias("name")).agg(
        F.count("*").alias("events"), F.count_distinct(F.when(ok, F.col("distinct_id"))).alias("users"), F.max(us).alias("last_us"), F.sum(us % 1000000007).alias("check_us"))


@plan("ingest_dropped", f"""WITH r AS (SELECT {REASON} AS reason, name LIKE 'view%' AND k%10 IN (5,7,8,9) AS bot FROM ev), x AS (SELECT CASE WHEN reason<>'accepted' THEN 'rejected_'||lower(replace(reason,' ','_')) WHEN bot THEN 'bots' ELSE 'stored' END AS what FROM r)
 SELECT what, count(*) AS rows FROM x GROUP BY 1 UNION ALL SELECT 'rows', count(*) FROM x UNION ALL SELECT unnest(['rejected_too_many_properties','rejected_event_too_large']), 0""", base="ev")
def _(c):
    """Counts of what a store job left out, observed while it wrote the rest."""
    from types import SimpleNamespace
    n, k = F.col("name"), F.col("k")
    lines = raw_lines(SimpleNamespace(events=c.events.withColumn("name", F.when(n == "view", "$pageview").otherwise(n))), pick(UAS, k % 10).alias("user_agent"))
    rows, seen = ig.observed(ig.normalize(lines, NOW), "ingest_dropped", "user_agent")
    rows.drop("properties").write.parquet(work_dir(c.spark, "stored"))
    return c.spark.createDataFrame(sorted(seen.get.items()), "what string, rows bigint")


DEDUP_SQL = """WITH s AS (SELECT 'e'||(eid - eid%3) AS id, eid, name FROM ev), f AS (SELECT id, arg_min(name, eid) AS name, min(eid) AS eid FROM s GROUP BY 1)
 SELECT id, name, eid FROM f WHERE id NOT IN (SELECT 'e'||eid FROM ev WHERE ts<TIMESTAMP '2024-01-05')"""


def sent(c):
    return c.events.withColumn("id", F.concat(F.lit("e"), F.col("eid") - F.col("eid") % 3)).select("id", "name", "eid")


@plan("ingest_dedup", DEDUP_SQL, base="ev")
def _(c):
    stored = c.events.where("timestamp < '2024-01-05'").select("id")
    return ig.dedup(sent(c), "eid", stored)


@plan("ingest_dedup_indexed", DEDUP_SQL, base="ev")
def _(c):
    """The same against an index of two stored batches."""
    index = work_dir(c.spark, "ids")
    stored = c.events.where("timestamp < '2024-01-05'")
    for key, part in (("a", stored.where("eid % 2 = 0")), ("b", stored.where("eid % 2 = 1"))):
        ix.record(part, key, index)
    return ix.dedup(sent(c), "eid", index, "c")


UAS = ["Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17 Safari/605", "Mozilla/5.0 (Linux; Android 14) Chrome/121", "Mozilla/5.0 (X11; Linux) Firefox/122",
       "curl/8.1", "", "Mozilla/5.0 (iPhone) Opera/9", "Mozilla/5.0 (compatible; GPTBot/1.2)", "AhrefsBot/7.0", "Mozilla/5.0 HeadlessChrome/119 Chrome/119"]
UA_SQL = "([" + ",".join(f"'{u}'" for u in UAS) + "])[k%10+1]"


def with_ua(c, df):
    return df.withColumn("user_agent", pick(UAS, F.col("k") % 10))


@plan("enrich_user_agent", f"""SELECT browser, os, count(*) AS events FROM (SELECT CASE WHEN k%4=0 THEN browser ELSE CASE k%10 WHEN 0 THEN 'Edge' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Chrome' WHEN 3 THEN 'Firefox' WHEN 6 THEN 'Opera' WHEN 9 THEN 'Chrome' ELSE '(none)' END END AS browser,
 CASE k%10 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'Android' WHEN 3 THEN 'Linux' WHEN 6 THEN 'iOS' ELSE '(none)' END AS os FROM ev) GROUP BY 1,2""", base="ev")
def _(c):
    d = with_ua(c, c.events).withColumn("browser", F.when(F.col("k") % 4 == 0, F.col("browser")))
    n = lambda x: F.coalesce(x, F.lit("(none)")).alias(x)
    return ig.enrich_user_agent(d).groupBy(n("browser"), n("os")).agg(F.count("*").alias("events"))


@plan("filter_bots", """SELECT name, count(*) FILTER (WHERE NOT b) AS kept, count(*) FILTER (WHERE b) AS dropped FROM (SELECT CASE name WHEN '$exception' THEN '$ai_crawl' ELSE name END AS name, k%10 IN (5,7,8,9) AND name IN ('$pageview','$click') AS b FROM web) GROUP BY 1""", base="web")
def _(c):
    d = with_ua(c, c.web).withColumn("name", F.when(F.col("name") == "$exception", "$ai_crawl").otherwise(F.col("name")))
    return ig.bot_counts(d)


IP = "(CAST(eid AS BIGINT)*7919*40009 % 4294967296)"


@plan("enrich_country", f"SELECT coalesce(CASE WHEN {IP}//16777216%7<>3 THEN 'C'||({IP}//16777216) END, '(none)') AS country, count(*) AS events FROM ev GROUP BY 1", base="ev")
def _(c):
    # 256 blocks, every seventh left out; addresses are spread over the whole space
    blocks = c.events.select((F.col("eid") % 256).alias("b")).distinct().where("b % 7 <> 3")
    ranges = blocks.select((F.col("b") * 16777216).alias("start"), (F.col("b") * 16777216 + 16777215).alias("end"), F.concat(F.lit("C"), "b").alias("cc"))
    n = F.col("eid") * 7919 * 40009 % 4294967296
    ip = F.concat_ws(".", F.floor(n / 16777216), F.floor(n / 65536) % 256, F.floor(n / 256) % 256, n % 256)
    d = c.events.drop("country").withColumn("ip", ip)
    return ig.enrich_country(d, ranges, ig.ip_number(F.col("ip"))).groupBy(F.coalesce("country", F.lit("(none)")).alias("country")).agg(F.count("*").alias("events"))


@plan("range_join_ip", f"""WITH r AS (SELECT uid AS b, min(eid)*1000 AS s, min(eid)*1000+499 AS e FROM ev GROUP BY 1) SELECT r.b AS uid, count(*) AS hits FROM ev JOIN r ON eid*1000+k*10 BETWEEN s AND e GROUP BY 1""", base="ev")
def _(c):
    r = c.events.groupBy("uid").agg((F.min("eid") * 1000).alias("start")).select("start", (F.col("start") + 499).alias("end"), F.col("uid").cast("string").alias("cc"))
    j = ig.enrich_country(c.events.drop("country"), r, F.col("eid") * 1000 + F.col("k") * 10).where("country is not null")
    return j.groupBy(F.col("country").cast("bigint").alias("uid")).agg(F.count("*").alias("hits"))


_K = b"s3cret".ljust(64, b"\0")
_I, _O = (bytes(b ^ x for b in _K).hex() for x in (0x36, 0x5C))


@plan("anonymous_id", f"""WITH m AS (SELECT name, 'anon-'||substr(sha256(unhex('{_O}')||unhex(sha256(unhex('{_I}')||encode(dn||'|10.0.0.'||(uid%250)||'|'||device)))),1,16) AS distinct_id FROM ev) SELECT distinct_id, count(*) AS events FROM m GROUP BY 1""", base="ev")
def _(c):
    d = c.events.withColumn("ip", F.concat(F.lit("10.0.0."), F.col("uid") % 250)).withColumn("user_agent", F.col("device")).withColumn("distinct_id", F.lit("$anon"))
    return ig.resolve_anonymous(d, "s3cret").groupBy("distinct_id").agg(F.count("*").alias("events"))


# ---- importers: every event re-cast as another tool's export row -----------------------------------------
def rows_out(d, *keys):
    """Per reason and name: rows, people, a check over times, and chosen properties."""
    us = F.coalesce(F.unix_micros("timestamp"), F.lit(0))
    prop = [F.coalesce(F.try_variant_get("properties", f"$.{k}", "string"), F.lit("")).alias(k) for k in keys]
    return d.groupBy(F.coalesce("reason", F.lit("parsed")).alias("reason"), "name", *prop).agg(
        F.count("*").alias("rows"), F.count_distinct("distinct_id").alias("users"), F.sum(us % 1000003).alias("check_us"), F.count_distinct("id").alias("ids"))


def out_sql(reason, name, did, us, props, ids, src="ev"):
    cols = "".join(f", {e} AS {k}" for k, e in props.items())
    return f"WITH r AS (SELECT {reason} AS reason, {name} AS name, {did} AS did, {us} AS us{cols}, {ids} AS iid FROM {src}) SELECT reason, name{''.join(', ' + k for k in props)}, count(*) AS rows, count(DISTINCT did) AS users, CAST(sum(us%1000003) AS BIGINT) AS check_us, count(DISTINCT iid) AS ids FROM r GROUP BY ALL"


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def nz(x):
    return F.coalesce(x, F.lit(""))


@plan("import_jsonl", out_sql("CASE WHEN eid%17=0 THEN 'invalid JSON' WHEN eid%7=0 THEN 'missing event name' WHEN eid%11=0 THEN 'missing distinct_id' WHEN eid%23=0 THEN 'unparseable timestamp' ELSE 'parsed' END", "CASE WHEN eid%17=0 OR eid%7=0 THEN '' ELSE name END",
                              "CASE WHEN eid%17=0 OR eid%11=0 THEN '' ELSE distinct_id END", "CASE WHEN eid%17=0 OR eid%23=0 THEN 0 ELSE us END", {"path": "CASE WHEN eid%17=0 THEN '' ELSE path END"}, "CASE WHEN eid%17<>0 THEN id END"), base="ev")
def _(c):
    js = F.to_json(F.struct("id", F.when(F.col("eid") % 7 != 0, F.col("name")).alias("name"), F.when(F.col("eid") % 11 != 0, F.col("distinct_id")).alias("distinct_id"),
                            F.when(F.col("eid") % 23 == 0, "soon").otherwise(F.date_format("timestamp", ISO)).alias("timestamp"), F.struct("path").alias("properties")))
    return rows_out(im.map_jsonl(c.events.select(F.when(F.col("eid") % 17 == 0, "{oops").otherwise(js).alias("value"))), "path")


@plan("import_csv", out_sql("CASE WHEN eid%7=0 THEN 'missing event name' WHEN eid%11=0 THEN 'missing distinct_id' WHEN eid%23=0 THEN 'unparseable timestamp' ELSE 'parsed' END", "CASE WHEN eid%7=0 THEN '' ELSE name END", "CASE WHEN eid%11=0 THEN '' ELSE distinct_id END",
                            "CASE WHEN eid%23=0 OR eid%29=0 THEN 0 ELSE us//1000000*1000000 END", {"country": "country", "plan": "coalesce(plan,'')"}, "id"), base="ev")
def _(c):
    d = c.events.select(F.when(F.col("eid") % 7 != 0, F.concat(F.lit(" "), "name")).alias("event"), F.when(F.col("eid") % 11 != 0, F.col("distinct_id")).alias("user_id"),
                        F.when(F.col("eid") % 23 == 0, "not a time").when(F.col("eid") % 29 == 0, "").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.col("id").alias("uuid"), "country", nz(F.col("plan")).alias("plan"))
    return rows_out(im.map_csv(d), "country", "plan")


@plan("import_posthog", out_sql("CASE WHEN eid%19=0 THEN 'unparseable properties JSON' ELSE 'parsed' END", "name", "distinct_id", "us", {"plan": "CASE WHEN eid%19=0 THEN coalesce(plan,'') WHEN eid%2=0 THEN 'json' ELSE coalesce(plan,'') END", "amount": "CASE WHEN eid%19<>0 THEN CAST(k AS VARCHAR) ELSE '' END"}, "id"), base="ev")
def _(c):
    pj = F.when(F.col("eid") % 19 == 0, "{nope").otherwise(F.to_json(F.struct(F.when(F.col("eid") % 2 == 0, "json").alias("plan"), F.col("k").alias("amount"))))
    d = c.events.select(F.col("name").alias("event"), "distinct_id", F.date_format("timestamp", ISO).alias("timestamp"), F.col("id").alias("uuid"), pj.alias("properties"), nz(F.col("plan")).alias("properties.plan"))
    return rows_out(im.map_posthog(d), "plan", "amount")


@plan("import_posthog_api", out_sql("CASE WHEN eid%7=0 THEN 'missing event name' ELSE 'parsed' END", "CASE WHEN eid%7=0 THEN '' ELSE name END", "distinct_id", "us", {"path": "path"}, "id"), base="ev")
def _(c):
    js = F.to_json(F.struct(F.when(F.col("eid") % 2 == 0, F.col("id")).alias("id"), F.when(F.col("eid") % 2 == 1, F.col("id")).alias("uuid"), F.when(F.col("eid") % 7 != 0, F.col("name")).alias("event"), F.when(F.col("eid") % 3 != 0, F.col("distinct_id")).alias("distinct_id"),
                            F.date_format("timestamp", ISO).alias("timestamp"), F.struct("path", F.when(F.col("eid") % 3 == 0, F.col("distinct_id")).alias("distinct_id")).alias("properties")))
    return rows_out(im.map_posthog_api(c.events.select(js.alias("value"))), "path")


@plan("import_mixpanel", out_sql("CASE WHEN eid%11=0 THEN 'missing distinct_id' ELSE 'parsed' END", "name", "CASE WHEN eid%11=0 THEN '' ELSE CAST(uid AS VARCHAR) END", "CASE WHEN eid%2=0 THEN us//1000000*1000000 ELSE us//1000*1000 END", {"device": "device", "time": "''"}, "id"), base="ev")
def _(c):
    ms = F.floor(F.unix_micros("timestamp") / 1000)
    js = F.to_json(F.struct(F.col("name").alias("event"), F.struct(F.when(F.col("eid") % 11 != 0, F.col("uid")).alias("distinct_id"), F.when(F.col("eid") % 2 == 0, F.floor(ms / 1000)).otherwise(ms).alias("time"), F.col("id").alias("$insert_id"), "device").alias("properties")))
    return rows_out(im.map_mixpanel(c.events.select(js.alias("value"))), "device", "time")


@plan("import_amplitude", out_sql("CASE WHEN eid%33=0 THEN 'missing user id' ELSE 'parsed' END", "name", "CASE WHEN eid%33=0 THEN '' WHEN eid%11=0 THEN 'd'||uid ELSE distinct_id END", "us//1000*1000", {"plan": "CASE WHEN eid%2=0 THEN 'event' ELSE coalesce(plan,'') END", "country": "country"}, "id"), base="ev")
def _(c):
    js = F.to_json(F.struct(F.col("name").alias("event_type"), F.when(F.col("eid") % 11 != 0, F.col("distinct_id")).alias("user_id"), F.when((F.col("eid") % 11 == 0) & (F.col("eid") % 33 != 0), F.concat(F.lit("d"), "uid")).alias("device_id"),
                            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"), F.col("id").alias("$insert_id"), F.struct(F.when(F.col("eid") % 2 == 0, "event").alias("plan")).alias("event_properties"), F.struct("plan", "country").alias("user_properties")))
    return rows_out(im.map_amplitude(c.events.select(js.alias("value"))), "plan", "country")


@plan("import_umami", out_sql("CASE WHEN eid%11=0 THEN 'missing session_id' ELSE 'parsed' END", "CASE WHEN name='view' THEN '$pageview' ELSE name END", "CASE WHEN eid%11=0 THEN '' ELSE distinct_id END", "us//1000000*1000000", {"path": "path", "referrer": "CASE WHEN referrer IS NULL THEN '' ELSE 'ref.example' END", "device": "device"}, "eid"), base="ev")
def _(c):
    d = c.events.select(F.when(F.col("eid") % 11 != 0, F.col("distinct_id")).alias("session_id"), F.when(F.col("name") != "view", F.col("name")).alias("event_name"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                        F.col("path").alias("url_path"), F.when(F.col("referrer").isNotNull(), "ref.example").alias("referrer_domain"), "device", F.col("eid").cast("string").alias("n"))
    return rows_out(im.map_umami(d), "path", "referrer", "device")


@plan("import_payments", """WITH p AS (SELECT *, o_orderkey%4 AS v, o_orderkey%3 AS w, CASE WHEN o_orderkey%9=0 THEN 0 ELSE CAST(round(o_totalprice*100) AS BIGINT) END AS minor FROM orders)
 SELECT (['stripe','lemonsqueezy','polar','dodo'])[v+1] AS provider, CASE v WHEN 0 THEN 'ev_'||o_orderkey WHEN 1 THEN 'order_created:'||o_orderkey WHEN 2 THEN 'polar:'||o_orderkey ELSE 'dodo:'||o_orderkey END AS id, CASE w WHEN 0 THEN 'u'||o_custkey WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE 'c'||o_custkey||'@x.example' END AS distinct_id,
 CASE w WHEN 0 THEN 'metadata.distinct_id' WHEN 1 THEN 'provider_customer_id' ELSE 'email' END AS identity_source, round(minor/100,6) AS amount, (['USD','EUR'])[o_orderkey%2+1] AS currency, epoch_us(date_trunc('second',o_orderdate)) AS us FROM p WHERE minor>0 AND o_orderkey%13<>0""", base=None)
def _(c):
    o = c.table("orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    k, v, w = F.col("o_orderkey"), F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    minor = F.when(k % 9 == 0, 0).otherwise(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    skip = k % 13 == 0
    cur = pick(["usd", "eur"], k % 2)
    who, cust, mail = F.when(w == 0, F.concat(F.lit("u"), "o_custkey")), F.when(w <= 1, F.col("o_custkey").cast("string")), F.concat(F.lit("c"), "o_custkey", F.lit("@x.example"))
    iso, meta = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.struct(who.alias("distinct_id"))
    st = F.struct(F.concat(F.lit("ev_"), k).alias("id"), F.when(skip, "customer.updated").otherwise("invoice.paid").alias("type"), F.unix_seconds("ts").alias("created"),
                  F.struct(F.struct(minor.alias("amount_paid"), cur.alias("currency"), cust.alias("customer"), mail.alias("customer_email"), meta.alias("metadata")).alias("object")).alias("data"))
    ls = F.struct(F.struct(F.when(skip, "subscription_updated").otherwise("order_created").alias("event_name"), meta.alias("custom_data")).alias("meta"),
                  F.struct(k.cast("string").alias("id"), F.struct(minor.alias("total"), cur.alias("currency"), mail.alias("user_email"), F.when(w <= 1, F.col("o_custkey")).alias("customer_id"), iso.alias("created_at")).alias("attributes")).alias("data"))
    po = F.struct(F.when(skip, "subscription.active").otherwise("order.paid").alias("type"), F.struct(k.cast("string").alias("id"), minor.alias("net_amount"), (minor + 500).alias("amount"), cur.alias("currency"), iso.alias("created_at"), meta.alias("metadata"),
                  F.struct(cust.alias("id"), mail.alias("email")).alias("customer")).alias("data"))
    do = F.struct(F.when(skip, "payment.failed").otherwise("payment.succeeded").alias("type"), F.struct(k.cast("string").alias("payment_id"), minor.alias("total_amount"), cur.alias("currency"), iso.alias("created_at"), meta.alias("metadata"),
                  F.struct(cust.alias("customer_id"), mail.alias("email")).alias("customer")).alias("data"))
    body = F.when(v == 0, F.to_json(st)).when(v == 1, F.to_json(ls)).when(v == 2, F.to_json(po)).otherwise(F.to_json(do))
    p = pay.payments(o.select(pick(["stripe", "lemonsqueezy", "polar", "dodo"], v).alias("provider"), body.alias("body")))
    return p.select("provider", "id", "distinct_id", "identity_source", F.round("amount", 6).alias("amount"), "currency", F.unix_micros("timestamp").alias("us"))


# ---- snapshots -------------------------------------------------------------------------------------------
S, E = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
DIMS = ["browser", "country", "user"]


def dims_df(c):
    return c.prod.withColumn("user", F.col("distinct_id"))


@plan("daily_aggregate_snapshot", "SELECT d AS day, name, count(*) AS count, min(us) AS first_us, max(us) AS last_us FROM pev GROUP BY 1,2")
def _(c):
    return sn.daily_counts(c.events, S, E).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "name", "count", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@plan("daily_segment_counts", """SELECT d AS day, name, 'browser' AS dim, browser AS value, count(*) AS count FROM pev GROUP BY 1,2,4 UNION ALL SELECT d, name, 'country', country, count(*) FROM pev GROUP BY 1,2,4
 UNION ALL SELECT d, name, 'user', distinct_id, count(*) FROM pev WHERE name IN (SELECT name FROM pev GROUP BY 1 HAVING count(DISTINCT distinct_id)<=20) GROUP BY 1,2,4""")
def _(c):
    return sn.segment_counts(dims_df(c), S, E, DIMS, max_values=20).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


MS = """WITH h AS (SELECT d AS day, name, count(*) FILTER (WHERE k<80) AS count FROM pev WHERE d<'2024-01-22' GROUP BY 1,2), f AS (SELECT d AS day, name, count(*) AS count FROM pev WHERE d>='2024-01-18' GROUP BY 1,2)
 SELECT coalesce(f.day,h.day) AS day, coalesce(f.name,h.name) AS name, coalesce(f.count,h.count) AS count FROM h FULL JOIN f ON f.day=h.day AND f.name=h.name"""


def _merge(c, start=None, end=None):
    d = c.prod.withColumn("day", F.to_date("timestamp"))
    held = d.where("day < '2024-01-22'").groupBy("day", "name").agg(F.count(F.when(F.col("k") < 80, 1)).alias("count"))
    fresh = d.where("day >= '2024-01-18'").groupBy("day", "name").agg(F.count("*").alias("count"))
    return sn.merge(held, fresh, start, end).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@plan("merge_snapshots", MS + " WHERE coalesce(f.day,h.day)>='2024-01-10' AND coalesce(f.day,h.day)<'2024-01-29'")
def _(c):
    return _merge(c, "2024-01-10 00:00:00", "2024-01-29 00:00:00")


@plan("full_outer_snapshot", MS)
def _(c):
    return _merge(c)


EXP = """WITH b AS (SELECT d AS day, name, count(*) AS c, min(us) AS f, max(us) AS l FROM pev GROUP BY 1,2), r AS (SELECT *, unnest(range(0,c)) AS i FROM b),
 s AS (SELECT d AS day, name, browser AS value, count(*) AS n FROM pev GROUP BY 1,2,3), u AS (SELECT *, sum(n) OVER (PARTITION BY day, name ORDER BY value) AS hi FROM s)"""


@plan("expand_aggregates", EXP + """ SELECT 'agg:'||r.day||':'||r.name||':'||i AS id, r.name, CASE WHEN c=1 THEN f WHEN i=c-1 THEN l ELSE f+CAST((CAST(l-f AS HUGEINT)*i)//(c-1) AS BIGINT) END AS us, u.value AS browser FROM r JOIN u ON u.day=r.day AND u.name=r.name AND i<hi AND i>=hi-n""")
def _(c):
    b = sn.daily_counts(c.events, S, E)
    x = sn.expand(b, sn.segment_counts(c.events, S, E, ["browser"]), ["browser"], chunk=16)
    return x.select("id", "name", F.unix_micros("timestamp").alias("us"), "browser")


@plan("expand_revenue", """WITH w AS (SELECT name, count(*) AS seen, count(*) AS numeric, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-21') AS rows, count(DISTINCT CASE WHEN ts>=TIMESTAMP '2024-01-21' THEN distinct_id END) AS people, sum(CASE WHEN ts>=TIMESTAMP '2024-01-21' THEN amount END) AS total FROM pev GROUP BY 1)
 SELECT name, numeric AS events, rows AS priced, people, round(total,4) AS total FROM w""")
def _(c):
    b = sn.daily_counts(c.events, S, E)
    rev = sn.revenue_counters(c.events, S, "2024-01-21 00:00:00", E)
    x = sn.expand(b, sn.segment_counts(c.events, S, E, ["browser"]), ["browser"], rev, E, 10)
    priced = (F.col("money") != "-1.0") & (F.col("timestamp") >= "2024-01-21")
    return x.groupBy("name").agg(F.count("money").alias("events"), F.count(F.when(priced, 1)).alias("priced"), F.count_distinct(F.when(priced, F.col("distinct_id"))).alias("people"),
                                 F.round(F.sum(F.when(priced, F.col("money").cast("double"))), 4).alias("total"))


# ---- stored tables -----------------------------------------------------------------------------------------
@plan("export_events", """SELECT id, name, distinct_id, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') AS timestamp, '{"path":"'||path||'"'||CASE WHEN plan IS NOT NULL THEN ',"plan":"'||plan||'"' ELSE '' END||'}' AS properties FROM ev""", base="ev")
def _(c):
    return tb.export_rows(c.events, ["path", "plan"])


@plan("prune_retention", "SELECT d AS day, count(*) AS events FROM ev WHERE ts>=TIMESTAMP '2024-01-21' GROUP BY 1", base="ev")
def _(c):
    return tb.prune(c.events, ASOF, 10).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))


ERASE = ALIASED + ", w AS (SELECT 'u7' AS id UNION SELECT 'v3'), cn AS (SELECT w.id, coalesce(m.can, w.id) AS can FROM w LEFT JOIN m ON m.anon=w.id), el AS (SELECT id FROM cn UNION SELECT can FROM cn UNION SELECT anon FROM m WHERE can IN (SELECT can FROM cn)) "


def _erase(c):
    return aliased(c), c.spark.createDataFrame([("u7",), ("v3",)], "distinct_id string")


@plan("erase_user", ERASE + "SELECT name, count(*) AS events, count(DISTINCT distinct_id) AS users FROM src WHERE distinct_id NOT IN (SELECT id FROM el) GROUP BY 1")
def _(c):
    return counts(tb.erase(*_erase(c)))


@plan("erase_user_partitions", ERASE + "SELECT DISTINCT strftime(make_timestamp(us),'%Y-%m-%d') AS day FROM src WHERE distinct_id IN (SELECT id FROM el)")
def _(c):
    return tb.touched_days(*_erase(c)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@plan("verify_store", """WITH m AS (SELECT d, count(*) AS n, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1), r AS (SELECT d, CASE WHEN day(CAST(d AS DATE))%5=0 THEN n+1 ELSE n END AS n, CASE WHEN day(CAST(d AS DATE))%7=0 THEN lo+1 ELSE lo END AS lo, hi FROM m WHERE d<>'2024-01-11' UNION ALL SELECT '2024-02-02', 5, 0, 0)
 SELECT coalesce(m.d,r.d) AS day, CASE WHEN r.d IS NULL THEN 'orphan' WHEN m.d IS NULL THEN 'missing' WHEN m.n<>r.n THEN 'count' ELSE 'range' END AS problem, coalesce(m.n,0) AS rows, coalesce(r.n,0) AS recorded FROM m FULL JOIN r ON m.d=r.d WHERE m.d IS NULL OR r.d IS NULL OR m.n<>r.n OR m.lo<r.lo""", base="ev")
def _(c):
    m = tb.manifest(c.events)
    dom = F.dayofmonth("day")
    rec = m.where("day <> '2024-01-11'").select("day", F.when(dom % 5 == 0, F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"), F.when(dom % 7 == 0, F.col("min_us") + 1).otherwise(F.col("min_us")).alias("min_us"), "max_us")
    ghost = m.limit(1).select(F.lit("2024-02-02").cast("date").alias("day"), F.lit(5).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("min_us"), F.lit(0).cast("bigint").alias("max_us"))
    return tb.verify(c.events, rec.unionByName(ghost))
