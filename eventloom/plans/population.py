from pyspark.sql import functions as F

from eventloom.functions import values as v
from eventloom.operators import cohorts, filters as flt, identity as idn, scope
from eventloom.operators.filters import Filter
from eventloom.plans.registry import plan

# ---- the eleven filters, on VARIANT properties -------------------------------------------------
_FILTERS = {
    "filter_eq": (Filter("referrer", "eq", "google.com"), "referrer LIKE '%google.com%'"),
    "filter_neq": (Filter("plan", "neq", "pro"), "plan IS NULL OR plan<>'pro'"),
    "filter_contains": (Filter("path", "contains", "check"), "contains(path,'check')"),
    "filter_ncontains": (Filter("utm_source", "ncontains", "news"), "utm_source IS NULL"),
    "filter_gt": (Filter("amount", "gt", 75.5), "amount>75.5"),
    "filter_lt": (Filter("amount", "lt", 25), "amount<25"),
    "filter_in": (Filter("country", "in", ["US", "DE"]), "country IN ('US','DE')"),
    "filter_notin": (Filter("plan", "notin", ["free"]), "plan IS NULL OR plan NOT IN ('free')"),
    "filter_set": (Filter("account", "set"), "account IS NOT NULL"),
    "filter_notset": (Filter("plan", "notset"), "plan IS NULL"),
    "filter_regex": (Filter("path", "regex", "^/p[1-3]$"), "path IN ('/p1','/p2','/p3')"),
}
COUNTS = "SELECT name, count(*) AS events, count(DISTINCT distinct_id) AS users"


def counts(df):
    return df.groupBy("name").agg(F.count("*").alias("events"), F.count_distinct("distinct_id").alias("users"))


def _register(key, f, where):
    @plan(key, f"{COUNTS} FROM pev WHERE {where} GROUP BY 1")
    def _(c):
        return counts(flt.apply(c.variant_events, [f]))


for _k, (_f, _w) in _FILTERS.items():
    _register(_k, _f, _w)


@plan("filter_all_any", f"""SELECT 'all' AS mode, count(*) AS events FROM pev WHERE country='US' AND amount>50
 UNION ALL SELECT 'any', count(*) FROM pev WHERE country='US' OR plan='pro'
 UNION ALL SELECT 'any_env', count(*) FROM ev WHERE coalesce(env='development',false) OR plan='pro'""")
def _(c):
    def n(mode, filters, any_mode):
        return flt.apply(c.events, filters, any_mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("events"))
    pro = Filter("plan", "eq", "pro")
    return (n("all", [Filter("country", "eq", "US"), Filter("amount", "gt", 50)], False)
            .unionByName(n("any", [Filter("country", "eq", "US"), pro], True))
            .unionByName(n("any_env", [Filter("env", "eq", "development"), pro], True)))


@plan("validate_filters", "SELECT 'plann' AS prop, 'account,amount,browser,country,device,env,path,plan,referrer,utm_source' AS known")
def _(c):
    ask = [Filter("plann", "eq", "pro"), Filter("plan", "eq", "pro"), Filter("colour", "neq", "red")]
    flt.validate(ask)
    return flt.unknown_properties(c.variant_events, ask)


@plan("scope_production", COUNTS + " FROM pev GROUP BY 1")
def _(c):
    return counts(scope.scope_production(c.variant_events))


SAMPLED = "SELECT * REPLACE (CASE WHEN name='error' AND k<30 THEN '$ai_crawl' WHEN name='error' AND k<60 THEN '$geo_check' ELSE name END AS name) FROM pev"


def sampled(c):
    err = F.col("name") == "error"
    return c.prod.withColumn("name", F.when(err & (F.col("k") < 30), "$ai_crawl").when(err & (F.col("k") < 60), "$geo_check")
                             .otherwise(F.col("name")))


@plan("drop_sampler_events", f"WITH s AS ({SAMPLED}) {COUNTS} FROM s WHERE name NOT IN ('$ai_crawl','$geo_check','$site_readable') GROUP BY 1")
def _(c):
    return counts(scope.drop_sampler(sampled(c)))


@plan("scope_users", COUNTS + " FROM ev SEMI JOIN (SELECT distinct_id FROM pev WHERE amount>340) USING (distinct_id) GROUP BY 1")
def _(c):
    return counts(flt.scope_users(c.events, [Filter("amount", "gt", 340)]))


TOUCH = """WITH t AS (SELECT distinct_id, arg_min(browser,us) AS browser, arg_min(path,us) AS path,
  arg_min(utm_source,us) FILTER (WHERE utm_source IS NOT NULL) AS utm_source,
  arg_min(replace(regexp_replace(split_part(regexp_replace(referrer,'^https://',''),'/',1),'^www\\.',''),'x','x'),us) FILTER (WHERE referrer IS NOT NULL) AS referrer
  FROM pev GROUP BY 1) """


@plan("first_touch_stamp", TOUCH + """SELECT e.name, t.browser, t.path, coalesce(t.utm_source,'') AS utm_source, coalesce(t.referrer,'') AS referrer,
  count(*) AS events, count(DISTINCT e.distinct_id) AS users FROM pev e JOIN t USING (distinct_id) GROUP BY ALL""")
def _(c):
    s = idn.stamp_first_touch(c.prod, ["browser", "path", "utm_source", "referrer"])
    keys = ["name", "browser", "path", F.coalesce("utm_source", F.lit("")).alias("utm_source"),
            F.coalesce("referrer", F.lit("")).alias("referrer")]
    return s.groupBy(*keys).agg(F.count("*").alias("events"), F.count_distinct("distinct_id").alias("users"))


@plan("stamp_for_filters", """WITH t AS (SELECT distinct_id, coalesce(arg_min(browser,us) FILTER (WHERE browser='Safari'), arg_min(browser,us)) AS b FROM pev GROUP BY 1)
 SELECT e.name, t.b AS browser, count(*) AS events FROM pev e JOIN t USING (distinct_id) GROUP BY 1,2""")
def _(c):
    s = idn.stamp_for_filters(c.prod, [Filter("browser", "eq", "Safari"), Filter("plan", "eq", "pro")])
    return s.groupBy("name", "browser").agg(F.count("*").alias("events"))


@plan("referrer_host", r"""SELECT coalesce(regexp_replace(split_part(regexp_replace(referrer,'^https://',''),'/',1),'^www\.',''),'') AS host,
  coalesce(nullif(regexp_replace(split_part(regexp_replace(referrer,'^https://',''),'/',1),'^www\.',''),''),'direct') AS web_host, count(*) AS events FROM pev GROUP BY 1,2""")
def _(c):
    return c.prod.groupBy(F.coalesce(v.host(F.col("referrer")), F.lit("")).alias("host"),
                          v.referrer_host(F.col("referrer")).alias("web_host")).agg(F.count("*").alias("events"))


CHANNEL = r"""coalesce(regexp_replace(split_part(regexp_replace(referrer,'^https://',''),'/',1),'^www\.',''), utm_source, 'direct')"""


@plan("channel_of", f"SELECT {CHANNEL} AS channel, count(*) AS events FROM pev GROUP BY 1")
def _(c):
    return c.prod.groupBy(idn.channel(c.prod).alias("channel")).agg(F.count("*").alias("events"))


# ---- aliases: signup identifies a visitor id, some purchases merge a person into a member id ------
ALIASED = """WITH src AS (SELECT id, us, CASE name WHEN 'signup' THEN '$identify' WHEN 'purchase' THEN '$create_alias' ELSE name END AS name,
   CASE WHEN name='purchase' THEN 'm'||(uid%10) WHEN name='view' THEN 'v'||k ELSE distinct_id END AS distinct_id,
   CASE WHEN name='signup' THEN 'v'||k WHEN name='purchase' AND k<20 THEN distinct_id END AS anon FROM pev),
 e AS (SELECT id, us, anon, distinct_id AS can FROM src WHERE anon IS NOT NULL),
 r AS (SELECT e.anon, e.us, e.id, coalesce((SELECT arg_max(p.can, p.us) FROM e p WHERE p.anon=e.can AND p.us<e.us), e.can) AS can FROM e),
 m AS (SELECT anon, arg_max(can, us) AS can FROM r GROUP BY 1) """


def aliased(c):
    k, n = F.col("k"), F.col("name")
    kind = F.when(n == "signup", "$identify").when(n == "purchase", "$create_alias").otherwise(n)
    who = (F.when(n == "purchase", F.concat(F.lit("m"), F.col("uid") % 10)).when(n == "view", F.concat(F.lit("v"), k))
           .otherwise(F.col("distinct_id")))
    return c.prod.select("id", kind.alias("name"), who.alias("distinct_id"), "timestamp",
                         F.when(n == "signup", F.concat(F.lit("v"), k)).alias("$anon_distinct_id"),
                         F.when((n == "purchase") & (k < 20), F.col("distinct_id")).alias("alias"))


@plan("alias_resolve", ALIASED + """SELECT coalesce(m.can, s.distinct_id) AS distinct_id, s.name, count(*) AS events
 FROM src s LEFT JOIN m ON s.distinct_id=m.anon GROUP BY 1,2""")
def _(c):
    e = aliased(c)
    return (idn.resolve_aliases(e, idn.alias_map(idn.alias_edges(e))).groupBy("distinct_id", "name")
            .agg(F.count("*").alias("events")))


DEFINITIONS = [idn.Definition("opened checkout", "$pageview", (("path", "prefix", "/CHECK"),)),
               idn.Definition("clicked p page", "$click", (("path", "contains", "/p"),)),
               idn.Definition("p1 view", "$pageview", (("path", "equals", "/p1"),))]


@plan("defined_events", """WITH d AS (SELECT id, name, distinct_id FROM web
 UNION ALL SELECT id||'#opened checkout','opened checkout',distinct_id FROM web WHERE name='$pageview' AND path='/checkout'
 UNION ALL SELECT id||'#clicked p page','clicked p page',distinct_id FROM web WHERE name='$click' AND contains(path,'/p')
 UNION ALL SELECT id||'#p1 view','p1 view',distinct_id FROM web WHERE name='$pageview' AND path='/p1')
 SELECT name, count(*) AS events, count(DISTINCT id) AS ids, count(DISTINCT distinct_id) AS users FROM d GROUP BY 1""", base="web")
def _(c):
    return (idn.defined_events(c.web, DEFINITIONS).groupBy("name")
            .agg(F.count("*").alias("events"), F.count_distinct("id").alias("ids"), F.count_distinct("distinct_id").alias("users")))


# ---- people: signups identify, purchases carry a nested $set ------------------------------------
TRAITS = """WITH kv AS (
  SELECT distinct_id, us, 'plan' AS trait, plan AS value FROM pev WHERE name='signup' AND plan IS NOT NULL
  UNION ALL SELECT distinct_id, us, 'seg', CAST(k%4 AS VARCHAR) FROM pev WHERE name='signup'
  UNION ALL SELECT distinct_id, us, 'tier', 't'||(k%3) FROM pev WHERE name='purchase'
  UNION ALL SELECT distinct_id, us, 'seg', CAST(k%5 AS VARCHAR) FROM pev WHERE name='purchase'),
 tr AS (SELECT distinct_id, trait, arg_max(value, us) AS value FROM kv GROUP BY 1,2) """


def people_events(c):
    n, k = F.col("name"), F.col("k")
    ident = F.to_json(F.struct("plan", (k % 4).alias("seg"), "path", "env"))
    bought = F.to_json(F.struct("amount", F.struct(F.concat(F.lit("t"), k % 3).alias("tier"), (k % 5).alias("seg")).alias("$set")))
    props = F.when(n == "signup", ident).when(n == "purchase", bought).otherwise(F.to_json(F.struct("path")))
    return c.prod.select("id", F.when(n == "signup", "$identify").otherwise(n).alias("name"), "distinct_id", "timestamp",
                         F.parse_json(props).alias("properties"))


@plan("person_profiles", TRAITS + """SELECT p.distinct_id, first_us, last_us, events, coalesce(a.value,'') AS plan, coalesce(b.value,'') AS seg, coalesce(t.value,'') AS tier
 FROM (SELECT distinct_id, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM pev GROUP BY 1) p
 LEFT JOIN tr a ON a.distinct_id=p.distinct_id AND a.trait='plan' LEFT JOIN tr b ON b.distinct_id=p.distinct_id AND b.trait='seg'
 LEFT JOIN tr t ON t.distinct_id=p.distinct_id AND t.trait='tier'""")
def _(c):
    tr = lambda k: F.coalesce(F.element_at("traits", k), F.lit("")).alias(k)
    return idn.profiles(people_events(c)).select("distinct_id", F.unix_micros("first_seen").alias("first_us"),
                                                 F.unix_micros("last_seen").alias("last_us"), "events", tr("plan"), tr("seg"), tr("tier"))


@plan("people_list", "SELECT distinct_id, max(us) AS last_us, count(*) AS events FROM pev GROUP BY 1 ORDER BY last_us DESC, distinct_id LIMIT 100")
def _(c):
    return idn.people_list(idn.profiles(people_events(c)), 100).select("distinct_id", F.unix_micros("last_seen").alias("last_us"), "events")


@plan("trait_values", TRAITS + "SELECT value, count(*) AS people FROM tr WHERE trait='seg' GROUP BY 1")
def _(c):
    return idn.trait_values(idn.traits(people_events(c)), "seg")


@plan("trait_keys", TRAITS + "SELECT trait AS value, count(*) AS people FROM tr GROUP BY 1")
def _(c):
    return idn.trait_keys(idn.traits(people_events(c)))


@plan("people_matching", TRAITS + "SELECT distinct_id FROM tr WHERE trait='tier' AND value='t1'")
def _(c):
    return idn.people_matching(idn.traits(people_events(c)), "tier", "t1")


# ---- account grain ------------------------------------------------------------------------------
@plan("regroup_accounts", """WITH t AS (SELECT distinct_id, arg_min(account,us) FILTER (WHERE account IS NOT NULL) AS account FROM pev GROUP BY 1)
 SELECT t.account AS distinct_id, e.name, count(*) AS events FROM pev e JOIN t USING (distinct_id) WHERE t.account IS NOT NULL GROUP BY 1,2""")
def _(c):
    return idn.regroup_accounts(c.prod, "account").groupBy("distinct_id", "name").agg(F.count("*").alias("events"))


@plan("regroup_coverage", """SELECT count(DISTINCT account) AS groups, count(*) FILTER (WHERE account IS NOT NULL) AS kept,
 count(*) FILTER (WHERE account IS NULL) AS dropped, count(DISTINCT CASE WHEN account IS NULL THEN distinct_id END) AS unattributed FROM pev""")
def _(c):
    return idn.grain_report(c.prod, "account")


# ---- joins ----------------------------------------------------------------------------------------
@plan("semi_join_population", TRAITS + COUNTS + " FROM pev SEMI JOIN (SELECT distinct_id FROM tr WHERE trait='plan' AND value='pro') USING (distinct_id) GROUP BY 1")
def _(c):
    return counts(cohorts.keep_members(c.prod, idn.people_matching(idn.traits(people_events(c)), "plan", "pro")))


@plan("anti_join_gap", """SELECT path, count(*) AS views FROM web w WHERE name='$pageview' AND NOT EXISTS
 (SELECT 1 FROM web x WHERE x.name='$click' AND x.k%11=0 AND x.path=w.path AND x.uid=w.uid) GROUP BY 1""", base="web")
def _(c):
    fetched = c.web.where("name = '$click' and k % 11 = 0").select("path", "uid").distinct()
    return (c.web.where("name = '$pageview'").join(fetched, ["path", "uid"], "left_anti").groupBy("path").agg(F.count("*").alias("views")))
