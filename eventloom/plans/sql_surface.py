from pyspark.sql import functions as F

from eventloom.functions import scalars as sc
from eventloom.operators.sqlview import sql
from eventloom.plans.registry import SQL, plan


@plan("sql_project_filter", "SELECT id, name, amount, path FROM pev WHERE path='/checkout' AND amount>100 AND name IN ('view','click')")
def _(c):
    return sql(c.events, "SELECT id, name, amount, path FROM {events} WHERE path = '/checkout' AND amount > 100 AND name IN ('view','click')", cap=None)


@plan("sql_project_filter_env", "SELECT name, count(*) AS n FROM ev WHERE env='development' GROUP BY 1", base="ev")
def _(c):
    return sql(c.events, "SELECT name, count(*) AS n FROM {events} WHERE env = 'development' GROUP BY name", cap=None)


@plan("sql_group_aggregate", """SELECT coalesce(plan,'') AS plan, count(*) AS n, count(utm_source) AS tagged, count(DISTINCT distinct_id) AS users, round(sum(amount),6) AS total, CAST(0 AS DOUBLE) AS text_sum, round(avg(amount),6) AS mean, round(min(amount),6) AS lo, round(max(amount),6) AS hi FROM pev GROUP BY 1
 UNION ALL SELECT 'nobody', 0, 0, 0, NULL, NULL, NULL, NULL, NULL""")
def _(c):
    def agg(d, *keys):
        x, t = F.col("amount"), sc.num(F.col("path"))
        return d.groupBy(*keys).agg(F.count("*").alias("n"), F.count("utm_source").alias("tagged"), F.count_distinct("distinct_id").alias("users"), F.round(sc.sum_(x), 6).alias("total"),
                                    sc.sum_(t).alias("text_sum"), F.round(F.avg(x), 6).alias("mean"), F.round(F.min(x), 6).alias("lo"), F.round(F.max(x), 6).alias("hi"))
    nobody = agg(c.prod.where("name = 'nobody'")).withColumn("plan", F.lit("nobody"))
    return agg(c.prod, F.coalesce("plan", F.lit("")).alias("plan")).unionByName(nobody)


@plan("sql_having", "SELECT distinct_id, count(*) AS n FROM pev GROUP BY 1 HAVING count(*)>70 AND sum(amount)>3000")
def _(c):
    return sql(c.events, "SELECT distinct_id, count(*) AS n FROM {events} GROUP BY distinct_id HAVING count(*) > 70 AND sum(amount) > 3000", cap=None)


@plan("sql_order_limit", """(SELECT 'asc' AS dir, id, coalesce(utm_source,'') AS utm, row_number() OVER (ORDER BY utm_source ASC NULLS LAST, amount DESC, id) AS pos FROM pev ORDER BY pos LIMIT 50)
 UNION ALL (SELECT 'desc', id, coalesce(utm_source,''), row_number() OVER (ORDER BY utm_source DESC NULLS LAST, amount DESC, id) AS pos FROM pev ORDER BY pos LIMIT 50)""")
def _(c):
    def run(tag, order):
        top = c.prod.orderBy(order, F.desc("amount"), "id").limit(50)
        # fifty rows from here on
        from pyspark.sql import Window as W
        w = W.partitionBy(F.lit(0)).orderBy(order, F.desc("amount"), "id")
        return top.select(F.lit(tag).alias("dir"), "id", F.coalesce("utm_source", F.lit("")).alias("utm"), F.row_number().over(w).cast("bigint").alias("pos"))
    return run("asc", F.asc_nulls_last("utm_source")).unionByName(run("desc", F.desc_nulls_last("utm_source")))


@plan("sql_compare", """SELECT count(*) FILTER (WHERE plan='pro') AS eq, count(*) FILTER (WHERE plan IS NOT NULL AND plan<>'pro') AS ne, count(*) FILTER (WHERE plan IS NULL OR plan<>'pro') AS not_eq, count(*) FILTER (WHERE k>9) AS num_gt, count(*) FILTER (WHERE CAST(k AS VARCHAR)>'9') AS text_gt,
 count(*) FILTER (WHERE country<'5') AS mixed, count(*) FILTER (WHERE ts>=TIMESTAMP '2024-01-10 00:00:00') AS since FROM pev""")
def _(c):
    p, k = F.col("plan"), F.col("k").cast("string")
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return c.prod.agg(n(sc.compare("=", p, "pro"), "eq"), n(sc.compare("!=", p, "pro"), "ne"), n(~sc.compare("=", p, "pro"), "not_eq"), n(sc.compare(">", k, 9), "num_gt"), n(sc.compare(">", k, "9"), "text_gt"),
                      n(sc.compare("<", F.col("country"), 5), "mixed"), n(sc.compare(">=", F.col("timestamp"), "2024-01-10 00:00:00", "time"), "since"))


@plan("sql_in_isnull_like_bool", """SELECT count(*) FILTER (WHERE plan IN ('pro','free')) AS in_list, count(*) FILTER (WHERE plan IS NULL OR plan='pro') AS in_empty, count(*) FILTER (WHERE plan IS NULL) AS nulls, count(*) FILTER (WHERE path LIKE '/p_') AS like_one, count(*) FILTER (WHERE path LIKE '%out') AS like_tail,
 count(*) FILTER (WHERE path LIKE '/CHECK%') AS like_case, count(*) FILTER (WHERE utm_source IS NOT NULL AND amount>50 OR country='US') AS both FROM pev""")
def _(c):
    p = F.col("plan")
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    path = F.col("path")
    return c.prod.agg(n(sc.in_list(p, ["pro", "free"]), "in_list"), n(sc.in_list(p, ["", "pro"]), "in_empty"), n(p.isNull(), "nulls"), n(sc.like(path, "/p_"), "like_one"), n(sc.like(path, "%out"), "like_tail"), n(sc.like(path, "/CHECK%"), "like_case"),
                      n((F.col("utm_source").isNotNull() & sc.compare(">", F.col("amount"), 50, "number")) | sc.compare("=", F.col("country"), "US"), "both"))


@plan("sql_arith", """SELECT name, round(sum(amount+k-1),6) AS plus_, round(sum(amount*2),6) AS times, round(sum(CASE WHEN k%5<>0 THEN amount/(k%5) END),6) AS divided, CAST(sum(CASE WHEN k%7<>0 THEN uid%(k%7) END) AS DOUBLE) AS mod_, count(*) FILTER (WHERE k%5=0) AS undefined FROM pev GROUP BY 1""")
def _(c):
    a, k = F.col("amount"), F.col("k").cast("double")
    r5, r7 = (F.col("k") % 5).cast("double"), (F.col("k") % 7).cast("double")
    bad = sc.arith("+", a, sc.num(F.col("path")))          # a path is no number, so the sum is NULL
    return c.prod.groupBy("name").agg(F.round(F.sum(sc.arith("-", sc.arith("+", a, k), F.lit(1.0))), 6).alias("plus_"), F.round(F.sum(sc.arith("*", a, F.lit(2.0))), 6).alias("times"),
                                      F.round(F.sum(sc.arith("/", a, r5)), 6).alias("divided"), F.sum(sc.arith("%", F.col("uid").cast("double"), r7)).alias("mod_"),
                                      F.count(F.when(bad.isNull() & sc.arith("/", a, r5).isNull(), 1)).alias("undefined"))


@plan("sql_datetime", """SELECT strftime(ts,'%Y-%m-%d') AS d, strftime(ts,'%Y-%m-%d %H:00') AS h, strftime(date_trunc('week',ts),'%Y-%m-%d') AS w, strftime(ts,'%Y-%m') AS m, CAST(year(ts) AS DOUBLE) AS y, count(*) AS n FROM pev GROUP BY ALL""")
def _(c):
    t = F.col("timestamp")
    return c.prod.groupBy(sc.date_(t).alias("d"), sc.hour_(t).alias("h"), sc.week_(t).alias("w"), sc.month_(t).alias("m"), sc.year_(t).alias("y")).agg(F.count("*").alias("n"))


@plan("sql_string", """SELECT lower(path) AS lo, upper(path) AS up, CAST(strlen(text) AS DOUBLE) AS len, text||'-'||coalesce(plan,'') AS cat, replace(path,'/p','/q') AS rep, substr(path,2,3) AS s1, path AS s0, '' AS sneg, count(*) AS n
 FROM (SELECT *, CASE WHEN k%3=0 THEN 'naïve '||k ELSE 'plain' END AS text FROM pev) GROUP BY ALL""")
def _(c):
    p = F.col("path")
    d = c.prod.withColumn("text", F.when(F.col("k") % 3 == 0, F.concat(F.lit("naïve "), "k")).otherwise("plain"))
    return d.groupBy(F.lower(sc.text(p)).alias("lo"), F.upper(sc.text(p)).alias("up"), sc.length(F.col("text")).alias("len"), sc.concat(F.col("text"), "-", F.col("plan")).alias("cat"), F.replace(p, F.lit("/p"), F.lit("/q")).alias("rep"),
                     sc.substr(p, 2, 3).alias("s1"), sc.substr(p, 0).alias("s0"), sc.substr(p, -2).alias("sneg")).agg(F.count("*").alias("n"))


@plan("sql_math", """SELECT name, round(sum(abs(amount-40)),6) AS ab, round(sum(sign(amount-40)*floor(abs(amount-40)*10+0.5)/10),4) AS rd, count(DISTINCT coalesce(plan,utm_source,'none')) AS co, CAST(sum(k) AS DOUBLE) AS cn FROM pev GROUP BY 1""")
def _(c):
    a = F.col("amount") - 40
    return c.prod.groupBy("name").agg(F.round(F.sum(F.abs(a)), 6).alias("ab"), F.round(F.sum(sc.round_(a, 1)), 4).alias("rd"), F.count_distinct(F.coalesce("plan", "utm_source", F.lit("none"))).alias("co"), F.sum(sc.num(F.col("k").cast("string"))).alias("cn"))


# ---- the same semantics from query text --------------------------------------------------------
@plan("sql_compare_text", SQL["sql_compare"], base=None)
def _(c):
    return sql(c.events, """SELECT count_if(ev_compare(plan, '=', 'pro')) AS eq, count_if(ev_compare(plan, '!=', 'pro')) AS ne, count_if(NOT ev_compare(plan, '=', 'pro')) AS not_eq,
 count_if(ev_compare_numbers(CAST(k AS STRING), '>', '9')) AS num_gt, count_if(ev_compare(CAST(k AS STRING), '>', '9')) AS text_gt, count_if(ev_compare_numbers(country, '<', '5')) AS mixed,
 count_if(ev_compare_times(timestamp, '>=', TIMESTAMP '2024-01-10 00:00:00')) AS since FROM {events}""")


@plan("sql_arith_text", SQL["sql_arith"], base=None)
def _(c):
    return sql(c.events, """SELECT name, round(sum(ev_arith(ev_arith(amount, '+', k), '-', 1)), 6) AS plus_, round(sum(ev_arith(amount, '*', 2)), 6) AS times, round(sum(ev_arith(amount, '/', k % 5)), 6) AS divided,
 sum(ev_arith(uid, '%', k % 7)) AS mod_, count_if(ev_arith(amount, '+', ev_number(path)) IS NULL AND ev_arith(amount, '/', k % 5) IS NULL) AS undefined FROM {events} GROUP BY name""")


@plan("sql_datetime_text", SQL["sql_datetime"], base=None)
def _(c):
    return sql(c.events, "SELECT ev_date(timestamp) AS d, ev_hour(timestamp) AS h, ev_week(timestamp) AS w, ev_month(timestamp) AS m, ev_year(timestamp) AS y, count(*) AS n FROM {events} GROUP BY ALL")


@plan("sql_string_text", SQL["sql_string"], base=None)
def _(c):
    return sql(c.events, """WITH t AS (SELECT *, CASE WHEN k % 3 = 0 THEN concat('naïve ', k) ELSE 'plain' END AS text FROM {events})
 SELECT lower(path) AS lo, upper(path) AS up, ev_length(text) AS len, ev_concat(ev_concat(text, '-'), plan) AS cat, replace(path, '/p', '/q') AS rep, ev_substr(path, 2, 3) AS s1, ev_substr(path, 0, -1) AS s0, ev_substr(path, -2, -1) AS sneg, count(*) AS n
 FROM t GROUP BY ALL""")


@plan("sql_math_text", SQL["sql_math"], base=None)
def _(c):
    return sql(c.events, """SELECT name, round(sum(abs(amount - 40)), 6) AS ab, round(sum(ev_round(amount - 40, 1)), 4) AS rd, count(DISTINCT coalesce(plan, utm_source, 'none')) AS co, sum(ev_number(CAST(k AS STRING))) AS cn FROM {events} GROUP BY name""")
