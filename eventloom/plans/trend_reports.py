from pyspark.sql import functions as F

from eventloom.operators import engagement as en, sketches as sk, trends as tr
from eventloom.operators.filters import Filter
from eventloom.plans.inputs import ASOF
from eventloom.plans.registry import plan

S, E = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
CAL = "cal AS (SELECT strftime(b,'%Y-%m-%d') AS bucket FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(b))"
WIN = "w AS (SELECT * FROM pev WHERE ts>=TIMESTAMP '2024-01-01' AND ts<TIMESTAMP '2024-01-31')"


@plan("trend_daily", f"""WITH {CAL}, {WIN}, c AS (SELECT d AS bucket, count(*) AS n FROM w WHERE name='purchase' GROUP BY 1)
 SELECT bucket, coalesce(n,0) AS n, (SELECT count(*) FROM w WHERE name='purchase') AS total FROM cal LEFT JOIN c USING (bucket)""")
def _(c):
    return tr.trend(c.prod, "purchase", S, E)


@plan("trend_daily_unique", f"""WITH {CAL}, {WIN}, c AS (SELECT d AS bucket, count(DISTINCT distinct_id) AS n FROM w WHERE name='purchase' GROUP BY 1)
 SELECT bucket, coalesce(n,0) AS n, (SELECT count(DISTINCT distinct_id) FROM w WHERE name='purchase') AS total FROM cal LEFT JOIN c USING (bucket)""")
def _(c):
    return tr.trend(c.prod, "purchase", S, E, unique=True)


@plan("trend_interval", """WITH w AS (SELECT * FROM pev WHERE ts>=TIMESTAMP '2023-12-20' AND ts<TIMESTAMP '2024-02-05'),
 g AS (SELECT 'hour' AS grain, b, strftime(b,'%Y-%m-%d %H:%M') AS bucket FROM range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-05', INTERVAL 1 HOUR) t(b)
  UNION ALL SELECT 'week', b, strftime(b,'%Y-%m-%d') FROM range(TIMESTAMP '2023-12-18', TIMESTAMP '2024-02-05', INTERVAL 7 DAY) t(b)
  UNION ALL SELECT 'month', b, strftime(b,'%Y-%m-%d') FROM range(TIMESTAMP '2023-12-01', TIMESTAMP '2024-02-05', INTERVAL 1 MONTH) t(b)),
 c AS (SELECT grain, date_trunc(grain, ts) AS b, count(*) AS n FROM w, (VALUES ('hour'),('week'),('month')) v(grain) GROUP BY 1,2)
 SELECT g.grain, g.bucket, coalesce(n,0) AS n, (SELECT count(*) FROM w) AS total FROM g LEFT JOIN c USING (grain, b)""")
def _(c):
    parts = [tr.trend(c.prod, "", "2023-12-20 00:00:00", "2024-02-05 00:00:00", grain=g).withColumn("grain", F.lit(g))
             for g in ("hour", "week", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@plan("trend_breakdown", f"""WITH {CAL}, {WIN}, c AS (SELECT coalesce(plan,'(none)') AS value, d AS bucket, count(*) AS n FROM w WHERE name='view' GROUP BY 1,2),
 t AS (SELECT value, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1)
 SELECT value, bucket, coalesce(n,0) AS n, total FROM t CROSS JOIN cal LEFT JOIN c USING (value, bucket)""")
def _(c):
    return tr.trend_breakdown(c.prod, "view", "plan", S, E)


@plan("trend_multi", f"""WITH {CAL}, {WIN}, v AS (SELECT * FROM (VALUES ('view'),('purchase'),('never')) t(name)),
 c AS (SELECT d AS bucket, name, count(*) AS n FROM w GROUP BY 1,2)
 SELECT bucket, name, coalesce(n,0) AS n FROM cal CROSS JOIN v LEFT JOIN c USING (bucket, name)""")
def _(c):
    return tr.trend_multi(c.prod, ["view", "purchase", "never"], S, E)


_M = """count(*) AS n, round(sum(amount),6) AS sum, round(avg(amount),6) AS avg, round(min(amount),6) AS min, round(max(amount),6) AS max,
 round(median(amount),6) AS median, round(quantile_disc(amount,0.9),6) AS p90, round(quantile_disc(amount,0.95),6) AS p95, round(quantile_disc(amount,0.99),6) AS p99"""


@plan("measure_daily", f"""WITH {CAL}, {WIN}, c AS (SELECT d AS bucket, {_M} FROM w WHERE name='purchase' GROUP BY 1)
 SELECT bucket, coalesce(n,0) AS n, """ + ", ".join(f"coalesce({m},0) AS {m}" for m in tr.MEASURES) + f""" FROM cal LEFT JOIN c USING (bucket)
 UNION ALL SELECT 'total', {_M} FROM w WHERE name='purchase'""")
def _(c):
    return tr.measure(c.prod, "purchase", "amount", S, E)


@plan("measure_breakdown", f"SELECT coalesce(plan,'(none)') AS value, {_M} FROM pev WHERE name='purchase' GROUP BY 1")
def _(c):
    return tr.measure_breakdown(c.prod, "purchase", "amount", "plan")


@plan("numeric_properties", "SELECT 'amount' AS key FROM ev WHERE amount IS NOT NULL GROUP BY 1", base="ev")
def _(c):
    return tr.numeric_properties(c.variant_events)


def _xau(n):
    return f"""WITH {CAL}, p AS (SELECT DISTINCT distinct_id, dn FROM pev WHERE name IN ('view','purchase')),
 c AS (SELECT strftime(make_date(CAST(x AS INTEGER)),'%Y-%m-%d') AS bucket, distinct_id FROM (SELECT distinct_id, unnest(range(dn, dn+{n})) AS x FROM p))
 SELECT bucket, count(DISTINCT distinct_id) AS n FROM cal LEFT JOIN c USING (bucket) GROUP BY 1"""


@plan("active_users_rolling", _xau(7))
def _(c):
    return tr.active_users(c.prod.where(F.col("name").isin("view", "purchase")), 7, S, E)


@plan("property_breakdown", "SELECT coalesce(plan,'(none)') AS value, count(*) AS events, count(DISTINCT distinct_id) AS visitors FROM pev WHERE name='view' GROUP BY 1")
def _(c):
    return tr.property_breakdown(c.prod, "plan", "view")


@plan("formula_series", f"""WITH {CAL}, {WIN}, c AS (SELECT d AS bucket, count(*) FILTER (WHERE name='purchase' AND amount>330) AS p, count(*) FILTER (WHERE name='signup' AND amount>330) AS s FROM w GROUP BY 1),
 f AS (SELECT bucket, CASE WHEN coalesce(s,0)=0 THEN NULL ELSE round((p+1)/s*100,6) END AS value FROM cal LEFT JOIN c USING (bucket))
 SELECT bucket, value, value IS NOT NULL AS defined, CASE WHEN value IS NULL THEN 'division by zero' ELSE '' END AS why FROM f""")
def _(c):
    big = c.prod.withColumn("name", F.when(F.col("amount") > 330, F.col("name")).otherwise(F.concat(F.lit("small_"), "name")))
    return tr.formula({"P": tr.trend(big, "purchase", S, E), "S": tr.trend(big, "signup", S, E)}, "(P + 1) / S * 100")


@plan("inner_join_series", """WITH a AS (SELECT d AS bucket, count(*) AS n FROM pev WHERE name='view' AND amount>300 GROUP BY 1),
 b AS (SELECT d AS bucket, count(*) AS n FROM pev WHERE name='error' AND amount>340 GROUP BY 1)
 SELECT bucket, CAST(a.n-b.n AS DOUBLE) AS value, true AS defined, '' AS why FROM a JOIN b USING (bucket)""")
def _(c):
    per = lambda n, x: (c.prod.where(F.col("name") == n).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("bucket"))
                        .agg(F.count(F.when(F.col("amount") > x, 1)).alias("n")).where("n > 0"))
    return tr.formula({"A": per("view", 300), "B": per("error", 340)}, "A - B")


@plan("account_rollup", """WITH g AS (SELECT account AS value, count(*) AS events, count(DISTINCT distinct_id) AS users, max(us) AS last_us FROM pev WHERE account IS NOT NULL GROUP BY 1)
 SELECT *, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE last_us>=epoch_us(TIMESTAMP '2024-01-24')) AS active_7d,
 (SELECT count(*) FROM g WHERE last_us>=epoch_us(TIMESTAMP '2024-01-01')) AS active_30d FROM g ORDER BY events DESC, value LIMIT 50""")
def _(c):
    return en.account_rollup(c.prod, "account", ASOF)


@plan("lifecycle", """WITH u AS (SELECT DISTINCT distinct_id, dn FROM pev), f AS (SELECT distinct_id, min(dn) AS f FROM u GROUP BY 1), m AS (SELECT max(dn) AS hi FROM u),
 x AS (SELECT c.dn AS d, f.distinct_id, f.f, a.dn IS NOT NULL AS act, b.dn IS NOT NULL AS prev FROM (SELECT unnest(range(hi-13, hi+1)) AS dn FROM m) c CROSS JOIN f
  LEFT JOIN u a ON a.distinct_id=f.distinct_id AND a.dn=c.dn LEFT JOIN u b ON b.distinct_id=f.distinct_id AND b.dn=c.dn-1)
 SELECT strftime(make_date(CAST(d AS INTEGER)),'%Y-%m-%d') AS bucket, count(*) FILTER (WHERE act AND d=f) AS "new", count(*) FILTER (WHERE act AND d<>f AND prev) AS returning,
  count(*) FILTER (WHERE act AND d<>f AND NOT prev) AS resurrected, count(*) FILTER (WHERE NOT act AND prev) AS dormant FROM x GROUP BY 1""")
def _(c):
    return en.lifecycle(c.prod, 14)


@plan("stickiness", """WITH s AS (SELECT count(DISTINCT CASE WHEN ts>=TIMESTAMP '2024-01-30' THEN distinct_id END) AS dau, count(DISTINCT CASE WHEN ts>=TIMESTAMP '2024-01-24' THEN distinct_id END) AS wau,
 count(DISTINCT CASE WHEN ts>=TIMESTAMP '2024-01-01' THEN distinct_id END) AS mau FROM pev) SELECT *, round(dau/mau,6) AS dau_over_mau FROM s""")
def _(c):
    return en.stickiness(c.prod, ASOF)


@plan("compare_windows", """WITH d AS (SELECT *, ts>=TIMESTAMP '2024-01-24' AS cur FROM web WHERE ts>=TIMESTAMP '2024-01-17' AND ts<TIMESTAMP '2024-01-31'),
 m AS (SELECT 'purchase' AS metric, count(*) FILTER (WHERE cur) AS current, count(*) FILTER (WHERE NOT cur) AS prior FROM d WHERE name='purchase'
  UNION ALL SELECT 'pageviews', count(*) FILTER (WHERE cur), count(*) FILTER (WHERE NOT cur) FROM d WHERE name='$pageview'
  UNION ALL SELECT 'visitors', count(DISTINCT CASE WHEN cur THEN distinct_id END), count(DISTINCT CASE WHEN NOT cur THEN distinct_id END) FROM d WHERE name='$pageview')
 SELECT *, round((current-prior)/prior*100) AS delta_pct FROM m""", base="web")
def _(c):
    return en.compare_windows(c.web, ["purchase"], ("2024-01-24 00:00:00", E), ("2024-01-17 00:00:00", "2024-01-24 00:00:00"))


@plan("segment_vs_segment", """WITH m AS (SELECT DISTINCT distinct_id FROM pev WHERE browser='Chrome' AND name='view')
 SELECT count(*) FILTER (WHERE u.a) AS a, count(*) FILTER (WHERE path='/checkout') AS b, count(*) FILTER (WHERE u.a AND path='/checkout') AS both
 FROM pev JOIN (SELECT distinct_id, bool_or(coalesce(utm_source='newsletter',false)) AS a FROM pev GROUP BY 1) u USING (distinct_id) WHERE name='purchase'""")
def _(c):
    return en.segment_vs_segment(c.prod, "purchase", Filter("utm_source", "eq", "newsletter"), Filter("path", "eq", "/checkout"))


@plan("segment_visitors", """SELECT coalesce(u,'(none)') AS value, count(*) AS visitors FROM (SELECT distinct_id, arg_min(struct_pack(u:=utm_source), us).u AS u FROM web WHERE name='$pageview' GROUP BY 1) GROUP BY 1""", base="web")
def _(c):
    return en.segment_visitors(c.web, "utm_source")


@plan("site_pulse", """WITH d AS (SELECT coalesce(account,'') AS site, distinct_id, ts>=TIMESTAMP '2024-01-24' AS cur FROM pev WHERE ts>=TIMESTAMP '2024-01-17'),
 s AS (SELECT site, count(*) FILTER (WHERE cur) AS events, count(DISTINCT CASE WHEN cur THEN distinct_id END) AS visitors, count(*) FILTER (WHERE NOT cur) AS prior_events,
  count(DISTINCT CASE WHEN NOT cur THEN distinct_id END) AS prior_visitors FROM d GROUP BY 1)
 SELECT CASE WHEN site='' THEN '(no site)' ELSE site END AS site, events, visitors, prior_events, prior_visitors FROM s
 WHERE site<>'' OR events*50>=(SELECT sum(events) FROM s)""")
def _(c):
    return en.site_pulse(c.prod, "account", ASOF, 7)


@plan("fixed_period_counts", """SELECT h.h AS hour, count(w.name) AS n FROM range(24) h(h) LEFT JOIN web w ON hour(ts)=h.h AND name='$pageview' GROUP BY 1""", base="web")
def _(c):
    return tr.hours_of_day(c.web)


# ---- sketches: estimates beside exact counts ---------------------------------------------------
@plan("unique_sketches", """SELECT 'day' AS span, d AS day, name, count(*) AS n, count(DISTINCT distinct_id) AS people, TRUE AS within FROM pev GROUP BY d, name
 UNION ALL SELECT 'window', NULL, name, count(*), count(DISTINCT distinct_id), TRUE FROM pev WHERE ts>=TIMESTAMP '2024-01-08' AND ts<TIMESTAMP '2024-01-22' GROUP BY name
 UNION ALL SELECT 'all', NULL, NULL, count(*), count(DISTINCT distinct_id), TRUE FROM pev""")
def _(c):
    """Per day, over two weeks and over everything, from one table of sketches; ``within``: the estimate is in its bound, and the counts agree."""
    s = sk.merge(sk.daily(c.prod.where("k % 2 = 0")), sk.daily(c.prod.where("k % 2 <> 0 or k is null")))     # two batches, united
    day = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    exact = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("distinct_id").alias("people"))
    lo, hi = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
    prod = c.prod.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    spans = [("day", sk.estimate(s, "day", "name").withColumn("day", day), exact(prod, "day", "name")),
             ("window", sk.estimate(sk.window(s, lo, hi), "name").withColumn("day", none), exact(prod.where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi)), "name").withColumn("day", none)),
             ("all", sk.estimate(s).withColumns({"day": none, "name": none}), exact(prod).withColumns({"day": none, "name": none}))]
    out = None
    for span, guess, sure in spans:
        g = guess.select(F.col("day").alias("_d"), F.col("name").alias("_m"), F.col("n").alias("_n"), F.col("people").alias("_p"))
        j = sure.join(g, F.col("day").eqNullSafe(F.col("_d")) & F.col("name").eqNullSafe(F.col("_m")), "left")
        rows = j.select(F.lit(span).alias("span"), "day", "name", "n", "people", F.coalesce(sk.within(F.col("_p"), F.col("people")) & (F.col("n") == F.col("_n")), F.lit(False)).alias("within"))
        out = rows if out is None else out.unionByName(rows)
    return out


@plan("active_users_sketch", f"SELECT *, TRUE AS within FROM ({_xau(7)})")
def _(c):
    """Rolling actives by uniting seven days' sketches, beside the exact ones."""
    some = c.prod.where(F.col("name").isin("view", "purchase"))
    guess = sk.rolling(sk.daily(some), 7, S, E).select(F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("_b"), "people")
    return tr.active_users(some, 7, S, E).join(guess, F.col("bucket") == F.col("_b"), "left").select("bucket", "n", F.coalesce(sk.within(F.col("people"), F.col("n")), F.lit(False)).alias("within"))
