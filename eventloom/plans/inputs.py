"""Adapters from the fixture tables to the canonical event table, and the same derivation as SQL."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.operators.scope import scope_production

ASOF = "2024-01-31 00:00:00"


def pick(values: list, at: Column) -> Column:
    """values[at] as a constant-array lookup (0-based)."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), at.cast("int") + 1)


def canonical(t: DataFrame) -> DataFrame:
    """Fixture events to canonical events with promoted columns."""
    return t.selectExpr("*", "cast(get_json_object(props, '$.k') as bigint) as k").selectExpr(
        "concat('e', event_id) as id", "event_type as name", "concat('u', user_id) as distinct_id", "cast(ts as timestamp) as timestamp",
        "value as amount", "case when k % 8 = 0 then '/checkout' else concat('/p', k % 8) end as path",
        "element_at(array('US', 'GB', 'DE', 'IN', 'ZZ'), int(user_id % 5) + 1) as country",
        "element_at(array('desktop', 'mobile'), int(user_id % 2) + 1) as device",
        "element_at(array('Chrome', 'Safari', 'Firefox'), int(k % 3) + 1) as browser",
        "element_at(array('https://www.google.com/x', 'https://t.co/', NULL, 'https://chatgpt.com/'), int(user_id % 4) + 1) as referrer",
        "case when k % 10 = 0 then 'newsletter' end as utm_source", "element_at(array('free', 'pro', NULL), int(user_id % 3) + 1) as plan",
        "case when user_id % 7 <> 0 then concat('a', user_id % 20) end as account", "case when event_id % 50 = 0 then 'development' end as env",
        "k", "user_id as uid", "event_id as eid")


_SCHEMAS: dict = {}      # path -> schema, so the footers are read once per table


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        """Canonical events with promoted columns; ``properties`` is pruned unless a query reads it."""
        return canonical(self.table("events"))

    def stream(self) -> DataFrame:
        """The same events as a file stream; as a glob the path may be one file or a folder of files."""
        t = self.spark.readStream.schema(self.table("events").schema).parquet(f"{self.dir}/[e]vents.parquet")
        return canonical(t)

    @cached_property
    def prod(self) -> DataFrame:
        return scope_production(self.events)

    @cached_property
    def web(self) -> DataFrame:
        """Production events under web names, with click and error properties."""
        named = self.prod.selectExpr("* except (name)", "case name when 'view' then '$pageview' when 'click' then '$click' when 'error' then '$exception' else name end as name")
        return named.selectExpr("*", "concat('fail ', k, ' at ', k % 4) as message", "concat('app', k % 3, '.js') as source", "k % 5 as lineno", "k * 10 % 1000 as x", "k * 7 as y",
                                "bigint(0) as sy", "bigint(element_at(array(390, 800, 1440), int(k % 3) + 1)) as vw")

    @cached_property
    def variant_events(self) -> DataFrame:
        """The same events with every property inside VARIANT, none promoted."""
        e = self.events
        props = F.parse_json(F.to_json(F.struct("amount", "path", "country", "device", "browser", "referrer",
                                                "utm_source", "plan", "account", "env")))
        return e.select("id", "name", "distinct_id", "timestamp", props.alias("properties"))


# The canonical events as DuckDB CTEs.
EV = """ev AS (SELECT 'e'||event_id AS id, event_type AS name, 'u'||user_id AS distinct_id, ts, value AS amount,
  CASE WHEN k%8=0 THEN '/checkout' ELSE '/p'||(k%8) END AS path,
  (['US','GB','DE','IN','ZZ'])[user_id%5+1] AS country, (['desktop','mobile'])[user_id%2+1] AS device,
  (['Chrome','Safari','Firefox'])[k%3+1] AS browser,
  (['https://www.google.com/x','https://t.co/',NULL,'https://chatgpt.com/'])[user_id%4+1] AS referrer,
  CASE WHEN k%10=0 THEN 'newsletter' END AS utm_source, (['free','pro',NULL])[user_id%3+1] AS plan,
  CASE WHEN user_id%7<>0 THEN 'a'||(user_id%20) END AS account,
  CASE WHEN event_id%50=0 THEN 'development' END AS env, k, user_id AS uid, event_id AS eid,
  epoch_us(ts) AS us, strftime(ts,'%Y-%m-%d') AS d, CAST(floor(epoch_us(ts)/86400000000.0) AS BIGINT) AS dn
 FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))"""
PEV = EV + ", pev AS (SELECT * FROM ev WHERE env IS NULL OR env NOT IN ('development','preview','staging','test','ci'))"
WEB = PEV + """, web AS (SELECT * REPLACE (CASE name WHEN 'view' THEN '$pageview' WHEN 'click' THEN '$click'
  WHEN 'error' THEN '$exception' ELSE name END AS name), 'fail '||k||' at '||(k%4) AS message,
  'app'||(k%3)||'.js' AS source, k%5 AS lineno, k*10%1000 AS x, k*7 AS y, 0 AS sy, ([390,800,1440])[k%3+1] AS vw FROM pev)"""
