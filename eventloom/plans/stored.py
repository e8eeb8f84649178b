"""Reports over events stored by person; blocks are small, so that people on both sides of the limit occur."""
import uuid

from pyspark.sql import functions as F

from eventloom.operators import funnel as fn, identity as idn, sessions as se
from eventloom.plans.population import TOUCH
from eventloom.plans.registry import plan
from eventloom.plans.sequences import CHAIN, H6, SESS, STEP_ROWS, STEPS
from eventloom.sources import people
from eventloom.streaming.jobs import work_dir

BLOCK = 64


def stored(c, events):
    return people.write(events, work_dir(c.spark, "people"), f"people_{uuid.uuid4().hex}", buckets=8, rows_per_block=BLOCK)


@plan("people_store_funnel", CHAIN + STEP_ROWS)
def _(c):
    s = stored(c, c.prod.select("id", "name", "distinct_id", "timestamp"))
    return fn.step_table(s.per_person(lambda d, rows: fn.outcomes(d, STEPS, H6, block_rows=rows)), STEPS)


@plan("people_store_sessions", SESS.format(t="web") + "SELECT * FROM ss", base="web")
def _(c):
    s = stored(c, c.web.select("id", "name", "distinct_id", "timestamp", "path"))
    return s.per_person(lambda d, rows: se.sessions(d, block_rows=rows))


@plan("people_store_first_touch", TOUCH + """SELECT e.name, t.browser, t.path, coalesce(t.utm_source,'') AS utm_source, coalesce(t.referrer,'') AS referrer,
  count(*) AS events, count(DISTINCT e.distinct_id) AS users FROM pev e JOIN t USING (distinct_id) GROUP BY ALL""")
def _(c):
    props = ["browser", "path", "utm_source", "referrer"]
    s = stored(c, c.prod.select("id", "name", "distinct_id", "timestamp", *props)).each(lambda d: idn.stamp_first_touch(d, props))
    text = [F.coalesce(p, F.lit("")).alias(p) for p in ("utm_source", "referrer")]
    return s.groupBy("name", "browser", "path", *text).agg(F.count("*").alias("events"), F.count_distinct("distinct_id").alias("users"))
