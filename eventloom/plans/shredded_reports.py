"""Filters and measures over shredded properties, against the checks of the same reports over promoted columns."""
from pyspark.sql import functions as F

from eventloom.functions import values as v
from eventloom.operators import filters as flt, scope, trends as tr
from eventloom.operators.filters import Filter
from eventloom.plans import trend_reports  # noqa: F401  (its checks)
from eventloom.plans.population import COUNTS, counts
from eventloom.plans.registry import SQL, plan
from eventloom.sources import shredded
from eventloom.streaming.jobs import work_dir


def stored(c):
    return shredded.write(c.variant_events, work_dir(c.spark, "shredded"))


@plan("shredded_filter", f"{COUNTS} FROM pev WHERE plan='pro' AND amount>100 AND (country<>'US' OR country IS NULL) GROUP BY 1")
def _(c):
    return counts(flt.apply(scope.scope_production(stored(c)), [Filter("plan", "eq", "pro"), Filter("amount", "gt", "100"), Filter("country", "neq", "US")]))


@plan("shredded_property_breakdown", SQL["property_breakdown"], base=None)
def _(c):
    return tr.property_breakdown(scope.scope_production(stored(c)), "plan", "view")


@plan("shredded_measure", SQL["measure_breakdown"], base=None)
def _(c):
    return tr.measure_breakdown(scope.scope_production(stored(c)), "purchase", "amount", "plan")


@plan("shredded_round_trip", """SELECT count(*) AS n, count(amount) AS amounts, count(plan) AS plans, count(DISTINCT path) AS paths, count(env) AS envs FROM ev""", base="ev")
def _(c):
    d = stored(c)
    return d.agg(F.count("*").alias("n"), F.count(v.num_strict(d, "amount")).alias("amounts"), F.count(v.text(d, "plan")).alias("plans"),
                 F.count_distinct(v.text(d, "path")).alias("paths"), F.count(v.text(d, "env")).alias("envs"))
