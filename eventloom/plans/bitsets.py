"""Reports from words of activity, against the checks of the same reports over events."""
from pyspark.sql import functions as F

from eventloom.operators import activity as ac
from eventloom.plans import sequences, trend_reports  # noqa: F401  (their checks)
from eventloom.plans.inputs import ASOF
from eventloom.plans.registry import SQL, plan


@plan("bits_active_users", SQL["active_users_rolling"], base=None)
def _(c):
    return ac.rolling(ac.words(c.prod.where(F.col("name").isin("view", "purchase"))), 7, trend_reports.S, trend_reports.E)


@plan("bits_lifecycle", SQL["lifecycle"], base=None)
def _(c):
    return ac.lifecycle(ac.words(c.prod), 14)


@plan("bits_stickiness", SQL["stickiness"], base=None)
def _(c):
    return ac.stickiness(ac.words(c.prod), ASOF)


@plan("bits_retention_weeks", SQL["retention_grid"], base=None)
def _(c):
    return ac.grid(ac.words(c.prod), 4, "week")


@plan("bits_retention_rolling", SQL["retention_rolling"], base=None)
def _(c):
    return ac.grid(ac.words(c.prod), 14, rolling=True)


@plan("bits_retention_event", SQL["retention_event_filter"], base=None)
def _(c):
    return ac.grid(ac.words(c.prod, "purchase"), 14)
