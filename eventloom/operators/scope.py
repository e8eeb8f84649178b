"""Population scoping: the two default predicates every report shares."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import values as v

# fixed values: environments hidden by default, and the engine's own event names
NON_PRODUCTION = ("development", "preview", "staging", "test", "ci")
SAMPLER_EVENTS = ("$geo_check", "$site_readable", "$ai_crawl")


def scope_production(df: DataFrame, filters=()) -> DataFrame:
    """Hide non-production rows unless a filter names ``env``."""
    if any(f.prop == "env" for f in filters):
        return df
    return df.where(~F.coalesce(v.text(df, "env").isin(*NON_PRODUCTION), F.lit(False)))


def drop_sampler(df: DataFrame, event: str = "") -> DataFrame:
    """Hide the engine's own events unless one of them is asked for by name."""
    if event in SAMPLER_EVENTS:
        return df
    return df.where(~F.col("name").isin(*SAMPLER_EVENTS))
