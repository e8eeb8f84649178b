"""The query registry: one Spark plan per key, with its SQL check beside it."""
from __future__ import annotations

from collections.abc import Callable

from eventloom.plans.inputs import EV, PEV, WEB, Inputs

PLANS: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_CTE = {"ev": EV, "pev": PEV, "web": WEB}


def plan(key: str, sql: str | None = None, base: str | None = "pev"):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` may open with further CTEs after ``base``."""
    def wrap(fn):
        if key in PLANS:
            raise KeyError(f"{key} is registered twice")
        PLANS[key] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if base:
                joined = body[5:] if body[:5].upper() == "WITH " else None
                body = f"WITH {_CTE[base]}" + (f", {joined}" if joined is not None else f"\n{body}")
            SQL[key] = body
        return fn
    return wrap
