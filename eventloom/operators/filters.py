"""Property filters compiled to two-valued Columns."""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from eventloom.functions import values as v
from eventloom.model import attach_row
from eventloom.operators.scope import scope_production

OPS = ("eq", "neq", "contains", "ncontains", "gt", "lt", "in", "notin", "set", "notset", "regex")
POSITIVE = ("eq", "contains", "gt", "lt", "in", "set", "regex")


@dataclass(frozen=True)
class Filter:
    prop: str
    op: str
    value: Any = None


def as_text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return str(x)


def _number(x: Any) -> float | None:
    try:
        return None if isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def predicate(df: DataFrame, f: Filter) -> Column:
    """One filter as a Column that is never NULL; negatives hold where the key is missing."""
    has = v.present(df, f.prop)
    txt = F.coalesce(v.text(df, f.prop), F.lit(""))
    is_ref = f.prop == "referrer"

    def same(want) -> Column:
        if is_ref:
            return v.host(txt) == v.host(F.lit(as_text(want)))
        return txt == as_text(want)

    def one_of() -> Column:
        if is_ref:
            return reduce(lambda a, b: a | b, [same(w) for w in f.value], F.lit(False))
        return txt.isin(*[as_text(w) for w in f.value]) if f.value else F.lit(False)

    if f.op == "eq":
        return has & same(f.value)
    if f.op == "neq":
        return ~has | ~same(f.value)
    if f.op == "contains":
        return has & F.contains(txt, F.lit(as_text(f.value)))
    if f.op == "ncontains":
        return ~has | ~F.contains(txt, F.lit(as_text(f.value)))
    if f.op in ("gt", "lt"):
        n, want = v.num_lenient(df, f.prop), F.lit(_number(f.value) or 0.0)
        return F.coalesce((n > want) if f.op == "gt" else (n < want), F.lit(False))
    if f.op == "in":
        return has & one_of()
    if f.op == "notin":
        return ~has | ~one_of()
    if f.op == "set":
        return has
    if f.op == "notset":
        return ~has
    if f.op == "regex":
        return has & txt.rlike(as_text(f.value))
    raise ValueError(f"unknown filter op {f.op!r} on property {f.prop!r}")


def matches(df: DataFrame, filters, any_mode: bool = False) -> Column:
    preds = [predicate(df, f) for f in filters]
    if not preds:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if any_mode else (lambda a, b: a & b), preds)


def apply(df: DataFrame, filters=(), any_mode: bool = False) -> DataFrame:
    """All (or any) of the filters, inside the default production scope."""
    scoped = scope_production(df, filters)
    return scoped.where(matches(df, filters, any_mode)) if filters else scoped


def scope_users(df: DataFrame, filters=(), any_mode: bool = False) -> DataFrame:
    """Every event of the people with at least one matching event."""
    if not filters:
        return df
    hit = apply(df, filters, any_mode).select("distinct_id").distinct()
    return df.join(hit, "distinct_id", "left_semi")


def validate(filters) -> None:
    """Refuse filters that could only give a misleading zero."""
    for f in filters:
        if not f.prop:
            raise ValueError("filter is missing a property name")
        if f.op not in OPS:
            raise ValueError(f"unknown filter op {f.op!r} on property {f.prop!r}")
        if f.op in ("gt", "lt") and _number(f.value) is None:
            raise ValueError(f"filter op {f.op!r} on property {f.prop!r} needs a number")
        if f.op in ("in", "notin") and not isinstance(f.value, (list, tuple)):
            raise ValueError(f"filter op {f.op!r} on property {f.prop!r} needs a list")
        if f.op == "regex":
            try:
                re.compile(as_text(f.value))
            except re.error as e:
                raise ValueError(f"bad regex on property {f.prop!r}: {e}") from e


def property_keys(df: DataFrame, keep=()) -> DataFrame:
    """(…keep, key, value, num, is_text): one row per property present on an event."""
    fixed = {"id", "name", "distinct_id", "timestamp", "properties", *keep}
    flat = [c for c in df.columns if c not in fixed and not c.startswith("_")]
    cell = "struct<key:string,value:string,num:double,is_text:boolean>"
    cells = F.array(*[F.struct(F.lit(c).alias("key"), v.text(df, c).alias("value"), v.num_lenient(df, c).alias("num"),
                               F.lit(isinstance(df.schema[c].dataType, T.StringType)).alias("is_text")) for c in flat]).cast(f"array<{cell}>")
    cells = F.filter(cells, lambda x: x["value"].isNotNull())
    if "properties" in df.columns:
        def entry(e: Column) -> Column:
            val, kind = e["value"], F.schema_of_variant(e["value"])
            txt = F.try_variant_get(val, "$", "string")
            num = (F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(val, "$", "double"))
                   .when(kind == "STRING", v.parse_number(txt)))
            return F.struct(e["key"].alias("key"), txt.alias("value"), num.alias("num"), (kind == "STRING").alias("is_text"))
        own = F.map_entries(F.try_variant_get("properties", "$", "map<string,variant>"))
        if flat:
            own = F.filter(own, lambda e: ~e["key"].isin(*flat))
        cells = F.concat(cells, F.coalesce(F.transform(own, entry).cast(f"array<{cell}>"), F.array().cast(f"array<{cell}>")))
    return df.select(*keep, F.explode(cells).alias("kv")).select(*keep, "kv.*")


def unknown_properties(df: DataFrame, filters) -> DataFrame:
    """Positive filters whose property no event carries, with the sorted known keys beside them."""
    wanted = [f.prop for f in filters if f.op in POSITIVE and f.prop]
    known = property_keys(df).select("key").distinct()
    listing = known.agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("known"))
    ask = df.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(wanted)] or [], "prop string")
    return attach_row(ask.join(known, ask["prop"] == known["key"], "left_anti"), listing)
