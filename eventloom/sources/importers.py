"""Other tools' exports as canonical events.

Readers give text lines or string columns; mappers return id, name, distinct_id, timestamp,
properties and ``reason`` (NULL when the row is good).  A missing timestamp stays NULL and is
stamped at ingest; a missing id is derived from the row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.functions.values import compute_once
from eventloom.sources.ingest import parse_time


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Header CSV as trimmed string columns with lower-case names.

    Quoted line breaks are allowed, which makes a file one task; pass ``multi_line=False`` to split
    large files that have none.
    """
    d = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return d.toDF(*[c.strip().lstrip("﻿").lower() for c in d.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines; .gz is decompressed by the reader."""
    return spark.read.text(path).where(F.trim("value") != "")


def _find(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _cell(df: DataFrame, name: str | None) -> Column:
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit("")) if name else F.lit("")


def _flat(df: DataFrame, skip, strip: str = "") -> Column:
    """The remaining non-empty columns as map<string,variant>."""
    cols = [c for c in df.columns if c not in skip]
    if not cols:
        return F.create_map().cast("map<string,variant>")
    pairs = [x for c in cols for x in (F.lit(c[len(strip):] if strip and c.startswith(strip) else c), _cell(df, c))]
    some = F.map_filter(F.create_map(*pairs), lambda k, v: v != "")
    return F.transform_values(some, lambda k, v: v.cast("variant"))


def _merge(base: Column, wins: Column) -> Column:
    w = F.coalesce(wins, F.create_map().cast("map<string,variant>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(w, k)), w)


def _event(df: DataFrame, eid: Column, name: Column, did: Column, when: Column, props: Column, seed: Column, no_id: str = "missing distinct_id", bad: Column | None = None) -> DataFrame:
    invalid = F.col("_v").isNull() if "_v" in df.columns else F.lit(False)
    ts = parse_time(when)
    reason = F.lit(None).cast("string")
    checks = [(invalid, "invalid JSON"), (name == "", "missing event name"), (did == "", no_id), ((when != "") & ts.isNull(), "unparseable timestamp")]
    if bad is not None:
        checks.append((bad, "unparseable properties JSON"))
    for cond, why in reversed(checks):
        reason = F.when(cond, why).otherwise(reason)
    d = df.select(F.when(invalid, None).when(eid != "", eid).otherwise(F.substring(F.sha2(seed, 256), 1, 32)).alias("id"), name.alias("name"), did.alias("distinct_id"), ts.alias("timestamp"),
                  props.alias("_p"), reason.alias("reason"))
    return d.select("id", "name", "distinct_id", "timestamp", F.when(F.size("_p") > 0, F.to_variant_object("_p")).alias("properties"), "reason")


def _seed(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def map_csv(df: DataFrame) -> DataFrame:
    name, did = _find(df, "name", "event"), _find(df, "distinct_id", "user_id", "anonymous_id")
    when, eid = _find(df, "time", "timestamp"), _find(df, "event_id", "uuid", "$insert_id")
    if not name or not did:
        raise ValueError(f"csv: need a name or event column and a distinct_id, user_id or anonymous_id column, got {df.columns}")
    return _event(df, _cell(df, eid), _cell(df, name), _cell(df, did), _cell(df, when), _flat(df, {name, did, when, eid}), _seed(df))


def map_posthog(df: DataFrame) -> DataFrame:
    """CSV with a JSON ``properties`` column and ``properties.x`` columns; the JSON wins on a clash."""
    if "event" not in df.columns or "distinct_id" not in df.columns:
        raise ValueError(f"need event and distinct_id columns, got {df.columns}")
    when, props, eid = _find(df, "timestamp"), _find(df, "properties"), _find(df, "uuid", "$insert_id")
    flat = _flat(df, {"event", "distinct_id", when, props, eid}, "properties.")
    pj = _cell(df, props)
    parsed = F.when(pj != "", F.try_variant_get(F.try_parse_json(pj), "$", "map<string,variant>"))
    return _event(df, _cell(df, eid), _cell(df, "event"), _cell(df, "distinct_id"), _cell(df, when), _merge(flat, parsed), _seed(df), bad=(pj != "") & parsed.isNull())


def _parsed(df: DataFrame, build) -> DataFrame:
    """``build`` the events of JSON lines in one pass; unreadable lines keep only their reason."""
    d = compute_once(df, _v=F.try_parse_json("value"))
    txt = lambda path: F.coalesce(F.try_variant_get("_v", path, "string"), F.lit(""))
    obj = lambda path: F.coalesce(F.try_variant_get("_v", path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return build(d, txt, obj)


def map_jsonl(df: DataFrame) -> DataFrame:
    return _parsed(df, lambda d, txt, obj: _event(d, txt("$.id"), txt("$.name"), txt("$.distinct_id"), txt("$.timestamp"), obj("$.properties"), F.col("value")))


def map_mixpanel(df: DataFrame) -> DataFrame:
    """{event, properties{distinct_id, time, $insert_id, …}}"""
    own = ("distinct_id", "time", "$insert_id")
    return _parsed(df, lambda d, txt, obj: _event(
        d, txt("$.properties['$insert_id']"), txt("$.event"), txt("$.properties.distinct_id"), txt("$.properties.time"),
        F.map_filter(obj("$.properties"), lambda k, v: ~k.isin(*own)), F.col("value")))


def map_amplitude(df: DataFrame) -> DataFrame:
    """Event properties win over user properties; the person is user, device or vendor id."""
    def build(d, txt, obj):
        who = F.coalesce(*[F.when(txt(p) != "", txt(p)) for p in ("$.user_id", "$.device_id", "$.amplitude_id")], F.lit(""))
        return _event(d, txt("$['$insert_id']"), txt("$.event_type"), who, txt("$.event_time"), _merge(obj("$.user_properties"), obj("$.event_properties")), F.col("value"), "missing user id")
    return _parsed(df, build)


def map_posthog_api(df: DataFrame) -> DataFrame:
    """The REST shape: nested properties, ``id`` or ``uuid``."""
    def build(d, txt, obj):
        first = lambda *ps: F.coalesce(*[F.when(txt(p) != "", txt(p)) for p in ps], F.lit(""))
        return _event(d, first("$.id", "$.uuid"), txt("$.event"), first("$.distinct_id", "$.properties.distinct_id"), txt("$.timestamp"), obj("$.properties"), F.col("value"))
    return _parsed(df, build)


def map_umami(df: DataFrame) -> DataFrame:
    """Rows without an event name are pageviews; a session is the person."""
    if "session_id" not in df.columns:
        raise ValueError(f"no session_id column, got {df.columns}")
    ren = df
    for src, dst in (("url_path", "path"), ("referrer_domain", "referrer")):
        if src in ren.columns:
            ren = ren.drop(dst).withColumnRenamed(src, dst)
    name = _cell(ren, _find(ren, "event_name"))
    when = _find(ren, "created_at")
    return _event(ren, F.lit(""), F.when(name == "", "$pageview").otherwise(name), _cell(ren, "session_id"), _cell(ren, when),
                  _flat(ren, {"session_id", "event_name", when}), _seed(ren), "missing session_id")


FORMATS = {"jsonl": (read_lines, map_jsonl), "csv": (read_csv, map_csv), "posthog": (read_csv, map_posthog), "posthog-api": (read_lines, map_posthog_api),
           "mixpanel": (read_lines, map_mixpanel), "amplitude": (read_lines, map_amplitude), "umami": (read_csv, map_umami)}


def load(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, want one of {', '.join(FORMATS)}")
    read, mapper = FORMATS[fmt]
    return mapper(read(spark, path))


def summary(mapped: DataFrame) -> DataFrame:
    """(reason, rows): 'parsed' and every skip reason."""
    return mapped.groupBy(F.coalesce("reason", F.lit("parsed")).alias("reason")).agg(F.count("*").alias("rows"))
