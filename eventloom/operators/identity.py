"""First touch, aliases, retroactive events, people and account grain."""
from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import scan, values as v
from eventloom.operators import filters as flt
from eventloom.operators.scope import drop_sampler
from eventloom.session import materialize

# fixed values: visitor attributes that live on the landing event
ACQUISITION_PROPS = ("referrer", "source", "utm_source", "utm_medium", "utm_campaign", "channel", "device", "os",
                     "browser", "country", "platform")
# fixed values: sources that carry no acquisition signal
GENERIC_SOURCES = ("", "web", "app", "mobile", "desktop", "direct", "unknown", "none", "server")
# fixed values: property keys that describe an event, never a person
RESERVED_TRAITS = ("$set", "session_id", "path", "referrer", "title", "env", "site", "engaged_ms", "$feature_flag",
                   "$feature_flag_response", "$bucket_id")


# ---- first touch -----------------------------------------------------------------------------
def _touch_value(df: DataFrame, prop: str) -> Column:
    t = v.text(df, prop)
    val = v.host(t) if prop == "referrer" else t
    return F.when(t != "", val)


def _earliest(val: Column, when: Column | None = None) -> Column:
    keep = val.isNotNull() if when is None else val.isNotNull() & when
    return F.min(F.when(keep, F.struct("timestamp", "id", val.alias("v"))))["v"]


def first_touch(df: DataFrame, props) -> DataFrame:
    """(distinct_id, one column per prop): each person's earliest non-empty value, in one aggregate."""
    return df.groupBy("distinct_id").agg(*[_earliest(_touch_value(df, p)).alias(p) for p in dict.fromkeys(props)])


def _stamp(df: DataFrame, touch: DataFrame, props) -> DataFrame:
    t = touch.select("distinct_id", *[F.col(p).alias(f"_ft_{p}") for p in props])
    own = {p: v.text(df, p) for p in props}
    j = df.join(t, "distinct_id", "left")    # AQE splits a hot person on the event side
    for p in props:
        j = j.withColumn(p, F.coalesce(F.col(f"_ft_{p}"), own[p]))
    return j.drop(*[f"_ft_{p}" for p in props])


def stamp_first_touch(df: DataFrame, props) -> DataFrame:
    """Every event of a person carries the person's first-touch value of each property."""
    props = list(dict.fromkeys(props))
    return _stamp(df, first_touch(df, props), props)


def stamp_for_filters(df: DataFrame, filters) -> DataFrame:
    """First touch for acquisition filters, preferring the earliest value that satisfies the filter."""
    props = list(dict.fromkeys(f.prop for f in filters if f.prop in ACQUISITION_PROPS))
    if not props:
        return df
    aggs = []
    for p in props:
        rule = next(f for f in filters if f.prop == p)
        val = _touch_value(df, p)
        aggs.append(F.coalesce(_earliest(val, flt.predicate(df, rule)), _earliest(val)).alias(p))
    return _stamp(df, df.groupBy("distinct_id").agg(*aggs), props)


def channel(df: DataFrame) -> Column:
    src, ref, utm = v.text(df, "source"), v.text(df, "referrer"), v.text(df, "utm_source")
    good = (src != "") & ~F.lower(F.trim(src)).isin(*GENERIC_SOURCES)
    h = v.host(ref)
    return (F.when(good, src).when((ref != "") & (h != ""), h).when(utm != "", utm).otherwise(F.lit("direct")))


# ---- aliases ---------------------------------------------------------------------------------
def alias_edges(df: DataFrame) -> DataFrame:
    """(eid, anon, canonical, timestamp) from identify and create-alias events."""
    anon = (F.when(F.col("name") == "$identify", v.text(df, "$anon_distinct_id"))
            .when(F.col("name") == "$create_alias", v.text(df, "alias")))
    e = df.where(F.col("name").isin("$identify", "$create_alias")).select(
        F.col("id").alias("eid"), F.trim(anon).alias("anon"), F.trim("distinct_id").alias("canonical"), "timestamp")
    return e.where("anon <> '' and canonical <> '' and anon <> canonical and anon <> '$anon'")


def alias_map(edges: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(anon, canonical), one hop deep; an anon's newest edge counts.

    A canonical id that was itself aliased earlier is replaced by that alias's own result.  For every
    edge the one in force at its moment for its canonical id is found once, as-of (a running last
    value, no pairs; strictly earlier by time and id, so there are no circles).  These pointers are
    then doubled, so the rounds grow with the logarithm of the longest chain.  Finished edges don't
    join any more; each round is checkpointed.
    """
    own = F.struct("timestamp", "eid", "anon", "canonical")
    edges = materialize(edges.select("eid", "anon", "canonical", "timestamp").distinct())
    side = lambda key, step: edges.select(F.col(key).alias("key"), "timestamp", F.col("eid").alias("id"), F.lit(step).alias("_step"), own.alias("edge"))
    look = scan.with_blocks(side("anon", 1).unionByName(side("canonical", 0)), "key", rows_per_block=block_rows)
    look = scan.last_value_so_far(look, F.when(F.col("_step") == 1, F.col("edge")), "up", ["_us", "id", "_step"], key="key")
    links = materialize(look.where("_step = 0").select("edge", "edge.canonical", "up"))
    while not links.where("up is not null").isEmpty():
        to = links.select(F.col("edge").alias("up"), F.col("canonical").alias("_c"), F.col("up").alias("_up"))
        further = links.where("up is not null").join(to, "up").select("edge", F.col("_c").alias("canonical"), F.col("_up").alias("up"))
        links = materialize(links.where("up is null").unionByName(further))
    return links.groupBy("edge.anon").agg(F.max_by("canonical", F.struct("edge.timestamp", "edge.eid", "edge.canonical")).alias("canonical"))


def resolve_aliases(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rewrite distinct_id to its canonical id; the join side is chosen by size at run time."""
    a = aliases.select(F.col("anon").alias("_a"), F.col("canonical").alias("_c"))
    j = df.join(a, F.col("distinct_id") == F.col("_a"), "left")
    return j.withColumn("distinct_id", F.coalesce("_c", "distinct_id")).drop("_a", "_c")


# ---- retroactive events ----------------------------------------------------------------------
@dataclass(frozen=True)
class Definition:
    name: str
    event: str
    where: tuple = ()     # (field, equals|contains|prefix, value)


# fixed values: fields a definition may test
DEFINITION_FIELDS = ("text", "id", "classes", "href", "path", "tag", "name")


def _definition_match(df: DataFrame, d: Definition) -> Column:
    ok = F.col("name") == d.event
    for fld, op, val in d.where:
        if fld in DEFINITION_FIELDS and fld not in ("id", "name"):
            x = F.lower(F.coalesce(v.text(df, fld), F.lit("")))
        elif fld in ("id", "name"):
            x = F.lower(F.coalesce(F.try_variant_get(F.col("properties"), f"$['{fld}']", "string"), F.lit(""))) \
                if "properties" in df.columns else F.lit("")
        else:
            x = F.lit("")
        w = F.lit(val.lower())
        ok = ok & (x == w if op == "equals" else F.startswith(x, w) if op == "prefix" else F.contains(x, w))
    return ok


def defined_events(df: DataFrame, definitions) -> DataFrame:
    """Original rows plus one extra row per matching definition, in one scan."""
    extra = [F.when(_definition_match(df, d), F.lit(d.name)) for d in definitions]
    names = F.filter(F.array(F.lit(None).cast("string"), *extra), lambda n: n.isNotNull())
    each = df.withColumn("_n", F.explode(F.concat(F.array(F.lit("")), names)))
    defined = F.col("_n") != ""
    return (each.withColumn("name", F.when(defined, F.col("_n")).otherwise(F.col("name")))
            .withColumn("id", F.when(defined & (F.col("id") != ""), F.concat("id", F.lit("#"), "_n")).otherwise(F.col("id")))
            .drop("_n"))


# ---- people ----------------------------------------------------------------------------------
def traits(df: DataFrame) -> DataFrame:
    """(distinct_id, trait, value): newest value of each trait; the earlier event stands on a tie."""
    as_map = lambda c: F.from_json(F.to_json(c), "map<string,string>")
    own = F.when(F.col("name") == "$identify", as_map("properties"))
    nested = as_map(v.raw(df, "$set"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    both = F.concat(F.coalesce(F.map_entries(own), none), F.coalesce(F.map_entries(nested), none))
    kv = df.where(F.col("distinct_id") != "").select("distinct_id", "timestamp", "id", F.explode(both).alias("e"))
    kv = kv.select("distinct_id", "timestamp", "id", F.col("e.key").alias("trait"), F.col("e.value").alias("value"))
    kv = kv.where(~F.col("trait").isin("", *RESERVED_TRAITS) & F.col("value").isNotNull())
    best = kv.groupBy("distinct_id", "trait").agg(
        F.min(F.struct((-F.unix_micros("timestamp")).alias("t"), "id", "value"))["value"].alias("value"))
    return best


def profiles(df: DataFrame) -> DataFrame:
    """Per person: first and last seen, event count, and a trait map."""
    base = (df.where(F.col("distinct_id") != "").groupBy("distinct_id")
            .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("events")))
    t = traits(df).groupBy("distinct_id").agg(F.map_from_entries(F.collect_list(F.struct("trait", "value"))).alias("traits"))
    return base.join(t, "distinct_id", "left")


def people_list(prof: DataFrame, limit: int = 100) -> DataFrame:
    return prof.orderBy(F.desc("last_seen"), "distinct_id").limit(limit)


def trait_values(tr: DataFrame, trait: str) -> DataFrame:
    return (tr.where(F.col("trait") == trait).groupBy("value").agg(F.count("*").alias("people")))


def trait_keys(tr: DataFrame) -> DataFrame:
    return tr.groupBy(F.col("trait").alias("value")).agg(F.count("*").alias("people"))


def people_matching(tr: DataFrame, trait: str, value: str) -> DataFrame:
    return tr.where((F.col("trait") == trait) & (F.col("value") == value)).select("distinct_id")


# ---- account grain ---------------------------------------------------------------------------
def regroup_accounts(df: DataFrame, prop: str) -> DataFrame:
    """Make the account the unit of analysis; rows nobody can be attributed for are left out."""
    s = stamp_first_touch(drop_sampler(df), [prop])
    return s.where(F.coalesce(F.col(prop), F.lit("")) != "").withColumn("distinct_id", F.col(prop))


def grain_report(df: DataFrame, prop: str) -> DataFrame:
    s = stamp_first_touch(drop_sampler(df), [prop])
    has = F.coalesce(F.col(prop), F.lit("")) != ""
    return s.agg(F.count_distinct(F.when(has, F.col(prop))).alias("groups"), F.count(F.when(has, 1)).alias("kept"),
                 F.count(F.when(~has, 1)).alias("dropped"),
                 F.count_distinct(F.when(~has & (F.col("distinct_id") != ""), F.col("distinct_id"))).alias("unattributed"))
