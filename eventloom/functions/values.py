"""Property access and coercion as Columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.DecimalType)
# fixed value: the decimal forms a float parser accepts
_NUM_RE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?|[nN]a[nN])$"


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def promoted(df: DataFrame, key: str) -> bool:
    return key in df.columns and key != "properties"


def raw(df: DataFrame, key: str) -> Column:
    if "properties" not in df.columns:
        return F.lit(None).cast("variant")
    return F.try_variant_get(F.col("properties"), _path(key), "variant")


def present(df: DataFrame, key: str) -> Column:
    """The key exists on the row (an explicit null in VARIANT counts)."""
    return F.col(f"`{key}`").isNotNull() if promoted(df, key) else raw(df, key).isNotNull()


def text(df: DataFrame, key: str) -> Column:
    """The value as text: whole numbers without a fraction, null and missing as NULL."""
    if promoted(df, key):
        c = F.col(f"`{key}`")
        if isinstance(df.schema[key].dataType, (T.DoubleType, T.FloatType)):
            return F.regexp_replace(c.cast("string"), r"\.0$", "")
        return c.cast("string")
    if "properties" not in df.columns:
        return F.lit(None).cast("string")
    return F.try_variant_get(F.col("properties"), _path(key), "string")


def label(df: DataFrame, key: str) -> Column:
    """Group label: missing and null both read '(none)'."""
    return F.coalesce(text(df, key), F.lit("(none)"))


def parse_number(s: Column) -> Column:
    return F.when(s.rlike(_NUM_RE), s.try_cast("double"))


def _variant_kind(df: DataFrame, key: str) -> Column:
    return F.schema_of_variant(raw(df, key))


def num_strict(df: DataFrame, key: str) -> Column:
    """Numbers only."""
    if promoted(df, key):
        ok = isinstance(df.schema[key].dataType, _NUMERIC)
        return F.col(f"`{key}`").cast("double") if ok else F.lit(None).cast("double")
    if "properties" not in df.columns:
        return F.lit(None).cast("double")
    kind = _variant_kind(df, key)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
                  F.try_variant_get(F.col("properties"), _path(key), "double"))


def num_lenient(df: DataFrame, key: str) -> Column:
    """Numbers and numeric strings."""
    if promoted(df, key):
        t = df.schema[key].dataType
        if isinstance(t, _NUMERIC):
            return F.col(f"`{key}`").cast("double")
        return parse_number(F.col(f"`{key}`")) if isinstance(t, T.StringType) else F.lit(None).cast("double")
    if "properties" not in df.columns:
        return F.lit(None).cast("double")
    kind = _variant_kind(df, key)
    return (F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
                   F.try_variant_get(F.col("properties"), _path(key), "double"))
            .when(kind == "STRING", parse_number(text(df, key))))


def host(url: Column) -> Column:
    """URL to bare host, cut at the first slash."""
    s = F.regexp_replace(F.regexp_replace(url, "^https://", ""), "^http://", "")
    return F.regexp_replace(F.substring_index(s, "/", 1), r"^www\.", "")


def referrer_host(url: Column) -> Column:
    """Referrer host for web reports: cut at / ? or #; empty reads 'direct'."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^https://", ""), "^http://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[/?#].*$", ""), r"^www\.", "")
    return F.when(s == "", F.lit("direct")).otherwise(s)


def pct(num: Column, den: Column) -> Column:
    """Whole percent, half up; 0 when there is nothing to divide by."""
    return F.when(den > 0, F.floor(num / den * 100 + 0.5)).otherwise(F.lit(0)).cast("bigint")


def half_up(x: Column, places: int) -> Column:
    """Round half away from zero."""
    return F.round(x, places)


def ratio(num: Column, den: Column, places: int = 6) -> Column:
    return F.round(F.when(den > 0, num / den).otherwise(F.lit(0.0)), places)


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters must not re-evaluate.

    A filter on a projected column is pushed below the projection with the expression inlined; a
    one-row generator stops that, so costly expressions (JSON parsing) run once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
