"""Scalar semantics of the events SQL surface where they differ from ANSI, as Columns.

Comparisons never yield NULL, arithmetic on non-numbers is NULL, text functions treat NULL as ''.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventloom.functions.values import parse_number


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num(x: Column, kind: str = "string") -> Column:
    """Number of a value: text is trimmed and parsed, booleans are 0/1, times are nanoseconds."""
    if kind == "number":
        return x.cast("double")
    if kind == "bool":
        return x.cast("int").cast("double")
    if kind == "time":
        return F.unix_micros(x).cast("double") * 1000
    return parse_number(F.trim(x))


def compare(op: str, a: Column, b, a_kind: str = "string", b_kind: str | None = None) -> Column:
    """Two-valued comparison: times chronologically, numbers where both sides read as numbers, else as text."""
    if b_kind is None:
        b_kind = "number" if isinstance(b, (int, float)) and not isinstance(b, bool) else "bool" if isinstance(b, bool) else "string"
    bc = _c(b)
    rel = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if "time" in (a_kind, b_kind):
        ta = a if a_kind == "time" else F.try_to_timestamp(a)
        tb = bc if b_kind == "time" else F.try_to_timestamp(bc)
        return F.coalesce(rel(ta, tb), F.lit(False))
    as_text = rel(a.cast("string"), bc.cast("string"))
    if a_kind == "string" and b_kind == "string":
        return F.coalesce(as_text, F.lit(False))
    na, nb = num(a, a_kind), num(bc, b_kind)
    return F.coalesce(F.when(na.isNotNull() & nb.isNotNull(), rel(na, nb)).otherwise(as_text), F.lit(False))


def in_list(a: Column, values, kind: str = "string") -> Column:
    """IN by comparison; a NULL value matches an '' entry."""
    out = F.lit(False)
    for x in values:
        hit = compare("=", a, x, kind)
        out = out | (hit | (a.isNull()) if x == "" else hit)
    return out


def like(a: Column, pattern: str) -> Column:
    """Case-sensitive LIKE without an escape character."""
    return F.coalesce(F.like(a, F.lit(pattern), F.lit("\x01")), F.lit(False))


def arith(op: str, a: Column, b: Column) -> Column:
    """a and b are already numbers; dividing by zero is NULL."""
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[op]()


def sum_(x: Column) -> Column:
    """NULL when no row matched, 0 when rows exist but none is numeric."""
    return F.when(F.count("*") == 0, None).otherwise(F.coalesce(F.sum(x), F.lit(0.0)))


def date_(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")


def week_(ts: Column) -> Column:
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def month_(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year_(ts: Column) -> Column:
    return F.year(ts).cast("double")


def text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def length(x: Column) -> Column:
    """Bytes, not characters."""
    return F.octet_length(text(x)).cast("double")


def concat(*xs) -> Column:
    return F.concat(*[text(_c(x)) for x in xs])


def substr(x: Column, start: int, n: int | None = None) -> Column:
    """Byte-based, 1-indexed; 0 reads as 1, a negative start gives ''; what is left of a character that is cut reads as U+FFFD."""
    i = start - 1 if start > 0 else start
    if i < 0:
        return F.lit("")
    raw = F.encode(text(x), "UTF-8")
    rest = F.when(F.octet_length(raw) >= i, F.substring(raw, i + 1, 2 ** 31 - 1 - i)).otherwise(F.encode(F.lit(""), "UTF-8"))
    if n is not None and n >= 0:
        rest = F.substring(rest, 1, n)
    return F.make_valid_utf8(rest.cast("string"))


def round_(x: Column, places: int = 0) -> Column:
    """Half away from zero."""
    p = 10.0 ** places
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p
