"""The dialect's scalar semantics as temporary SQL functions, for query text; ``scalars`` has the same as Columns.

Each body is a plain SQL expression, which Spark inlines into the calling plan: no code runs outside the optimizer.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from eventloom.functions.values import _NUM_RE

_OPS = ("=", "<>", "<", "<=", ">", ">=")
_NUMBER = f"CASE WHEN trim({{0}}) RLIKE r'{_NUM_RE}' THEN try_cast(trim({{0}}) AS DOUBLE) END"


def _relation(a: str, b: str) -> str:
    return "CASE op " + " ".join(f"WHEN '{o}' THEN {a} {o} {b}" for o in _OPS) + f" WHEN '!=' THEN {a} <> {b} END"


_A, _B = _NUMBER.format("a"), _NUMBER.format("b")
#: name → (parameters, type, body)
HELPERS = {
    "ev_number": ("x STRING", "DOUBLE", _NUMBER.format("x")),
    "ev_compare": ("a STRING, op STRING, b STRING", "BOOLEAN", f"coalesce({_relation('a', 'b')}, false)"),
    "ev_compare_numbers": ("a STRING, op STRING, b STRING", "BOOLEAN", f"coalesce(CASE WHEN ({_A}) IS NOT NULL AND ({_B}) IS NOT NULL THEN {_relation(f'({_A})', f'({_B})')} ELSE {_relation('a', 'b')} END, false)"),
    "ev_compare_times": ("a TIMESTAMP, op STRING, b TIMESTAMP", "BOOLEAN", f"coalesce({_relation('a', 'b')}, false)"),
    "ev_like": ("x STRING, pattern STRING", "BOOLEAN", "coalesce(x LIKE pattern ESCAPE '\x01', false)"),
    "ev_arith": ("a DOUBLE, op STRING, b DOUBLE", "DOUBLE", "CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b WHEN '/' THEN try_divide(a, b) WHEN '%' THEN try_mod(a, b) END"),
    "ev_date": ("t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM-dd')"),
    "ev_hour": ("t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM-dd HH:00')"),
    "ev_week": ("t TIMESTAMP", "STRING", "date_format(date_trunc('week', t), 'yyyy-MM-dd')"),
    "ev_month": ("t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM')"),
    "ev_year": ("t TIMESTAMP", "DOUBLE", "CAST(year(t) AS DOUBLE)"),
    "ev_length": ("x STRING", "DOUBLE", "CAST(octet_length(coalesce(x, '')) AS DOUBLE)"),
    "ev_concat": ("a STRING, b STRING", "STRING", "concat(coalesce(a, ''), coalesce(b, ''))"),
    "ev_substr": ("x STRING, start INT, n INT", "STRING", "CASE WHEN start < 0 THEN '' ELSE make_valid_utf8(CAST(substring(encode(coalesce(x, ''), 'UTF-8'), greatest(start, 1), CASE WHEN n < 0 THEN 2147483647 - greatest(start, 1) ELSE n END) AS STRING)) END"),
    "ev_round": ("x DOUBLE, places INT", "DOUBLE", "signum(x) * floor(abs(x) * power(10.0D, places) + 0.5D) / power(10.0D, places)"),
}


def register(spark: SparkSession) -> None:
    """Make the helpers known to the session; a second call changes nothing."""
    known = {f.name for f in spark.catalog.listFunctions(pattern="ev_*")}
    for name, (parameters, kind, body) in HELPERS.items():
        if name not in known:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
