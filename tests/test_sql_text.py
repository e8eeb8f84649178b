"""What query text may read and call, and that the SQL helpers say what the Column helpers say."""
import pytest
from pyspark.sql import functions as F

from conftest import make_events
from eventloom.functions import scalars as sc
from eventloom.functions.sql_helpers import HELPERS, register
from eventloom.operators import sqlview


@pytest.fixture(scope="module")
def ev(spark):
    spark.range(1).createOrReplaceTempView("other_table")
    return make_events(spark, [("a", "u", 1, {"env": "development"}), ("a", "u", 2, {"env": "production"})])


@pytest.mark.parametrize("bad", [
    "SELECT * FROM (WITH other_table AS (SELECT 1 AS a) SELECT * FROM other_table) x CROSS JOIN other_table y",
    "WITH other_table AS (SELECT * FROM other_table) SELECT * FROM other_table",
    "SELECT * FROM {events} WHERE id IN (WITH other_table AS (SELECT 'x' AS id) SELECT id FROM other_table) AND 0 IN (SELECT id FROM other_table)",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.name') FROM {events}",
    "SELECT id FROM {events} WHERE java_method('java.lang.System', 'getProperty', 'user.name') = 'x'",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.name') FROM {events}",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name') FROM {events}",
    "SELECT * FROM IDENTIFIER('other_table')", "SELECT * FROM __events", "SELECT input_file_name() FROM {events}", "SELECT current_user() FROM {events}",
    "SELECT '${spark.master}' FROM {events}", "SELECT other.fn(1) FROM {events}", "SELECT my_function(id) FROM {events}", "SELECT * FROM read_everything('x')",
    "SELECT count(*) FROM {events} e JOIN LATERAL (SELECT * FROM other_table) o", "TABLE other_table", "SELECT * FROM {events} UNION ALL TABLE other_table", "SET spark.master", "SELECT EXISTS (SELECT 1 FROM other_table) FROM {events}"])
def test_refused(spark, ev, bad):
    spark.udf.register("my_function", lambda x: x)
    with pytest.raises(ValueError):
        sqlview.sql(ev, bad)


def test_allowed(spark, ev):
    n = lambda q: sqlview.sql(ev, q).count()
    assert n("SELECT * FROM (WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) SELECT * FROM b) CROSS JOIN {events}") == 1
    assert n("WITH a AS (SELECT * FROM {events}) SELECT * FROM a WHERE id IN (WITH c AS (SELECT id FROM a) SELECT id FROM c)") == 1
    assert n("SELECT x FROM {events} LATERAL VIEW explode(array(1, 2)) t AS x") == 2
    assert n("SELECT * FROM range(3), {events}") == 3
    assert n("WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r WHERE i < 5) SELECT * FROM r") == 5


VALUES = [None, "", "9", " 10 ", "1e3", "abc", "naïve", "-2.5", "0x10", "NaN", "10"]


def test_helpers_equal_the_column_helpers(spark):
    register(spark)
    register(spark)
    t = spark.createDataFrame([(a, b, float(i % 5) - 2, float(i % 3)) for i, (a, b) in enumerate((a, b) for a in VALUES for b in VALUES)], "a string, b string, x double, y double")
    pairs = [("ev_number(a)", sc.num(F.col("a"))), ("ev_length(a)", sc.length(F.col("a"))), ("ev_concat(a, b)", sc.concat(F.col("a"), F.col("b"))), ("ev_round(x * 1.25, 1)", sc.round_(F.col("x") * 1.25, 1))]
    pairs += [(f"ev_compare(a, '{o}', b)", sc.compare(o, F.col("a"), F.col("b"), "string", "string")) for o in ("=", "!=", "<", "<=", ">", ">=")]
    pairs += [(f"ev_compare_numbers(a, '{o}', '9')", sc.compare(o, F.col("a"), 9)) for o in ("=", "!=", "<", "<=", ">", ">=")]
    pairs += [(f"ev_arith(x, '{o}', y)", sc.arith(o, F.col("x"), F.col("y"))) for o in "+-*/%"]
    pairs += [(f"ev_substr(a, {i}, {n})", sc.substr(F.col("a"), i, n)) for i in (-2, 0, 1, 2, 4, 20) for n in (-1, 0, 2, 9)]
    pairs += [(f"ev_like(a, '{p}')", sc.like(F.col("a"), p)) for p in ("%", "1_", "na%")]
    for text, column in pairs:
        for r in t.select(F.expr(text).alias("p"), column.alias("q"), "a", "b").collect():
            assert repr(r["p"]) == repr(r["q"]), (text, r)


def test_helpers_become_plain_expressions(spark, ev):
    plan = sqlview.sql(ev, "SELECT ev_length(name) AS n FROM {events} WHERE ev_compare(name, '=', 'a')")._jdf.queryExecution().executedPlan().toString()
    assert "octet_length" in plan and "ev_" not in plan.replace("ev_length(name)", "") and "Python" not in plan and len(HELPERS) == 15
