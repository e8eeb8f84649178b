"""Shredded properties: nothing lost, and filters on a property reach the scan."""
import glob
import re

import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F
from eventloom.functions import values as v
from eventloom.operators import filters as flt
from eventloom.operators.filters import Filter
from eventloom.plans.inputs import Inputs
from eventloom.sources import shredded


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def store(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shredded") / "t")
    return shredded.write(Inputs(spark, sf).variant_events, path), path


def test_properties_are_typed_columns_of_the_files(store):
    schema = str(pq.ParquetFile(glob.glob(f"{store[1]}/*.parquet")[0]).schema)
    assert re.search(r"group field_id=-1 plan \{\s+optional binary field_id=-1 value;\s+optional binary field_id=-1 typed_value \(String\)", schema)


def test_filter_reaches_the_scan_and_the_document_stays(store):
    d, _ = store
    p = plan_of(d.where(v.text(d, "plan") == "pro").select("id"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(properties\.`0`,pro\)", p), p
    assert "ReadSchema: struct<id:string,properties:struct<0:string>>" in p, p


def test_filters_give_the_rows_of_the_plain_form(spark, sf, store):
    plain, d = Inputs(spark, sf).variant_events, store[0]
    for f in ([Filter("plan", "eq", "pro")], [Filter("amount", "gt", "100")], [Filter("utm_source", "neq", "newsletter")], [Filter("country", "neq", "US"), Filter("path", "contains", "check")]):
        rows = [sorted(r.id for r in flt.apply(x, f).select("id").collect()) for x in (plain, d)]
        assert rows[0] == rows[1] and rows[0], f


MIXED = ['{"a": 1, "b": {"c": [1, "x", null]}}', '{"a": "1"}', '{"a": 1.5}', '{"a": null}', '{}', '[1, 2]', '"text"', None, '{"a": {"deep": true}, "ключ": "значение"}',
         '{"a": 9223372036854775807}', '{"a": 123456789012345678901234567890}']


def test_any_document_comes_back(spark, tmp_path):
    rows = [(i, d) for i, d in enumerate(MIXED * 30)]
    plain = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("properties"))
    d = shredded.write(plain, str(tmp_path / "t"))
    text = lambda x: {r.id: r.t for r in x.select("id", F.to_json("properties").alias("t")).collect()}
    assert text(d) == text(plain)
    kinds = lambda x: {r.id: (r.t, r.n, r.l) for r in x.select("id", v.text(x, "a").alias("t"), v.num_strict(x, "a").alias("n"), v.num_lenient(x, "a").alias("l")).collect()}
    assert kinds(d) == kinds(plain)
    asked = lambda x: sorted(r.id for r in x.where(v.text(x, "a") == "1").select("id").collect())
    assert asked(d) == asked(plain) and len(asked(d)) == 60


def test_empty_and_partitioned(spark, tmp_path):
    plain = spark.createDataFrame([("x", 1, '{"a": 1}'), ("y", 2, '{"a": 2}')], "id string, day int, j string").select("id", "day", F.parse_json("j").alias("properties"))
    assert shredded.write(plain.where("false"), str(tmp_path / "e")).count() == 0
    d = shredded.write(plain, str(tmp_path / "p"), partition_by=("day",))
    assert [r.id for r in d.where("day = 2").where(v.num_strict(d, "a") == 2).collect()] == ["y"]


def test_writing_leaves_the_session_as_it_was(spark, tmp_path):
    key = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(key, None)
    shredded.write(spark.sql("SELECT parse_json('{}') AS properties"), str(tmp_path / "s"))
    assert spark.conf.get(key, None) == before
