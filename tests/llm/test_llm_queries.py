"""The registered queries: against their SQL, and the pipeline against plain versions of its stages."""
import glob
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from eventloom.llm import queries
from tools.check import cell


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_matches_sql(spark, sf, key):
    df = queries.PLANS[key](spark, sf)
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(queries.SQL[key])
    names = [d[0] for d in cur.description]
    norm = lambda rows, cols: sorted((tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=repr)
    assert sorted(names) == sorted(df.columns) and norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), names)


@pytest.mark.parametrize("key", sorted(set(queries.PLANS) - set(queries.SQL)))
def test_a_row_per_document(spark, sf, key):
    assert queries.PLANS[key](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_sharding_moves_the_texts(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.shard, "layout", lambda d, own=queries.shard.layout: seen.append(d.columns) or own(d))
    rows = queries.PLANS["op6_shard"](spark, sf).collect()
    assert seen == [["doc_id", "text", "shard"]]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {r["doc_id"] for r in rows}
    assert all(texts[r["doc_id"]] == r["text"] for r in rows)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in " ".join(texts[d].lower().split()) for d in ids for i in items)
    assert len({texts[d] for d in ids}) == len(ids)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert again == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
