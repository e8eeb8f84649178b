"""Spelling variants, vector codes and language-model scores against plain versions: nulls, ties, repeats, empty tables."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import ballkmeans, lbl, queries, spelling


# ---- spelling variants -----------------------------------------------------------------------
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(n):
    out = {}
    for w in n:
        found = [x for x in n if near(w, x)]
        form = min(found, key=lambda x: (-n[x], x), default=None)
        form = form if form and n[form] >= 2 * n[w] else None
        out[w] = [n[w], len(found), form, n[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("block,rows,units", [(1 << 15, 1 << 16, 1 << 19), (40, 64, 256), (7, 16, 64)])
def test_variants_equal_brute_force(spark, block, rows, units):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([1, 4, 5, 6, 7, 12]))) for _ in range(500)} | {"x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149}
    n = {w: rng.randint(1, 30) for w in words}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n int"), block, rows, units).select("word", "n", "n_near", "form", "form_n", "root").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {r[0]: tuple(r)[1:] for r in got} == plain_variants(n)


def test_words_of_texts(spark):
    rows = [(1, "Garden gardeN; GARDEN ÉTÉÉÉ étéÉÉ"), (None, "garden"), (2, None), (3, ""), (3, "Garden ééé" * 3), (3, "Garden ééé" * 3), (97, "garden " * 5000)]
    want = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                want[run] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    assert {r["word"]: r["n"] for r in spelling.words(docs, 5, 2, edit_every=3).collect()} == {w: n for w, n in want.items() if n >= 2}
    none = spelling.variants(spelling.words(docs.limit(0)))
    assert none.columns == ["word", "n", "n_near", "form", "form_n", "root"] and none.count() == 0


# ---- vector codes ----------------------------------------------------------------------------
def plain_codes(x, parts, entries, rounds):
    x = np.asarray(x, np.int64)
    books, codes, error = [], [], np.zeros(len(x), np.int64)
    for p in range(parts):
        own = x[:, p * x.shape[1] // parts:(p + 1) * x.shape[1] // parts]
        book = own[:entries].copy()
        d = lambda: ((own[:, None, :] - book[None]) ** 2).sum(2)
        for _ in range(rounds):
            code = d().argmin(1)
            for e in set(code.tolist()):
                book[e] = own[code == e].sum(0) // (code == e).sum()
        codes.append(d().argmin(1))
        error += d().min(1)
        books.append(book)
    return books, np.stack(codes, 1), error


def test_ball_assignment_is_exact():
    rng = np.random.default_rng(5)
    for spread in (3, 40, 2000):
        x = rng.integers(-spread, spread, (900, 4)).astype(float)
        book = np.concatenate([x[:30], x[:3], rng.integers(-spread, spread, (20, 4))]).astype(float)     # some entries are equal
        code = rng.integers(0, len(book), len(x))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        got, far = ballkmeans.reassign(x, book, code)
        assert (got == d.argmin(1)).all() and (far == d.min(1)).all()


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((300, 10)) * 0.1).astype(np.float32).astype(float)
    v[250:] = v[7]                                                                                       # a common vector
    good = [(i, row.tolist(), None if i % 5 == 0 else i % 3) for i, row in enumerate(v)]
    bad = [(400, None, 1), (401, [], 1), (402, [None] + [0.1] * 9, 1), (403, [math.nan] * 10, 1), (404, [math.inf] * 10, 1), (405, [0.5] * 9, 1)]
    last = [(None, v[3].tolist(), 2)]
    t = spark.createDataFrame(bad + good[::-1] + last, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash"))
    c = ballkmeans.compress(t.repartition(5), parts=4, entries=16, rounds=4)
    whole = np.zeros((301, 12), np.int64)
    whole[:, :10] = np.floor(1024 * np.asarray([r[1] for r in good + last]))
    books, codes, error = plain_codes(whole, 4, 16, 4)
    assert all((a == b).all() for a, b in zip(books, c.books))
    got = {r["vec_id"]: (r["code"], r["error"], r["label"]) for r in c.rows.collect()}
    assert got == {i: ("".join(f"{e:02x}" for e in codes[k]), int(error[k]), lab) for k, (i, _, lab) in enumerate(good + last)}
    few = ballkmeans.compress(t.where("vec_id < 5"))
    assert [len(b) for b in few.books] == [5] * 4 and few.rows.agg(F.sum("error")).first()[0] == 0
    assert ballkmeans.compress(t.limit(0)).rows.count() == 0
    with pytest.raises(Exception, match="beyond"):
        ballkmeans.compress(spark.createDataFrame([(1, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label int"))


# ---- language model --------------------------------------------------------------------------
TEXT = "The river ran under the stone bridge and the river was cold".split()


def corpus(spark):
    rng = random.Random(11)
    en, xx = "the of river stone and bridge cold warm under was".split(), "ba be bi bo bu da de di do du".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else xx) for _ in range(40))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "zzz once-only " + "the " * 30000), (None, "The\tRIVER\x0bstone"), (3, rows[3][1]), (3, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))


def plain_tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_scores_of_texts(spark):
    docs = corpus(spark)
    model = lbl.fit(docs, ~lbl.held_out(F.col("doc_id")), head=64, lookup=8, classes=8, width=8)
    rows = lbl.score(docs, model).withColumn("held", lbl.held_out(F.col("doc_id"))).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    n = collections.Counter(w for i, t in texts if not is_held(i) for w in plain_tokens(t))
    total, v = sum(n.values()), len(n)
    base = lambda t: sum(math.log10((n[w] + 0.5) / (total + 0.5 * (v + 1))) for w in plain_tokens(t))
    assert len(rows) == len(texts) and {r["train_tokens"] for r in rows} == {total}
    for r in rows:
        w = plain_tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["held"]) == (len(w), sum(n[x] > 0 for x in w), is_held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base(r["text"])) and r["score"] <= 0
    held = [r for r in rows if r["held"] and r["text"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    same = collections.defaultdict(set)
    for r in rows:
        same[r["text"]].add(round(r["score"], 6))
    assert all(len(s) == 1 for s in same.values())


def test_probabilities_add_up(spark):
    """Over every training word, the end and one unseen word, after any context."""
    docs = corpus(spark)
    model = lbl.fit(docs, F.lit(True), head=16, lookup=8, classes=4, width=8)
    words = sorted({w for r in docs.collect() for w in plain_tokens(r["text"]) if w}) + ["never-seen"]
    for context in ("", "the", "ba the"):
        s = {r["text"]: r["score"] for r in lbl.score(spark.createDataFrame([(0, f"{context} {w}") for w in words] + [(0, context), (0, f"{context} ")], "doc_id long, text string").distinct(), model).collect()}
        p = model.sent["p"]
        ids = {}
        import pyarrow as pa
        for w in [*words, None]:
            text = " ".join([context] + ([w] if w else []))
            h, begin = lbl.tokens(*lbl.buffers(pa.array([text])))
            at = lbl._find(p["keys"], h)
            each = np.where(at < 0, len(p["words"]), p["number"][at])
            lp = lbl.log_probabilities(p, each, begin)
            k = len(h) - (2 if w else 1)
            known = lbl._find(model.sent["known"], h[k:k + 1])[0]
            ids[w] = (math.exp(lp[k]), each[k] == len(p["words"]), model.sent["counts"][known] if known >= 0 else None)
        counts = {w: n for w, n in collections.Counter(w for r in docs.collect() for w in plain_tokens(r["text"])).items()}
        total = 0.0
        for w, (q, is_tail, _) in ids.items():
            total += q * ((model.sent["unseen"] if w == "never-seen" else (1 - model.sent["unseen"]) * counts[w] / model.sent["rest"]) if is_tail else 1.0)
        assert total == pytest.approx(1.0, abs=1e-4) and all(x <= 0 for x in s.values())


def test_model_of_nothing(spark):
    docs = corpus(spark)
    model = lbl.fit(docs, F.lit(False))
    assert {(r["n_known"], r["score"], r["base_score"]) for r in lbl.score(docs, model).collect()} == {(0, 0.0, 0.0)}
    assert lbl.score(docs.limit(0), model).count() == 0
    one = lbl.fit(docs.where("doc_id = 501"), F.lit(True))
    assert (one.n, one.v) == (1, 1) and lbl.score(docs, one).count() == docs.count()


def test_registered_scores(spark, sf):
    rows = queries.PLANS["op13_lm_score"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# ---- rows without ids, or with one -----------------------------------------------------------
@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_draws_per_row(spark, doc_id):
    from eventloom.llm import mix
    rows = spark.range(5000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.expr("case when id < 2500 then 'w w w w' else concat('w w w ', id) end").alias("text"), F.expr("if(id % 2 = 0, 'a', 'b')").alias("source")).repartition(6)
    weights = spark.createDataFrame([("a", 3.0), ("b", 7.0)], "source string, weight double")
    r = mix.repetitions(rows, weights).collect()
    for s in "ab":
        own = [x for x in r if x["source"] == s]
        assert len(own) == 2500 and abs(sum(x["size"] * x["copies"] for x in own) / own[0]["target"] - 1) < 0.05       # three deviations of 2,500 draws
    assert mix.mix(rows, weights).count() == sum(x["copies"] for x in r)


def test_one_row_of_each_group_stays(spark):
    from eventloom.llm import neardup
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(None, a)] * 5 + [(4, b)] * 5 + [(4, "quite another text that shares the id of a copy and is clean of it")] + [(5, b + " end"), (6, None), (6, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stays", F.lit("clash")).repartition(4)
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).drop("stays").collect()), key=repr)
    assert got == sorted([(None, a), (4, b), (4, rows[10][1]), (6, None), (6, ""), (None, None)], key=repr)
    assert neardup.keep_one(docs).columns == docs.columns and neardup.keep_one(docs.limit(0)).count() == 0
