"""Each operator against a plain version on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import chat, decontam, fingerprint, langid, mix, neardup, shard, suffix, tokens, urlfilter
from eventloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "the of and with from there where about little house garden river under stone light water morning evening people city".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 40, 200, 4000)]
    rows = [(0, base[0]), (1, base[1]), (2, base[2]), (3, base[3]), (4, None), (5, ""), (6, base[2]), (None, base[2]), (7, base[2] + " end"), (8, " \t\n "), (9, "1234 !!"), (9, "1234 !!"), (10, "Été " * 30)]
    rows += [(20 + i, prose(rng, 60)) for i in range(20)]
    return spark.createDataFrame([(i, t, "en" if t and i is not None and i % 3 else None, ["a", "b", None, "ä"][k % 4], 0) for k, (i, t) in enumerate(rows)], DOCS).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_round_trip(spark):
    rows = [(1, 0, 0, "message", "user", "a\\b </turn> ### x"), (1, 1, 0, "message", "assistant", "no"), (1, 1, 1, "delta", None, "!"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "Hel"), (1, 1, 4, "delta", None, "lo"),
            (1, 2, 0, None, "user", "q"), (1, 2, 5, "edit", None, "Q: \\"), (1, 3, 0, "message", "assistant", "</turn>"), (1, 3, 0, "message", "assistant", "</turn>"), (None, None, 0, "delta", None, None), (2, 0, 1, "message", "a: b", chat.HEAD * 2 + "\\" * 3)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.format_chats(log).select("conv_id", "formatted", chat.turns(F.col("formatted")).alias("t"), chat.learned(F.col("segments")).alias("l")).collect()}
    said = [tuple(t) for t in out[1]["t"]]
    assert said == [("user", "a\\b </turn> ### x"), ("assistant", "Hello"), ("user", "Q: \\"), ("assistant", "</turn>"), ("assistant", "</turn>")]
    assert out[1]["l"] == "Hello</turn></turn>"
    assert [tuple(t) for t in out[None]["t"]] == [("", "")] and [tuple(t) for t in out[2]["t"]] == [("a: b", "### ### \\\\\\")]
    assert chat.format_chats(log.limit(0)).count() == 0


def test_mix_meets_targets(spark, docs):
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 7 as int))").alias("text"), F.expr("case when id % 10 < 6 then 'a' when id % 10 < 9 then 'b' end").alias("source"), F.lit(5).alias("size"))
    r = mix.repetitions(big, (1.0, 2.0, 3.0)).collect()
    for s in ("a", "b", None):
        own = [x for x in r if x["source"] == s]
        assert abs(sum(x["size"] * x["copies"] for x in own) / own[0]["target"] - 1) < 0.05
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6 and max(x["copies"] for x in own) <= 3
    assert sum({x["source"]: x["target"] for x in r}.values()) == pytest.approx(sum(x["size"] for x in r))
    out = mix.mix(big, (1.0, 2.0, 3.0))
    assert out.columns == big.columns and out.count() == sum(x["copies"] for x in r) and {x["size"] for x in out.collect()} == {5}
    assert mix.mix(empty(spark), (1.0,)).count() == 0
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {x["source"] for x in mix.mix(big, weights).collect()} == {"a"}
    assert mix.repetitions(docs, (1.0, 2.0, 3.0)).count() == docs.count()


def test_tokens_equal_the_library(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(1)
    bits = ["'s", "'re", "'r", "'ll", "''s", "a", " ", "  ", "\n", "\t", "12", "é", "ß", "中", "!", "<|endoftext|>", "<|endo", "'", "\u3000", "ve", "\u0301", "🙂", "Ⅷ", "²", "x'd"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["a" * 5000, " " * 3000, "ab" * 2000, "", None]
    frame = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long").unionByName(docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_tokens")))
    got = tokens.count_tokens(frame, path).collect()
    want = Tokenizer.from_file(path).encode_batch([r["text"] or "" for r in got], add_special_tokens=False)
    assert [r["n_tokens"] for r in got] == [len(w.ids) for w in want] and all(r["n_bytes"] == len((r["text"] or "").encode()) for r in got)
    assert tokens.count_tokens(frame.limit(0), path).count() == 0


def test_language_by_words_then_grams(spark):
    rng = random.Random(3)
    de = "der die und mit von haus garten fluss stein licht wasser morgen abend leute stadt schule".split()
    rows = [(i, prose(rng, 30) if i % 2 else " ".join(rng.choice(de) for _ in range(30)), "en" if i % 2 else "de") for i in range(400)]
    extra = [(1000, None, "en"), (1001, "", None), (1002, "12 !! ²Ⅷ", "de"), (1003, "Gartenwasserstadt", None), (1004, "gardenwaters", None), (None, "the river", None)]
    frame = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit(9.0))
    out = {r["doc_id"]: r for r in langid.identify(frame, ~langid.held_out(F.col("doc_id"))).collect()}
    assert len(out) == 406 and all(out[i]["lang_pred"] == x for i, _, x in rows) and all(0 <= r["score"] <= 1 for r in out.values())
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "de", "en", "en"]
    kept = langid.keep_known(frame)
    assert kept.columns == frame.columns and {r["score"] for r in kept.collect()} == {9.0} and kept.count() == 403
    assert {r["lang_pred"] for r in langid.identify(frame, F.lit(False)).collect()} == {"und"}
    assert langid.identify(frame.limit(0)).count() == 0


def test_language_scores_equal_a_plain_version():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 9)))
    words = {w: [rng.randint(0, 9), rng.randint(1, 9)] for w in (word() for _ in range(60))}
    grams = {}
    for w, c in words.items():
        for n in (5, 4, 3, 2):   # no single letters: words of one letter may meet no n-gram
            for j in range(len(w) + 3 - n):
                grams[f"<{w}>"[j:j + n]] = c
    total = [900, 700]
    table = lambda d: (list(d), np.asarray(list(d.values()), float))
    model = langid.Model(["x", "y"], table(words), table(grams), total)
    wanted = [*words, *(word() for _ in range(300)), "zzzz", "z", "中"]
    for w, got in zip(wanted, model.score(wanted)):
        want = [math.log(0.1 / (t + 0.1 * (len(words) + 1))) + 6 * math.log(0.4) for t in total]
        if w in words:
            want = [math.log((c + 0.1) / (t + 0.1 * (len(words) + 1))) for c, t in zip(words[w], total)]
        else:
            for down, n in enumerate((5, 4, 3, 2, 1), 1):
                own = {g: c for g, c in grams.items() if len(g) == n}
                hits = [own[g] for j in range(len(w) + 3 - n) if (g := f"<{w}>"[j:j + n]) in own]
                if hits:
                    want = [sum(math.log((h[k] + 0.1) / (sum(c[k] for c in own.values()) + 0.1 * (len(own) + 1))) for h in hits) / len(hits) + down * math.log(0.4) for k in (0, 1)]
                    break
        assert got.tolist() == pytest.approx(want, rel=1e-5), w


def test_language_model_keeps_rare_words(spark):
    w = lambda i: "".join(chr(97 + i // 26 ** j % 26) for j in range(4))
    rows = [(i, " ".join([w(1000 * (i // 2) + j) for j in range(1000)] * 2), "en" if i < 10 else "de") for i in range(0, 200, 2)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.words[0]) == 100_000


def test_shards_are_equal_and_gapless(spark, docs):
    rng = random.Random(5)
    rows = [(i, "same text" if i % 3 == 0 else prose(rng, rng.randint(1, 80))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x"))
    out = shard.layout(shard.assign(frame, 8)).collect()
    sizes, slots = [0] * 8, [set() for _ in range(8)]
    for r in out:
        sizes[r["shard"]] += len(r["text"]) + 1
        slots[r["shard"]].add(r["slot"])
    assert len(out) == 3000 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8
    assert sum(map(len, slots)) == 3000 and all(s == set(range(len(s))) for s in slots)
    homes = {}
    for r in out:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(v) == 1 for t, v in homes.items() if t != "same text")
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in shard.layout(shard.assign(frame, 8)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in out}
    assert shard.layout(shard.assign(docs, 8)).count() == docs.count() and shard.layout(shard.assign(empty(spark), 8)).count() == 0


def test_fingerprints_and_neighbours(spark, docs):
    out = fingerprint.compare_with_next(docs).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted((i if i is not None else -1, len(t), hashlib.sha256(fingerprint.edit(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in out) == want
    assert all(0 <= r[c] <= 1 for r in out for c in ("near_edited", "near_next")) and fingerprint.compare_with_next(empty(spark)).count() == 0
    prints = {}
    for r in fingerprint.fingerprints(docs).collect():
        prints.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    long = next(r for r in out if r["doc_id"] == 3)
    assert long["near_edited"] > long["near_next"]


def plain_tile(text, item, least):
    """The longest common run of free words is marked again and again; of equal ones the first in the text, then in the item."""
    free_t, free_i, least = [True] * len(text), [True] * len(item), min(least, len(item))
    while True:
        run, best = {}, (0, 0, 0)
        for t in range(len(text) - 1, -1, -1):
            for i in range(len(item) - 1, -1, -1):
                run[t, i] = 1 + run.get((t + 1, i + 1), 0) if free_t[t] and free_i[i] and text[t] == item[i] else 0
                best = min(best, (-run[t, i], t, i))
        k, t, i = -best[0], *best[1:]
        if k < least or not k:
            return free_i.count(False)
        free_t[t:t + k] = free_i[i:i + k] = [False] * k


def test_tiles_equal_brute_force():
    rng = random.Random(11)
    for n in [*range(5, 61), 22, 23, 44, 45, 46, 47]:
        for words in (10 ** 6, 12):   # few words: the item repeats itself
            for _ in range(8):
                item = np.asarray([rng.randrange(words) for _ in range(n)], np.uint64)
                cuts = [(a, a + rng.randint(5, 10)) for a in (rng.randrange(max(1, n - 4)) for _ in range(4))]
                text = np.concatenate([item[a:b] for a, b in cuts] + [np.asarray([7], np.uint64)])
                assert decontam.tile(text, item, 5) == plain_tile(text.tolist(), item.tolist(), 5), (n, cuts)


def plain_groups(rows, k):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[n] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {n: n for n in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            top[find(b)] = find(a)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted((i if i is not None else -1, len(sets[n]), low.get(find(n)) if sets[n] else i) for n, (i, _) in enumerate(rows))


def test_near_copies_equal_brute_force(spark, docs):
    rng = random.Random(11)
    base = prose(rng, 150).split()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(150):           # a group whose members are more or less alike
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB) + str(rng.randrange(50))
        rows.append((1000 - i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    for k in (4, 5):
        got = neardup.groups(frame, k=k).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in got) == plain_groups(rows, k)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns and neardup.groups(empty(spark)).count() == 0 and neardup.keep_one(empty(spark)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}


def test_tiling_finds_reordered_passages(spark, docs):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    swapped = " ".join(item[15:] + ["filler"] * 5 + item[:15]).upper()
    part = prose(rng, 50) + " " + " ".join(item[:9]) + " " + prose(rng, 50)
    frame = spark.createDataFrame([(1, swapped), (2, part), (3, prose(rng, 50)), (4, None), (5, ""), (6, "tiny item"), (6, swapped)], "doc_id long, text string").withColumn("coverage", F.lit("own"))
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "tiny item"), (2, None), (3, ""), (None, "zz " * 9)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], round(r["coverage"], 3), r["contaminated"]) for r in decontam.annotate(frame, bench).where("n_items > 0").collect())
    assert got == [(1, 0, 1.0, True), (2, 0, 0.3, False), (6, 0, 1.0, True), (6, 1, 1.0, True)]
    left = decontam.clean(frame, bench)
    assert left.columns == frame.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5] and {r["coverage"] for r in left.collect()} == {"own"}
    assert decontam.clean(frame, bench.limit(0)).count() == 7 and decontam.clean(empty(spark), bench).count() == 0
    assert decontam.annotate(docs, bench).count() == docs.count()


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(20)]
    frame = spark.createDataFrame([(i, "a b " + t + " c") for i, t in items], "doc_id long, text string")
    got = decontam.annotate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["item_id"] == r["doc_id"] and r["contaminated"] for r in got)


@pytest.mark.parametrize("length", [20, 33])
def test_repeats_equal_brute_force(spark, docs, length):
    rng = random.Random(4)
    shared = prose(rng, 12)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + i, prose(rng, 20) + shared + prose(rng, 10)) for i in range(6)] + [(200, "a" * 90), (201, "ab" * 60), (202, "é" * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            seen.setdefault(b[j:j + length], []).append((n, j))
    want = []
    for n, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if len(seen[b[j:j + length]]) > 1:
                gone[j:j + length] = b"\1" * length
        want.append((i if i is not None else -1, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    all_, texts = suffix.repeated(frame, length)
    cut = {(r["x1"], r["x2"]): r for r in texts.collect()}
    got = []
    for r in all_.collect():
        c = cut.get((r["x1"], r["x2"]))
        got.append((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], sum(e - s for s, e in zip(c["starts"], c["ends"])) if c else 0, hashlib.sha256(c["kept"]).hexdigest() if c else r["whole"]))
    assert sorted(got) == sorted(want)
    none, nothing = suffix.repeated(empty(spark), length)
    assert none.count() == 0 and nothing.count() == 0


def test_url_rules_exactly(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "EXAMPLE.com", "net", "a.net", "xnet", "org", "", "a..com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/x', '/es/', '/fr/1?x=/en/', '#://'])}" for _ in range(300)] + [None, "", "no scheme", "a://b://com/", "://", "x\n://com/en/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [("allow", "com", "/"), ("block", "Example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "org", ""), (None, "x", "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), (h + p).lower(), v) for v, h, p in rules if v and m and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        assert got[i] == (max(fits)[1:] if fits else (None, "allow")), (u, got[i])
    no_rules = urlfilter.judge(pages, spark.createDataFrame([], "verdict string, host string, path string"))
    assert {r["verdict"] for r in no_rules.collect()} == {"allow"} and urlfilter.judge(pages.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    import numpy as np
    keys = np.arange(0, 3000, 7, dtype=np.int64) * 2654435761
    all_ = np.arange(0, 3000, dtype=np.int64) * 2654435761
    levels = urlfilter.cascade(spark.createDataFrame([(int(k),) for k in all_], "key long"), keys)
    assert (urlfilter.listed(levels, all_) == np.isin(all_, keys)).all()


def test_near_copies_without_ids_meet_by_text(spark):
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(None, t) for t in base] + [(None, t + " end") for t in base] + [(7, base[0]), (7, "another text of six words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.groups(docs, k=4).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (None, 7), (7, 7)}
    assert sum(r["component_id"] == 7 for r in got) == 4
    plan = neardup.groups(docs, k=4)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
