"""The registered query of repeated strings against a plain recount: planted passages of over 50 words, shorter and longer than 400 bytes."""
import hashlib
import random
import re

from eventloom.llm import queries

LENGTH = 400


def words(rng, tag, n, low, high):
    """``n`` words that no other text has."""
    return " ".join(f"{tag}{i}".ljust(rng.randint(low, high), "x") for i in range(n))


def planted(rng):
    """Pairs of documents around one passage each; ``(rows, bytes of the passage by doc_id)``."""
    rows, size = [], {}
    for k, (n, low, high) in enumerate([(51, 5, 6), (60, 4, 6), (51, 8, 9), (70, 6, 8), (100, 5, 9)]):
        passage = words(rng, f"p{k}", n, low, high)
        for side in "ab":
            size[len(rows)] = len(passage.encode())
            rows.append(f"{words(rng, f'{side}{k}h', 40, 5, 8)} {passage} {words(rng, f'{side}{k}t', 40, 5, 8)}")
    for n in (399, 400, 401):
        passage = words(rng, f"q{n}", 90, 6, 7).encode()[:n - 1].decode() + "|"
        for side in "ab":
            size[len(rows)] = n
            rows.append(f"{words(rng, f'{side}{n}h', 9, 5, 8)}{side}{passage}{side.upper()}{words(rng, f'{side}{n}t', 9, 5, 8)}")
    return rows, size


def recount(texts):
    seen, out = {}, []
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for j in range(len(b) - LENGTH + 1):
            seen[b[j:j + LENGTH]] = seen.get(b[j:j + LENGTH], 0) + 1
    for b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - LENGTH + 1):
            if seen[b[j:j + LENGTH]] > 1:
                gone[j:j + LENGTH] = b"\1" * LENGTH
        spans = sum(g and not before for before, g in zip(b"\0" + gone, gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_registered_repeats(spark, tmp_path):
    rng = random.Random(9)
    texts, size = planted(rng)
    clean = range(len(texts), len(texts) + 5)
    texts += [words(rng, f"c{i}", 120, 5, 8) for i in clean]
    line = words(rng, "line", 80, 6, 8)
    texts += [f"{line}\n{words(rng, 'gap', 30, 5, 8)}\n{line}", "y" * 401, "z" * 400, "é" * 300, texts[0], texts[0], "", None, "é" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.PLANS["op9_repeated_strings"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(recount(texts)))
    for i, n in size.items():
        if i:      # document 0 has copies
            assert (got[i][1] >= n) == (n >= LENGTH) and (got[i][1] == 0) == (n < LENGTH)
    assert {n >= LENGTH for n in size.values()} == {True, False} and not any(got[i][1] for i in clean)


def recount_shared(texts, run=51):
    lists = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    held = {}
    for i, w in enumerate(lists):
        for j in range(len(w) - run + 1):
            held.setdefault(tuple(w[j:j + run]), set()).add(i)
    return [sum(len(held[tuple(w[j:j + run])]) > 1 for j in range(len(w) - run + 1)) for w in lists]


def test_passages_of_over_fifty_words_are_counted(spark, tmp_path):
    rng = random.Random(10)
    texts, _ = planted(rng)
    at = len(texts)
    short, fifty = words(rng, "s", 51, 3, 6), words(rng, "f", 50, 6, 9)
    texts += [f"{words(rng, f'{side}h', 30, 5, 8)} {p} {words(rng, f'{side}t', 30, 5, 8)}" for p in (short, fifty) for side in "ab"]
    spaced = words(rng, "w", 60, 4, 6)
    texts += [f"{spaced} {words(rng, 'r', 20, 5, 8)}", words(rng, "l", 20, 5, 8) + "\n" + re.sub(" ", lambda _: rng.choice([" ", "\n\n", "\t ", "\x0b"]), spaced), spaced.upper()]
    line = words(rng, "line", 80, 6, 8)
    clean = range(len(texts), len(texts) + 5)
    texts += [f"{line}\n{words(rng, 'gap', 30, 5, 8)}\n{line}"] + [words(rng, f"c{i}", 120, 5, 8) for i in range(4)]
    texts += ["a " * 60, "a " * 55 + "b", "é" * 3000, texts[0], texts[0], short, short, "x y", "x y", "", None, "\xa0".join("z" * 70)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.PLANS["op9_repeated_strings"](spark, str(tmp_path)).collect()}
    assert {i: r["n_shared"] for i, r in got.items()} == dict(enumerate(recount_shared(texts)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == dict(enumerate(recount(texts)))
    assert len(short) < LENGTH and got[at]["n_shared"] == 1 and got[at]["n_removed"] == 0 and not any(got[i]["n_shared"] for i in clean)
