"""The registered queries of the operators of this folder, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import ballkmeans, chat, decontam, fingerprint, langid, lbl, mix, neardup, shard, spelling, suffix, tokens, urlfilter

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(key: str, sql: str | None = None):
    def wrap(fn):
        PLANS[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return wrap


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TRICKY = "\\### Assistant: </turn> ok"


@plan("op1_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ': ', ':\ ') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by turn are complete messages of a log; the digests are of what the formatted text says when it is read back."""
    c = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    log = c.unionByName(own).withColumns({"seq": F.lit(0), "kind": F.lit("message")})
    f = chat.format_chats(log).select("conv_id", "formatted", chat.turns(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
                    F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


WEIGHTS = (1.0, 2.0, 3.0)


@plan("op3_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM s),
c AS (SELECT *, sum(3.0::DOUBLE * source_size) OVER w AS capped, sum(weight) OVER w AS used, lead(3.0 * source_size / weight) OVER (ORDER BY k) AS next FROM r WINDOW w AS (ORDER BY k)),
t AS (SELECT sum(source_size)::DOUBLE AS total, sum(weight) AS weight FROM s),
f AS (SELECT 0 AS k, total / weight AS share, (SELECT min(3.0 * source_size / weight) FROM s) AS next FROM t
  UNION ALL SELECT c.k, (t.total - c.capped) / (t.weight - c.used), c.next FROM c, t WHERE t.weight > c.used),
l AS (SELECT share FROM f WHERE next IS NULL OR next > share ORDER BY k LIMIT 1),
p AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, l.share * weight) AS target FROM s, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM p)
SELECT d.doc_id, d.size, q.source_size, q.target,
  d.size * (CAST(floor(q.rate) AS BIGINT) + CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < q.rate - floor(q.rate) AS BIGINT)) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    r = mix.repetitions(_table(spark, sf, "documents").select("doc_id", "source", "text"), WEIGHTS)
    return r.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@plan("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens.count_tokens(_table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@plan("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    return langid.identify(d, ~langid.held_out(F.col("doc_id"))).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@plan("op6_shard")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Eight shards of equal bytes: the documents move with their texts, and the digests are of what has moved."""
    d = shard.layout(shard.assign(_table(spark, sf, "documents").select("doc_id", "text"), 8))
    return d.select("doc_id", shard.size(F.col("text")).alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
                    F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@plan("op7_fingerprint")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, sf, "documents"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@plan("op10_url_filter", r"""
WITH p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p FROM pages),
u AS (SELECT page_id, coalesce(h, '') AS host, coalesce(p, '') AS path FROM p),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT u.page_id, u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, coalesce(arg_max(r.verdict, length(r.h || r.p)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
GROUP BY u.page_id, u.host, u.path""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return urlfilter.judge(_table(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@plan("op2_decontaminate")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document; ``contaminated`` ones cover half of a benchmark item in runs of five words or more."""
    d = decontam.annotate(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark"))
    return d.select("doc_id", "n_words", "n_items", "item_id", "coverage", "contaminated")


@plan("op8_near_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(_table(spark, sf, "documents").select("doc_id", "text"), k=4)


@plan("op9_repeated_strings")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Documents less the bytes of repeated 400-byte strings; untouched texts are digested where they are read. Passages of over 50 words
    that another document has too are counted in ``n_shared``, whatever their bytes; below 400 bytes they stay."""
    d = _table(spark, sf, "documents").select("doc_id", "text")
    rows, texts, shared = suffix.repeated_and_shared(d, 400, 51)
    cut = texts.select("x1", "x2", F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
                       F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.lit(0).cast("long").alias("n_shared"))
    cut = cut.unionByName(shared, allowMissingColumns=True).groupBy(F.col("x1").alias("_x1"), F.col("x2").alias("_x2")).agg(*[F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "n_shared")])
    return rows.join(cut, (F.col("x1") == F.col("_x1")) & (F.col("x2") == F.col("_x2")), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))


def _crc_table() -> list[int]:
    """What a byte does to a crc32, by its polynomial."""
    def turned(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c
    return [turned(i) for i in range(256)]


@plan("op11_spelling_variants", f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_crc_table()}::BIGINT[] AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM low),
hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
edited AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, rest FROM cut JOIN v ON v.word = rest UNION SELECT rest, cut.word FROM cut JOIN v ON v.word = rest),
ranked AS (SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(p.near)) AS k FROM pairs p JOIN v w ON w.word = p.near),
out AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN ranked r ON r.word = v.word AND k = 1),
up AS (SELECT word, word AS root, form FROM out UNION ALL SELECT up.word, out.word, out.form FROM up JOIN out ON out.word = up.form)
SELECT out.word, out.n, out.n_near, out.form, out.form_n, up.root FROM out JOIN up ON up.word = out.word AND up.form IS NULL""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(spelling.words(_table(spark, sf, "documents").select("doc_id", "text"), 5, 3, edit_every=97)).select("word", "form", "root", "n", "n_near", "form_n")


def _compression_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after another; an assignment compares every part with every entry."""
    def assign(k: int) -> str:
        return (f"d{k} AS (SELECT p.row, p.part, c.entry, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS d FROM p JOIN c{k} c ON c.part = p.part),\n"
                f"a{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY row, part),\n")

    def update(k: int) -> str:
        return (f"s{k} AS (SELECT part, entry, i, floor(sum(x) / count(*)) AS x FROM (SELECT a.part, a.entry, unnest(range(len(p.v))) AS i, unnest(p.v) AS x FROM a{k} a JOIN p ON p.row = a.row AND p.part = a.part) GROUP BY part, entry, i),\n"
                f"m{k} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM s{k} GROUP BY part, entry),\n"
                f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry),\n")

    return (f"""WITH k AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT *, list_transform(e, lambda x: floor(1024 * x)) AS v, row_number() OVER (ORDER BY vec_id, e) - 1 AS row FROM k),
p AS MATERIALIZED (SELECT row, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM w, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, row AS entry, v FROM p WHERE row < {entries}),
""" + "".join(assign(k) + update(k) for k in range(rounds)) + assign(rounds) + f"""f AS (SELECT w.vec_id, w.label, a.* FROM w JOIN (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row) a ON a.row = w.row),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f GROUP BY label),
b AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(range(len(v))) AS i, unnest(v) AS x FROM c{rounds}))
SELECT f.vec_id, f.code, f.error, l.label_error, b.codebooks_sha256 FROM f JOIN l ON l.label IS NOT DISTINCT FROM f.label, b""")


@plan("op12_vector_codes", _compression_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    c = ballkmeans.compress(_table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), parts=4, entries=256, rounds=4)
    of = c.rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return c.rows.join(of, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(c.sha256()).alias("codebooks_sha256"))


@plan("op13_lm_score")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").select("doc_id", "text")
    scored = lbl.score(d, lbl.fit(d, ~lbl.held_out(F.col("doc_id"))))
    return scored.select("doc_id", lbl.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
