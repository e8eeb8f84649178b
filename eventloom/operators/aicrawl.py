"""What AI crawlers fetched: identification, roll-ups, coverage gaps and findings."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import values as v
from eventloom.model import attach_row, lit_ts
from eventloom.session import materialize

# fixed values: user-agent pattern, crawler, operator, purpose
CRAWLERS = (
    ("chatgpt-user", "ChatGPT-User", "OpenAI", "user"),
    ("oai-searchbot", "OAI-SearchBot", "OpenAI", "search"),
    ("gptbot", "GPTBot", "OpenAI", "training"),
    ("claude-user", "Claude-User", "Anthropic", "user"),
    ("claude-searchbot", "Claude-SearchBot", "Anthropic", "search"),
    ("claudebot", "ClaudeBot", "Anthropic", "training"),
    ("claude-web", "Claude-Web", "Anthropic", "search"),
    ("anthropic-ai", "Anthropic-AI", "Anthropic", "training"),
    ("perplexity-user", "Perplexity-User", "Perplexity", "user"),
    ("perplexitybot", "PerplexityBot", "Perplexity", "search"),
    ("google-extended", "Google-Extended", "Google", "training"),
    ("bingbot", "Bingbot", "Microsoft", "search"),
    ("applebot-extended", "Applebot-Extended", "Apple", "training"),
    ("applebot", "Applebot", "Apple", "search"),
    ("meta-externalagent", "Meta-ExternalAgent", "Meta", "training"),
    ("bytespider", "Bytespider", "ByteDance", "training"),
    ("amazonbot", "Amazonbot", "Amazon", "search"),
    ("ccbot", "CCBot", "Common Crawl", "training"),
    ("cohere-ai", "Cohere-AI", "Cohere", "training"),
    ("mistralai-user", "MistralAI-User", "Mistral", "user"),
    ("diffbot", "Diffbot", "Diffbot", "training"),
    ("timpibot", "Timpibot", "Timpi", "training"),
    ("youbot", "YouBot", "You.com", "search"),
    ("duckassistbot", "DuckAssistBot", "DuckDuckGo", "search"),
)
# fixed values: fragments only a vulnerability scanner asks for
PROBES = ("/.env", "/.git", "/.aws", "/.ssh", "/@fs/", "/etc/passwd", "/wp-admin", "/wp-login", "/phpmyadmin",
          "/.well-known/security", "/config.json", "/credentials", "/id_rsa", "/actuator", "/.svn",
          "/vendor/phpunit", "/xmlrpc.php", "/shell", "/cgi-bin/")
# fixed values: first path segments that are almost always behind a login
PRIVATE_SEGMENTS = ("dashboard", "app", "admin", "account", "settings", "billing", "profile", "projects", "project",
                    "workspace", "team", "teams", "org", "orgs", "onboarding", "logout", "signout", "auth", "internal",
                    "portal", "console")
PURPOSES = ("training", "search", "user")
MAX_ROWS = 25
CRAWL, SCAN = "$ai_crawl", "$site_readable"


def crawler_table() -> list[tuple[str, str, str, str]]:
    return sorted(CRAWLERS, key=lambda r: -len(r[0]))


def identify(ua: Column) -> Column:
    """struct(crawler, operator, purpose) of the longest matching pattern, NULL otherwise."""
    low, out = F.lower(ua), None
    for pat, name, op, purpose in crawler_table():
        val = F.struct(F.lit(name).alias("crawler"), F.lit(op).alias("operator"), F.lit(purpose).alias("purpose"))
        out = (F.when if out is None else out.when)(F.contains(low, F.lit(pat)), val)
    return out


def norm_path(p: Column) -> Column:
    """Query, fragment and trailing slashes dropped; full URLs reduced to their path; empty is '/'."""
    # each step uses its input once, so the expression stays small wherever Catalyst inlines it
    s = F.trim(F.regexp_replace(F.coalesce(p, F.lit("")), r"[?#].*$", ""))
    s = F.regexp_replace(s, r"^[^/].*?://[^/]*", "")
    return F.regexp_replace(F.regexp_replace(s, "/+$", ""), "^(?!/)", "/")


def is_probe(path: Column) -> Column:
    return F.lower(path).rlike("|".join(re.escape(frag) for frag in PROBES))


def _window(df: DataFrame, days: int, asof: str) -> DataFrame:
    first = F.date_trunc("day", lit_ts(asof)) - F.expr(f"interval {days - 1} days")
    return df.where((F.col("timestamp") >= first) & (F.col("timestamp") <= lit_ts(asof)))


def crawls(df: DataFrame, days: int, asof: str) -> DataFrame:
    """Crawl rows of the calendar window with normalised path and a probe flag."""
    d = _window(df.where(F.col("name") == CRAWL), days, asof)
    t = lambda k: F.trim(F.coalesce(v.text(d, k), F.lit("")))
    rows = d.select("id", "timestamp", t("crawler").alias("crawler"), F.when(t("operator") == "", "unknown").otherwise(t("operator")).alias("operator"),
                    t("purpose").alias("purpose"), norm_path(t("path")).alias("path"),
                    (F.coalesce(v.num_strict(d, "status"), F.lit(0.0)) >= 400).alias("bad"))
    return rows.where("crawler <> ''").withColumn("probe", is_probe(F.col("path")))


def _rows(df: DataFrame, days: int, asof: str, rows: DataFrame | None) -> DataFrame:
    return crawls(df, days, asof) if rows is None else rows


def _split() -> list[Column]:
    return [F.count(F.when(F.col("purpose") == p, 1)).alias(p) for p in PURPOSES]


def by_crawler(df: DataFrame, days: int, asof: str, rows: DataFrame | None = None) -> DataFrame:
    c = _rows(df, days, asof, rows).where("not probe")
    g = c.groupBy("crawler").agg(
        F.count("*").alias("hits"), F.count_distinct("path").alias("pages"), F.count(F.when(F.col("bad"), 1)).alias("errors"),
        F.min(F.struct("timestamp", "id", "operator", "purpose")).alias("f"), F.max(F.struct("timestamp", "id", "path")).alias("l"))
    return g.select("crawler", F.col("f.operator").alias("operator"), F.col("f.purpose").alias("purpose"), "hits", "pages", "errors",
                    F.unix_micros("l.timestamp").alias("last_us"), F.col("l.path").alias("last_path"))


def by_operator(df: DataFrame, days: int, asof: str, rows: DataFrame | None = None) -> DataFrame:
    c = _rows(df, days, asof, rows).where("not probe")
    return c.groupBy("operator").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("pages"), *_split(),
                                     F.unix_micros(F.max("timestamp")).alias("last_us"))


def by_path(df: DataFrame, days: int, asof: str, limit: int | None = 25) -> DataFrame:
    """The ``limit`` (None: all) most crawled paths."""
    c = crawls(df, days, asof).where("not probe")
    g = c.groupBy("path").agg(F.count("*").alias("hits"), F.count_distinct("crawler").alias("crawlers"),
                              F.count(F.when(F.col("bad"), 1)).alias("errors"), F.unix_micros(F.max("timestamp")).alias("last_us"))
    return g if limit is None else g.orderBy(F.desc("hits"), "path").limit(limit)


def daily(df: DataFrame, days: int, asof: str, rows: DataFrame | None = None) -> DataFrame:
    """Every day of the window, zeros included."""
    c = _rows(df, days, asof, rows).where("not probe")
    per = c.groupBy(F.to_date("timestamp").alias("_d")).agg(F.count("*").alias("hits"), *_split())
    last = F.to_date(lit_ts(asof))
    cal = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("_d"))
    zero = F.lit(0)
    return cal.join(per, "_d", "left").select(F.date_format("_d", "yyyy-MM-dd").alias("day"), F.coalesce("hits", zero).alias("hits"),
                                              *[F.coalesce(p, zero).alias(p) for p in PURPOSES])


def totals(df: DataFrame, days: int, asof: str, rows: DataFrame | None = None) -> DataFrame:
    c = _rows(df, days, asof, rows)
    ok = ~F.col("probe")
    return c.agg(F.count(F.when(ok, 1)).alias("hits"), F.count(F.when(ok & F.col("bad"), 1)).alias("errors"),
                 F.count(F.when(F.col("probe"), 1)).alias("probes"), F.count_distinct(F.when(ok, F.col("path"))).alias("pages"),
                 *[F.count(F.when(ok & (F.col("purpose") == p), 1)).alias(p) for p in PURPOSES])


def disallowed_prefixes(df: DataFrame, asof: str) -> DataFrame:
    """(blocked,): the newest scan's robots.txt disallow prefixes, a row each."""
    s = df.where((F.col("name") == SCAN) & (F.col("timestamp") <= lit_ts(asof)))
    raw = F.max(F.struct("timestamp", "id", F.coalesce(v.text(s, "robots_disallow"), F.lit("")).alias("r")))["r"]
    parts = s.agg(F.split(raw, ",").alias("p")).select(F.explode("p").alias("x"))
    return parts.select(F.trim("x").alias("blocked")).where("blocked <> ''").distinct()


def not_starting_with(df: DataFrame, text: str, prefixes: DataFrame) -> DataFrame:
    """Rows whose ``text`` starts with none of ``prefixes(blocked)``.

    A text is looked up by its prefixes, one for each length that occurs among ``prefixes``, so rows carry
    their own text's prefixes and never the list, however long that is. Texts that share a prefix are looked up once.
    """
    lengths = prefixes.agg(F.collect_set(F.char_length("blocked")).alias("_l")).scalar()      # as many as a path is long, at most
    own = df.select(text).where(F.col(text).isNotNull()).distinct()
    starts = own.withColumn("_l", lengths).select(F.col(text).alias("_t"), F.explode("_l").alias("_n")).where(F.col("_n") <= F.char_length("_t"))
    hit = starts.select("_t", F.substring(F.col("_t"), F.lit(1), F.col("_n")).alias("blocked")).join(prefixes, "blocked", "left_semi").select("_t").distinct()
    return df.join(hit, F.col(text) == F.col("_t"), "left_anti")


def gaps(df: DataFrame, days: int, asof: str, limit: int | None = MAX_ROWS, rows: DataFrame | None = None) -> DataFrame:
    """Pages at least two people read and no crawler fetched, minus disallowed and private ones."""
    fetched = _rows(df, days, asof, rows).where("not probe").select("path").distinct()
    d = _window(df.where(F.col("name") == "$pageview"), days, asof)
    raw = F.coalesce(F.when(v.text(d, "path") != "", v.text(d, "path")), v.text(d, "url"), F.lit(""))
    d = d.where(raw != "").select(norm_path(raw).alias("path"), "distinct_id")
    g = d.groupBy("path").agg(F.count("*").alias("views"), F.count_distinct("distinct_id").alias("visitors")).where("visitors >= 2")
    g = not_starting_with(g.join(fetched, "path", "left_anti"), "path", disallowed_prefixes(df, asof))
    g = attach_row(g, fetched.agg(F.count("*").alias("_n")))
    seg = F.lower(F.split(F.regexp_replace("path", "^/", ""), "/")[0])
    g = g.where("_n > 0").where(~seg.isin(*PRIVATE_SEGMENTS))
    g = g.select("path", "views", "visitors")
    return g.orderBy(F.desc("views"), "path").limit(limit) if limit else g


# fixed values: floors of the crawler findings
MIN_HITS, SILENT_DAYS, ERROR_PCT, GAP_VIEWS = 12, 7, 30, 20
WATCHED_OPERATORS = ("OpenAI", "Anthropic", "Perplexity")


def findings(df: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """(kind, severity, subject, rate, n): errors, a silent crawler, an absent operator, the biggest gap."""
    rows = materialize(crawls(df, days, asof))       # read once, used by every rule
    c = by_crawler(df, days, asof, rows)
    rate = v.pct(F.col("errors"), F.col("hits"))
    row = lambda d, kind, sev, subject, r, n: d.select(F.lit(kind).alias("kind"), F.lit(sev).alias("severity"), subject.alias("subject"),
                                                       r.cast("bigint").alias("rate"), n.cast("bigint").alias("n"))
    err = c.where((F.col("hits") >= MIN_HITS) & (rate >= ERROR_PCT)).orderBy(F.desc("errors"), F.desc("hits"), "crawler").limit(1)
    quiet = F.floor((F.unix_micros(lit_ts(asof)) - F.col("last_us")) / 86_400_000_000)
    stop = c.withColumn("quiet", quiet).where((F.col("hits") >= MIN_HITS) & (F.col("quiet") >= SILENT_DAYS)).orderBy(F.desc("hits"), "crawler").limit(1)
    o = by_operator(df, days, asof, rows).agg(F.sum("hits").alias("hits"), F.count("*").alias("ops"),
                                        F.count(F.when(F.col("operator") != "unknown", 1)).alias("named"),
                                        *[F.max(F.when(F.col("operator") == w, 1).otherwise(0)).alias(w) for w in WATCHED_OPERATORS])
    missing = F.coalesce(*[F.when(F.col(w) == 0, F.lit(w)) for w in WATCHED_OPERATORS])
    absent = o.withColumn("missing", missing).where((F.col("hits") >= 2 * MIN_HITS) & (F.col("ops") >= 2) & (F.col("named") >= 2) & F.col("missing").isNotNull())
    t = totals(df, days, asof, rows).select(F.col("hits").alias("_hits"), F.col("pages").alias("_pages"))
    gap = attach_row(gaps(df, days, asof, limit=1, rows=rows), t).where((F.col("_hits") >= MIN_HITS) & (F.col("views") >= GAP_VIEWS))
    return (row(err, "crawl_errors", "warn", F.col("crawler"), rate, F.col("hits"))
            .unionByName(row(stop, "crawl_stopped", "warn", F.col("crawler"), F.col("quiet"), F.col("hits")))
            .unionByName(row(absent, "crawl_absent", "info", F.col("missing"), F.lit(0), F.col("hits")))
            .unionByName(row(gap, "crawl_gap", "info", F.col("path"), F.col("views"), F.col("_pages"))))


def site_readability(df: DataFrame, asof: str) -> DataFrame:
    """The newest site scan as a finding: crawlers blocked, or an empty page without JavaScript."""
    s = df.where((F.col("name") == SCAN) & (F.col("timestamp") <= lit_ts(asof)))
    b = lambda k: F.coalesce(v.text(s, k) == "true", F.lit(False))
    newest = s.agg(F.max(F.struct("timestamp", "id", b("robots_blocks_ai").alias("blocked"), v.text(s, "renders_without_js").alias("renders"),
                                  F.coalesce(v.num_strict(s, "words_without_js"), F.lit(0.0)).alias("words"))).alias("s"))
    kind = F.when(F.col("s.blocked"), "robots").when(F.col("s.renders") == "false", "render")
    return newest.where("s is not null").select(kind.alias("metric"), F.lit("warn").alias("severity"),
                                                F.when(kind == "render", F.col("s.words")).otherwise(F.lit(0)).cast("bigint").alias("words")).where("metric is not null")
