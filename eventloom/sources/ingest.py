"""Raw batches to canonical events: checks, repairs, enrichment, dedupe."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from eventloom.functions.values import compute_once
from eventloom.model import FIXED, lit_ts

# fixed values: size limits, and the earliest believable timestamp
MAX_PROPS, MAX_PROP_BYTES, MAX_EVENT_BYTES, MIN_TIME = 250, 8 << 10, 32 << 10, "2000-01-01 00:00:00"
REASONS = ("invalid JSON", "missing event name", "too many properties", "property too large", "event too large", "missing distinct_id")
# fixed values: user-agent fragments of automated agents
BOT_PATTERNS = (
    "googlebot", "bingbot", "yandexbot", "baiduspider", "duckduckbot", "applebot", "gptbot", "claudebot", "claude-web", "perplexitybot", "google-extended",
    "ccbot", "bytespider", "amazonbot", "meta-externalagent", "oai-searchbot", "ahrefsbot", "semrushbot", "mj12bot", "dotbot", "petalbot", "screaming frog",
    "uptimerobot", "pingdom", "statuscake", "site24x7", "betteruptime", "facebookexternalhit", "twitterbot", "linkedinbot", "slackbot", "discordbot",
    "telegrambot", "whatsapp", "skypeuripreview", "headlesschrome", "lighthouse", "phantomjs", "selenium", "playwright", "puppeteer", "crawler", "spider",
    "scraper", "bot/", "bot;")


def parse_time(s: Column) -> Column:
    """ISO or SQL text, or unix seconds / milliseconds (from 1e12 on); NULL when unreadable."""
    n = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
    return F.when(n.isNotNull(), F.timestamp_millis(F.when(n >= 10 ** 12, n).otherwise(n * 1000))).otherwise(
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?([zZ]|[+-]\d{2}(:?\d{2})?)?)?$"), F.try_to_timestamp(s)))


def repair_time(ts: Column, now: Column) -> Column:
    """Missing, future and pre-2000 timestamps become ``now``."""
    return F.when(ts.isNull() | (ts > now) | (ts < lit_ts(MIN_TIME)), now).otherwise(ts)


def normalize(lines: DataFrame, now: str) -> DataFrame:
    """lines(value, …) of JSON events → id, name, distinct_id, timestamp, properties, reason.

    ``reason`` is NULL for accepted rows; the others are the dead letters.  A missing id is derived
    from the row's content, so a retried task or a re-sent batch produces the same id.
    """
    keep = [c for c in lines.columns if c != "value"]
    txt = lambda k: F.coalesce(F.try_variant_get("_v", f"$.{k}", "string"), F.lit(""))
    d = compute_once(lines, _v=F.try_parse_json("value"))
    props = F.try_variant_get("_v", "$.properties", "variant")
    sizes = F.transform(F.map_values(F.try_variant_get("_v", "$.properties", "map<string,variant>")), lambda x: F.octet_length(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))
    d = d.select(*keep, "value", "_v", txt("id").alias("id"), txt("name").alias("name"), txt("distinct_id").alias("distinct_id"),
                 F.try_variant_get("_v", "$.timestamp", "string").alias("_ts"), props.alias("properties"), F.coalesce(sizes, F.array().cast("array<int>")).alias("_sizes"))
    reason = (F.when(F.col("_v").isNull(), "invalid JSON").when(F.col("name") == "", "missing event name").when(F.size("_sizes") > MAX_PROPS, "too many properties")
              .when(F.exists("_sizes", lambda n: n > MAX_PROP_BYTES), "property too large").when(F.octet_length("value") > MAX_EVENT_BYTES, "event too large")
              .when(F.col("distinct_id") == "", "missing distinct_id"))
    made = F.substring(F.sha2("value", 256), 1, 32)
    return d.select(*keep, F.when(F.col("id") == "", made).otherwise(F.col("id")).alias("id"), "name", "distinct_id",
                    repair_time(parse_time(F.col("_ts")), lit_ts(now)).alias("timestamp"), "properties", reason.alias("reason"), "value")


def accepted(d: DataFrame) -> DataFrame:
    return d.where("reason is null").drop("reason", "value")


def rejected(d: DataFrame) -> DataFrame:
    return d.where("reason is not null").select("reason", "value")


def dedup(df: DataFrame, order: str, existing: DataFrame | None = None) -> DataFrame:
    """First row per id wins; ids already stored are dropped.

    An aggregate, not a window: copies of one id collapse before the shuffle.
    """
    cols = [c for c in df.columns if c not in ("id",)]
    first = df.groupBy("id").agg(F.min_by(F.struct(*cols), F.col(order)).alias("r")).select("id", "r.*").select(*df.columns)
    return first if existing is None else first.join(existing.select("id").distinct(), "id", "left_anti")


# ---- enrichment --------------------------------------------------------------------------------
def _first_hit(ua: Column, rules) -> Column:
    out = None
    for test, name in rules:
        out = (F.when if out is None else out.when)(test, F.lit(name))
    return out.otherwise(F.lit(""))


def user_agent(ua: Column) -> tuple[Column, Column]:
    """(browser, os): ordered substring rules; '' for anything unrecognised."""
    has = lambda s: F.contains(ua, F.lit(s))
    # fixed values: rule order matters, several tokens are shared
    os = _first_hit(ua, [(has("Windows"), "Windows"), (has("Mac OS X") | has("Macintosh"), "macOS"), (has("CrOS"), "ChromeOS"), (has("Android"), "Android"),
                         (has("iPhone") | has("iPad") | has("iOS"), "iOS"), (has("Linux"), "Linux")])
    browser = _first_hit(ua, [(has("Edg/"), "Edge"), (has("OPR/") | has("Opera"), "Opera"), (has("Firefox/"), "Firefox"), (has("Chrome/"), "Chrome"), (has("Version/") & has("Safari/"), "Safari")])
    return browser, os


def enrich_user_agent(df: DataFrame, ua: str = "user_agent") -> DataFrame:
    """Fill browser and os from the user agent where the event does not carry them."""
    b, o = user_agent(F.coalesce(F.col(ua), F.lit("")))
    for name, val in (("browser", b), ("os", o)):
        have = F.col(name) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.coalesce(have, F.when(val != "", val)))
    return df


def is_bot(ua: Column) -> Column:
    u = F.coalesce(ua, F.lit(""))
    return (u == "") | F.lower(u).rlike("|".join(p.replace("/", "\\/") for p in BOT_PATTERNS))


def filter_bots(df: DataFrame, ua: str = "user_agent") -> DataFrame:
    """Drop autocaptured rows of automated agents; explicit events and crawl reports stay."""
    auto = F.startswith("name", F.lit("$")) & (F.col("name") != "$ai_crawl")
    return df.where(~(auto & is_bot(F.col(ua))))


def observed(d: DataFrame, name: str = "ingest", ua: str | None = None) -> tuple[DataFrame, Observation]:
    """(rows to store, counts): ``d`` comes from ``normalize``; what is left out is counted on the pass that writes the rest.

    The counts fill with the first action on the rows: ``rows``, ``stored``, ``bots`` and ``rejected_<reason>``, with a bot
    counted where its row is sound. ``ua`` names the column of user agents; without one no bot is looked for.
    A retried task counts its rows once.
    """
    seen = Observation(name)
    sound = F.col("reason").isNull()
    auto = F.startswith("name", F.lit("$")) & (F.col("name") != "$ai_crawl")
    bot = sound & auto & is_bot(F.col(ua)) if ua else F.lit(False)
    n = lambda c, to: F.count(F.when(c, 1)).alias(to)
    reasons = [n(F.col("reason") == r, "rejected_" + r.replace(" ", "_").lower()) for r in REASONS]
    watched = d.observe(seen, F.count(F.lit(1)).alias("rows"), n(sound & ~bot, "stored"), n(bot, "bots"), *reasons)
    return watched.where(sound & ~bot).drop("reason", "value"), seen


def bot_counts(df: DataFrame, ua: str = "user_agent") -> DataFrame:
    auto = F.startswith("name", F.lit("$")) & (F.col("name") != "$ai_crawl")
    bad = auto & is_bot(F.col(ua))
    return df.groupBy("name").agg(F.count(F.when(~bad, 1)).alias("kept"), F.count(F.when(bad, 1)).alias("dropped"))


def anonymous_id(secret: str, ip: Column, ua: Column, ts: Column) -> Column:
    """Cookieless visitor id: HMAC-SHA256(secret, day|ip|ua), first 16 hex digits, rotating daily."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    msg = F.encode(F.concat_ws("|", F.floor(F.unix_seconds(ts) / 86400).cast("string"), ip, ua), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(pad(0x36), msg), 256))
    return F.concat(F.lit("anon-"), F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 16))


def resolve_anonymous(df: DataFrame, secret: str, ip: str = "ip", ua: str = "user_agent") -> DataFrame:
    made = anonymous_id(secret, F.coalesce(F.col(ip), F.lit("")), F.coalesce(F.col(ua), F.lit("")), F.col("timestamp"))
    return df.withColumn("distinct_id", F.when(F.col("distinct_id") == "$anon", made).otherwise(F.col("distinct_id")))


# ---- country -----------------------------------------------------------------------------------
def ip_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    n = reduce(lambda a, i: a * 256 + p[i].cast("bigint"), range(1, 4), p[0].cast("bigint"))
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), n)


def enrich_country(df: DataFrame, ranges: DataFrame, ip_num: Column) -> DataFrame:
    """ranges(start, end, cc), disjoint → ``country`` where missing.

    Both sides are keyed by the upper 16 bits, so the range join is an equi-join with a check; a
    range is listed once per prefix it touches.
    """
    r = ranges.select("start", "end", "cc", F.explode(F.sequence(F.shiftright("start", 16), F.shiftright("end", 16))).alias("_p"))
    d = df.withColumn("_ip", ip_num).withColumn("_q", F.shiftright("_ip", 16))
    j = d.join(r, (F.col("_q") == F.col("_p")) & (F.col("_ip") >= F.col("start")) & (F.col("_ip") <= F.col("end")), "left")
    have = F.col("country") if "country" in df.columns else F.lit(None).cast("string")
    return j.withColumn("country", F.coalesce(have, "cc")).drop("_p", "_q", "_ip", "start", "end", "cc")


def canonical(df: DataFrame) -> DataFrame:
    return df.select(*FIXED, *[c for c in df.columns if c not in FIXED])
