"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is a regular expression over ``host + path`` plus the literal tokens that every URL it fits must
have. The index has one entry per rule, under the token of the rule that the fewest URLs have; rules
without a token are filed under the empty token, which every URL has. The tokens of a URL fetch the
candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import UPPER, LOWER, ascii_lower, small, stored

TOKEN = "[a-z0-9]+"
RULES_SCHEMA = "rule string, pattern string, literals array<string>, verdict string, kind string, length int"
BROADCAST_RULES = 20_000

#: The rules of the contract: host, path, verdict.
SITE_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# Words that tell by a host's name what its pages are.
HOST_WORDS = (
    "spam casino casinos poker slots roulette blackjack betting bookmaker sportsbook jackpot lottery gambling adult porn porno xxx sex escort escorts camgirls hentai nude nudes milf fetish "
    "viagra cialis levitra xanax tramadol pharmacy rx steroids payday loans forex binaryoptions cryptogiveaway airdrop replica replicas counterfeit warez crack cracks keygen keygens serials torrent torrents "
    "malware phishing ransomware botnet exploit carding doxbin adserver adservers doubleclick tracker trackers analytics clickbank popunder popads linkfarm seo backlinks essaywriting essaymill followers likes"
).split()
# Parts of a path that lead to what isn't text: sessions, shops' carts, and the insides of sites.
PATH_PARTS = (
    "login signin signup register logout password reset cart checkout basket wishlist account admin administrator phpmyadmin cpanel webmail xmlrpc cgi-bin wp-admin wp-login wp-json wp-content wp-includes "
    "trackback pingback print share tellafriend unsubscribe captcha oauth callback session calendar search tag tags attachment download cron server-status"
).split()
# Two words that are junk together.
HOST_PAIRS = [("cheap", "pills"), ("free", "spins"), ("online", "casino"), ("buy", "followers"), ("weight", "loss"), ("diet", "pills"), ("work", "fromhome"), ("adult", "dating"), ("fast", "cash"), ("live", "cams")]


def pattern_rules(host_words=HOST_WORDS, host_pairs=HOST_PAIRS, path_parts=PATH_PARTS) -> list[tuple[str, list[str]]]:
    """Patterns over host + path that block a page no site rule fits, with the tokens that each one requires."""
    rules = [(rf"^[^/]*\b{w}\b", [w]) for w in host_words]
    rules += [(rf"^[^/]*\b{a}-{b}\b", [a, b]) for a, b in host_pairs]
    return rules + [(rf"/{re.escape(p)}(/|\.|$)", re.findall(TOKEN, p)) for p in path_parts]


PATTERN_RULES = pattern_rules()


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z in lower case; else empty."""
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", 1)
    after = F.substr(F.coalesce(url, F.lit("")), F.length(rest) + 4)
    return ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", 1)
    after = F.substr(F.coalesce(url, F.lit("")), F.length(rest) + 4)
    return F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def site_rule(site: str, prefix: str, verdict: str) -> tuple:
    """A rule for a host with its subdomains and a path prefix. The last token of an open prefix may go on in the URL, so it isn't literal."""
    closed = prefix[: prefix.rfind("/") + 1]
    literals = re.findall(TOKEN, f"{site}{closed}".translate(str.maketrans(UPPER, LOWER)))
    return (f"{site}{prefix}", rf"^(?:[^/]*\.)?{re.escape(site)}{re.escape(prefix)}", literals, verdict, "site", len(site) + len(prefix))


def rules(spark: SparkSession, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    rows = [site_rule(*r) for r in site_rules] + [(None, pattern, words, "block", "pattern", len(pattern)) for pattern, words in pattern_rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def with_tokens(pages: DataFrame) -> DataFrame:
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    return parts.withColumn("tokens", F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0))))


def index(rule_table: DataFrame, pages: DataFrame) -> DataFrame:
    """The rules with a column ``token``: the literal that the fewest pages have (ties: the first by text), or empty."""
    literals = rule_table.select(F.explode("literals").alias("token")).distinct()
    counts = pages.select(F.explode("tokens").alias("token")).join(F.broadcast(literals) if literals.count() <= BROADCAST_RULES else literals, "token").groupBy("token").count()
    keyed = rule_table.withColumn("id", F.monotonically_increasing_id())
    ranked = keyed.select("id", F.explode("literals").alias("token")).join(counts, "token", "left")
    rarest = ranked.groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
    return stored(keyed.join(rarest, "id", "left").withColumn("token", F.coalesce("token", F.lit(""))).coalesce(1), "url-rules")


def fetched(parsed: DataFrame, indexed: DataFrame) -> DataFrame:
    """The rows of `with_tokens`, once for each rule that one of their tokens fetches (``r, p, v, kind, n``; null for none)."""
    candidates = small(indexed, BROADCAST_RULES).select("token", F.col("rule").alias("r"), F.col("pattern").alias("p"), F.col("verdict").alias("v"), "kind", F.col("length").alias("n"))
    return parsed.withColumn("token", F.explode(F.array_append("tokens", F.lit("")))).drop("tokens").join(candidates, "token", "left")


def judged(pages: DataFrame, rule_table: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of `pages`: ``page_id, host, path, rule, verdict, pattern``.

    The longest fitting site rule decides (``rule`` names it; ties go to the first by text); where none
    fits, a fitting pattern rule does (``pattern`` names it), else `default`. A URL that is null or has no
    ``://`` has an empty host and path, which no site rule fits. Repeated pages get equal rows; further
    columns are ignored.
    """
    parsed = with_tokens(pages)
    found = fetched(parsed, index(rule_table, parsed))
    fits = F.col("p").isNotNull() & F.expr("regexp_like(concat(host, path), p)")
    best = lambda kind: F.max(F.when(fits & (F.col("kind") == kind), F.struct("n", F.struct("r", "p", "v").alias("what")))).alias(kind)
    return found.groupBy("row", "page_id", "host", "path").agg(best("site"), best("pattern")).select(
        "page_id", "host", "path", F.col("site.what.r").alias("rule"),
        F.coalesce("site.what.v", "pattern.what.v", F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("pattern.what.p")).alias("pattern"),
    )


def oracle() -> str:
    def sql(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    made = [site_rule(*r) for r in SITE_RULES]
    site = ", ".join(f"({sql(r)}, {sql(p)}, {sql(v)}, {n})" for r, p, _, v, _, n in made)
    pattern = ", ".join(f"({sql(p)}, {len(p)})" for p, _ in PATTERN_RULES)
    return rf"""
WITH r(rule, p, v, n) AS (VALUES {site}), q(p, n) AS (VALUES {pattern}),
a AS (SELECT page_id, url, row_number() OVER () AS i, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
b AS (SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
s AS (SELECT i, max_by(rule, n) AS rule, max_by(v, n) AS v FROM b JOIN r ON regexp_matches(host || path, r.p) GROUP BY i),
m AS (SELECT i, max_by(q.p, q.n) AS pattern FROM b JOIN q ON regexp_matches(host || path, q.p) GROUP BY i)
SELECT page_id, host, path, s.rule, coalesce(s.v, CASE WHEN m.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN s.rule IS NULL THEN m.pattern END AS pattern
FROM b LEFT JOIN s USING (i) LEFT JOIN m USING (i)
"""
