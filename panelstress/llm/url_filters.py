"""Exact block lists for urls as cascades of Bloom filters, behind longest-prefix rules.

A block list is a table of domains; a domain stands for itself and all its subdomains, so a host is looked up by its
suffixes, once per distinct host. The hosts of the corpus that this lists are then encoded: level 0 holds the listed
hosts, level 1 the other hosts that level 0 reports by mistake, level 2 the listed hosts that level 1 reports, and so
on until a level reports nothing by mistake. Because the hosts of the corpus are known completely, a host is listed
exactly when the first level that does not contain it is an odd one.

Hosts are dealt to shards by a hash, and every shard has a cascade of its own, so its bits stay small for a list of any
size. A page meets one row of bits, that of its shard. Spark sends these rows to all tasks as long as they are few and
otherwise moves pages to their shard; salts spread a hot host or shard either way.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict allow;
repeated rows are judged each; an empty table or an empty list gives a cascade without bits that contains nothing;
a host is no longer than the 127 labels of the domain name system, so of longer ones the last 127 labels are suffixes;
null html counts as no words; extra columns of the pages are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.llm.common import WORD
from panelstress.session import materialize

#: Bits per key and hashes per key of one level.
BITS_PER_KEY = 12
HASHES = 5
#: Keys that the first two levels of a shard hold, about (100 KB of bits).
SHARD_KEYS = 1 << 16
#: Share of keys that a level reports by mistake, rounded up; sizes the shards.
MISTAKES = 0.01
#: Parts that a shard's pages are spread over.
SALTS = 8

#: Rules of the registered query: verdict, host, path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A domain is listed when its first label holds one of these words between hyphens.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "malware", "phish", "pills", "spam")
#: A domain is listed when it has so many pages and half of them or more are thin.
MIN_PAGES = 10
#: A page with fewer words outside its tags is thin.
THIN_WORDS = 50
#: A single label is a registry, not a domain.
MIN_LABELS = 2
MAX_LABELS = 127


@dataclass(frozen=True)
class Cascade:
    """``frame`` has a row per shard with a level: ``shard`` and ``levels``, an array of arrays of 64-bit words."""

    frame: DataFrame
    shards: int
    #: Keys encoded per level.
    sizes: tuple[int, ...]


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("int")


def _spots(key: Column, level: Column, bits: Column) -> list[Column]:
    """Bit positions of a key in a level."""
    first = F.xxhash64(key, level * 2)
    second = F.xxhash64(level * 2 + 1, key).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftright(first, 7) + F.shiftright(second, 9) * i, bits).cast("int") for i in range(HASHES)]


def _in_level(key: Column, level: Column, words: Column) -> Column:
    hit = F.lit(True)
    for p in _spots(key, level, F.size(words) * 64):
        word = F.element_at(words, F.shiftright(p, 6) + 1)
        hit = hit & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1)
    return hit


def _routed(rows: DataFrame, table: DataFrame, on: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Join with a table that has one row per ``on``; a hot value is spread over ``SALTS`` parts by ``spread``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread, F.lit(-2)), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def _build(inside: DataFrame, number: int) -> DataFrame:
    """One level: ``shard`` and ``words``, with bits by the number of keys in the shard."""
    sizes = inside.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 64).cast("int").alias("n"))
    spots = _spots(F.col("key"), F.lit(number), F.col("n") * 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)))
    keyed = _routed(inside, sizes, "shard", ["key"]).select("shard", F.explode(F.array(*spots)).alias("p"))
    found = keyed.select("shard", F.shiftright("p", 6).alias("w"), bit.alias("b"))
    blank = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"), F.lit(0).cast("long").alias("b"))
    whole = found.unionByName(blank).groupBy("shard", "w").agg(F.bit_or("b").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("w", "b")))
    return whole.groupBy("shard").agg(F.transform(ordered, lambda x: x.b).alias("words"))


def build_cascade(universe: DataFrame, listed: Column, shard_keys: int = SHARD_KEYS) -> Cascade:
    """Cascades over the keys of ``universe`` (column ``key``, distinct), of which ``listed`` tells the listed ones.

    Each level is built from a written table of the keys that are still undecided; these shrink by the rate of
    false positives per level, below one in a hundred.
    """
    keys = materialize(universe.where(F.col("key").isNotNull()).select("key", listed.alias("listed")), "keys")
    total, wanted = keys.agg(F.count(F.lit(1)), F.count_if("listed")).first()
    shards = max(1, -(-int(wanted + MISTAKES * (total - wanted)) // shard_keys))
    sharded = keys.withColumn("shard", _shard(F.col("key"), shards))
    inside, outside = sharded.where("listed").drop("listed"), sharded.where(~F.col("listed")).drop("listed")
    frame = materialize(sharded.limit(0).select("shard", F.lit(0).alias("level"), F.array(F.lit(0).cast("long")).alias("words")), "bloom")
    sizes: list[int] = []
    count = wanted
    while count > 0:
        number = len(sizes)
        level = materialize(_build(inside, number), f"bloom-{number}")
        frame = frame.unionByName(level.select("shard", F.lit(number).alias("level"), "words"))
        sizes.append(count)
        wrong = _routed(outside, level, "shard", ["key"]).where(_in_level(F.col("key"), F.lit(number), F.col("words")))
        wrong = materialize(wrong.select("key", "shard"), "undecided")
        inside, outside, count = wrong, inside, wrong.count()
    ordered = F.array_sort(F.collect_list(F.struct("level", "words")))
    frame = materialize(frame.groupBy("shard").agg(F.transform(ordered, lambda x: x.words).alias("levels")), "cascade")
    return Cascade(frame, shards, tuple(sizes))


def with_membership(rows: DataFrame, key: str, cascade: Cascade, spread: list[str], name: str = "listed") -> DataFrame:
    """The rows and whether the key, one of the universe, is listed; false for null."""
    keyed = rows.withColumn("shard", _shard(F.col(key), cascade.shards))
    met = _routed(keyed, cascade.frame, "shard", spread, "left")
    inside = F.transform("levels", lambda words, n: _in_level(F.col(key), n, words))
    first_out = F.array_position(inside, F.lit(False))  # from 1; 0 when every level holds the key
    odd = F.when(first_out == 0, F.size("levels")).otherwise(first_out - 1) % 2 == 1
    return met.withColumn(name, F.coalesce(odd & F.col(key).isNotNull(), F.lit(False))).drop("shard", "levels")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the rule that fits and is longest, host and path together; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    first = F.greatest(F.lit(1), n - MAX_LABELS + 1)
    each = F.transform(F.sequence(first, n - MIN_LABELS + 1), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(n >= MIN_LABELS, each).otherwise(F.array().cast("array<string>"))


def n_visible_words(html: Column) -> Column:
    """Words outside tags, scripts and styles."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(?:script|style)\b.*?</(?:script|style)>", " ")
    return F.regexp_count(F.regexp_replace(bare, "<[^>]*>", " "), F.lit(WORD))


def listed_domains(pages: DataFrame, words=LISTED_WORDS, min_pages: int = MIN_PAGES, thin_words: int = THIN_WORDS) -> DataFrame:
    """``domain``: the block list that the pages themselves give.

    A domain is listed for the words in its first label, or when at least half of the pages on it and its subdomains
    are thin. Pages are counted per host before the hosts are counted per domain, so that a hot host is one row.
    """
    host, _ = split_url(F.col("url"))
    thin = F.count_if(n_visible_words(F.col("html")) < thin_words)
    hosts = pages.select(host.alias("host"), "html").groupBy("host").agg(F.count(F.lit(1)).alias("n"), thin.alias("thin"))
    domains = hosts.select(F.explode(suffixes(F.col("host"))).alias("domain"), "n", "thin").groupBy("domain").agg(
        F.sum("n").alias("n"), F.sum("thin").alias("thin")
    )
    named = F.arrays_overlap(F.split(F.substring_index("domain", ".", 1), "-"), F.array(*[F.lit(w) for w in words]))
    return domains.where(named | ((F.col("n") >= min_pages) & (2 * F.col("thin") >= F.col("n")))).select("domain")


def hosts_with_marks(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """``key`` and ``listed`` of every distinct host: true when the host or a domain above it stands in the list."""
    above = hosts.select("key", F.explode(suffixes(F.col("key"))).alias("domain"))
    hits = _routed(above, domains.select("domain").distinct(), "domain", ["key"]).select("key", F.lit(True).alias("listed"))
    return hosts.select("key", F.lit(False).alias("listed")).unionByName(hits).groupBy("key").agg(F.bool_or("listed").alias("listed"))


def judge(pages: DataFrame, domains: DataFrame, rules=RULES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule decides, else whether the list ``domains`` holds the host.

    The keys are the distinct hosts of the pages, so that a hot host is one key.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.groupBy(F.col("host").alias("key")).agg(F.lit(1).alias("_one")).drop("_one")
    cascade = build_cascade(hosts_with_marks(hosts, domains), F.col("listed"), shard_keys)
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return with_membership(rows, "host", cascade, ["page_id", "path"], "_bad").select(
        "page_id", "host", "path", text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE len(regexp_extract_all(regexp_replace(regexp_replace(coalesce(html, ''),
    '(?s)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+')) < 50) AS thin
  FROM h GROUP BY host
), above AS (
  SELECT host, n, thin, array_to_string(list_slice(labels, i, len(labels)), '.') AS domain
  FROM (SELECT *, unnest(range(greatest(1, len(labels) - 126), len(labels))) AS i FROM (SELECT *, string_split(host, '.') AS labels FROM hosts))
), listed AS (
  SELECT domain FROM above GROUP BY domain
  HAVING list_has_any(string_split(split_part(domain, '.', 1), '-'), ['ads', 'adult', 'bets', 'casino', 'malware', 'phish', 'pills', 'spam'])
    OR (sum(n) >= 10 AND 2 * sum(thin) >= sum(n))
), bad AS (
  SELECT DISTINCT host FROM above WHERE domain IN (SELECT domain FROM listed)
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM h
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
