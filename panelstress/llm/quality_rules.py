"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
policies are masks over those bits, so that a new version of a policy or an ablation never reads the texts again.

Defined results: a null text measures like an empty one (no words, lines or symbols) and fails the rule on the
number of words; a very long text is measured whole, in time close to its length; a null id stays null; repeated rows get one ledger row each; an empty table gives an empty ledger;
columns of the input other than id and text are not carried, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.llm.common import WORD

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"

#: Bit, name and failing condition of each rule, over the measurements. Integers only, so any engine agrees.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: a document fails when it fails one of the rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << bit for bit, name, _ in RULES if name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES: tuple[Policy, ...] = (
    BASE,
    Policy("v1", ("few_words", "repeated_words", "symbols")),
    Policy("v2", tuple(name for _, name, _ in RULES)),
)


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """Words in three-word windows that occur twice or more; takes the column _grams, adds n_repeat_words.

    Window hashes have 64 bits. Sorted with their places, equal windows are neighbours; the places of windows with an equal
    neighbour are sorted again, and each covers three words less what the next one covers too. Every step is one pass over
    an array, so the cost is that of two sorts however often windows repeat. Documents without a repeated window, which
    array_distinct tells in one pass, skip the sorts.
    """
    placed = F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    rows = rows.withColumn("_ordered", F.when(repeats, F.sort_array(placed)).otherwise(none)).drop("_grams")
    pairs = F.greatest(F.size("_ordered") - 1, F.lit(0))
    equal = F.zip_with(F.slice("_ordered", 1, pairs), F.slice("_ordered", 2, pairs), lambda a, b: a.h == b.h)
    rows = rows.withColumn("_equal", equal)
    marked = F.zip_with(F.concat(F.array(F.lit(False)), "_equal"), F.concat("_equal", F.array(F.lit(False))), lambda a, b: a | b)
    places = F.filter(F.zip_with("_ordered", marked, lambda x, m: F.when(m, x.i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_places", F.sort_array(places)).drop("_ordered", "_equal")
    gaps = F.greatest(F.size("_places") - 1, F.lit(0))
    added = F.zip_with(F.slice("_places", 1, gaps), F.slice("_places", 2, gaps), lambda a, b: F.least(b - a, F.lit(3)))
    total = F.aggregate(added, F.lit(0), lambda acc, x: acc + x) + F.when(F.size("_places") > 0, 3).otherwise(0)
    return rows.withColumn("n_repeat_words", total.cast("long")).drop("_places")


def ledger(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure bits of every document: id, measurements, failed_rules (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    grams = F.transform(
        F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)),
    )
    measured = _with_repeat_words(rows.select(
        "doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_grams"),
    ))
    bits = F.lit(0).cast("long")
    for bit, _, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_rules", bits)


def fails(policy: Policy, bits: str = "failed_rules") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does, from the ledger alone.

    One row per rule: documents that fail it, that only it rejects, and that stay rejected without it. The
    ledger shrinks to one row per distinct bit pattern (2^rules at most) before anything else is computed.
    """
    patterns = rows.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    masks = [(name, 1 << bit, policy.mask & ~(1 << bit)) for bit, name, _ in RULES if policy.mask >> bit & 1]
    rule = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("b"), F.lit(m).cast("long").alias("m"))
        for n, b, m in masks
    ]))
    has = F.col("failed_rules").bitwiseAND(F.col("r.b")) != 0
    other = F.col("failed_rules").bitwiseAND(F.col("r.m")) != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return (
        patterns.select("failed_rules", "n", rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(total(has).alias("failed"), total(has & ~other).alias("only_this"), total(other).alias("without_it"))
        .withColumn("policy", F.lit(policy.version))
    )


def apply_policy(rows: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The ledger with base_failed, and kept under the given policy."""
    failed_base = fails(BASE)
    return rows.withColumn("base_failed", failed_base).withColumn("kept", ~failed_base & ~fails(policy))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), m AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM w
), g AS (
  SELECT rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM m)
), rep AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g
    SEMI JOIN (SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (rid, g)
  ) GROUP BY rid
), a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM m LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
    + 32 * (word_chars > 20 * n_words)::INT)::BIGINT AS failed_rules FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed,
  failed_rules = 0 AS kept, n_lines, failed_rules
FROM b
"""
