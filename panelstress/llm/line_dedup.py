"""Removal of repeated runs of lines, from a suffix array over line ids built by distributed prefix doubling.

A document is the sequence of its lines that hold a word (blank lines take no part and stay). A run is deleted where
it holds at least ``min_words`` words and also occurs earlier, in the order of document id and line number; an
earlier occurrence may overlap it, so that a line repeated in place leaves one copy.

The suffix ranks come from prefix doubling: suffixes that agree on 2^k lines share a rank, and two ranks 2^k lines
apart give the rank on 2^(k+1) lines. The rank is the class's first position. Suffixes whose class has one
member drop out, and as every line holds a word, no more than log2(min_words) rounds can matter.
A longest-common-prefix interval of l lines, with 2^k <= l < 2^(k+1), is a pair of ranks: those on 2^k lines at its
head and at its tail. Every maximal repeated run is the union of the intervals inside it that are the shortest
with enough words from their first line, or up to their last line; so testing these two per line, instead of all
lengths, finds exactly the lines of maximal repeated runs.

Defined results: a null text stays null and an empty one empty; rows with the same id and the same text are
one document and lose the same lines; null ids sort last; an empty table gives an empty one; all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstress.llm.common import WORD, free_name
from panelstress.session import materialize

MIN_WORDS = 50
#: A class with more than this part of all rows is hot; there are fewer such classes than this number.
HOT_SHARE = 1000
#: Parts that the rows of a hot class are spread over.
SALTS = 64

_DOC = ["d", "t"]
_AT = ["d", "t", "i"]


def _document_key(id_col: str, text_col: str) -> list[Column]:
    """Id (null ids last, as a pair) and a fingerprint of the text, which tells apart rows that share an id."""
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"))
    return [key.alias("d"), F.xxhash64(text_col, F.lit(11)).alias("t")]


def _is_text_line(line: Column) -> Column:
    return line.rlike(WORD)


def _sequences(documents: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """One row per line with a word: key, number i, number n among all lines, 128-bit id, two interval lengths.

    ``ahead`` is the number of lines of the shortest run from line i on that has enough words, ``back`` of the
    shortest one that ends with line i; null when the document ends first.
    """
    lines = documents.where(F.col(text_col).isNotNull()).select(
        *_document_key(id_col, text_col),
        F.filter(
            F.transform(F.split(text_col, "\n", -1), lambda x, n: F.struct(n.alias("n"), x.alias("line"))),
            lambda x: _is_text_line(x.line),
        ).alias("lines"),
    )
    counts = F.transform("lines", lambda x: F.regexp_count(x.line, F.lit(WORD)))
    counted = lines.where(F.size("lines") > 0).withColumn("w", counts)
    n = F.size("w")

    def shortest(window: Column) -> Column:
        """Number of leading entries of the window that first sum to min_words; null if they never do."""
        state = F.aggregate(
            window, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
            lambda acc, x: F.when(acc.sum >= min_words, acc).otherwise(
                F.struct((acc.sum + x).alias("sum"), (acc.n + 1).alias("n"))
            ),
        )
        return F.when(state["sum"] >= min_words, state["n"])

    ahead = F.transform(F.sequence(F.lit(1), n), lambda i: shortest(F.slice("w", i, F.lit(min_words))))
    behind = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: shortest(F.reverse(F.slice("w", F.greatest(i - min_words + 1, F.lit(1)), F.least(i, F.lit(min_words))))),
    )
    ids = F.transform("lines", lambda x: F.struct(F.xxhash64(x.line).alias("h1"), F.xxhash64(F.lit(7), x.line).alias("h2")))
    parts = F.arrays_zip(F.transform("lines", lambda x: x.n).alias("n"), ids.alias("h"), ahead.alias("a"), behind.alias("b"))
    return counted.select(*_DOC, F.posexplode(parts).alias("i", "x")).select(
        *_AT, F.col("x.n").alias("n"), F.col("x.h").alias("h"), F.col("x.a").alias("ahead"), F.col("x.b").alias("back")
    )


def _position() -> Column:
    return F.struct(*_AT)


def _with_rank(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of classes with two members or more, with the first position of their class as ``rank``.

    Sizes come with the aggregation, which is combined before the shuffle. A class that holds more than a thousandth of
    these rows is hot: fewer than a thousand can be, so their keys are sent to all tasks, and such a class is
    met in ``SALTS`` parts.
    """
    classes = materialize(
        rows.groupBy(*keys)
        .agg(F.min(_position()).alias("rank"), F.max(_position()).alias("last"), F.count(F.lit(1)).alias("size"))
        .where(F.col("rank") != F.col("last")).drop("last"),
        name,
    )
    total = classes.agg(F.sum("size")).first()[0] or 0
    is_hot = F.col("size") * HOT_SHARE > total
    hot = classes.where(is_hot).select(*keys, F.lit(SALTS).alias("parts"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    salted = marked.withColumn("salt", F.pmod(F.xxhash64(*_AT), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    parts = F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))
    copies = classes.select(*keys, "rank", F.explode(parts).alias("salt"))
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def _ranks(lines: DataFrame, max_level: int) -> DataFrame:
    """Positions of repeated lines with ``ranks``: at index k the rank on 2^k lines, null from the first unique one on."""
    first = materialize(_with_rank(lines, ["h"], "lines-alike").select(*_AT, "n", "ahead", "back", "rank"), "rank-0").dropDuplicates(_AT)
    out = first.withColumn("ranks", F.array("rank")).drop("rank")
    level = first.select(*_AT, "rank")
    for k in range(max_level):
        after = Window.partitionBy(*_DOC).orderBy("i").rangeBetween(1 << k, 1 << k)
        pairs = level.withColumn("next", F.first("rank").over(after)).where(F.col("next").isNotNull())
        pairs = pairs.withColumnRenamed("rank", "head")
        level = materialize(_with_rank(pairs, ["head", "next"], "pairs-alike").select(*_AT, "rank"), f"rank-{k + 1}")
        if level.isEmpty():
            break
        out = out.join(level.withColumnRenamed("rank", "r"), _AT, "left")
        out = out.withColumn("ranks", F.when(F.col("r").isNull(), F.col("ranks")).otherwise(F.concat("ranks", F.array("r")))).drop("r")
    return out


def deleted_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """d, t (document key) and ``gone``: sorted numbers, from 0, of the lines to delete."""
    lines = materialize(_sequences(documents, id_col, text_col, min_words), "lines")
    ranks = materialize(_ranks(lines, max(min_words, 1).bit_length() - 1), "ranks")
    length = F.col("length")
    windows = (
        ranks.select(*_DOC, F.col("i").alias("s"), F.col("ahead").alias("length"))
        .unionByName(ranks.select(*_DOC, (F.col("i") - F.col("back") + 1).alias("s"), F.col("back").alias("length")))
        .where(length.isNotNull())
        .withColumn("k", F.floor(F.log2(length)).cast("int"))
    )
    at = ranks.select(*_DOC, "i", "ranks")
    head = at.select(*_DOC, F.col("i").alias("s"), F.col("ranks").alias("head_ranks"))
    tail = at.withColumnRenamed("ranks", "tail_ranks")
    found = (
        windows.join(head, [*_DOC, "s"])
        .where(F.size("head_ranks") > F.col("k"))
        .withColumn("i", F.col("s") + length - F.pow(F.lit(2), F.col("k")).cast("int"))
        .join(tail, _AT)
        .where(F.size("tail_ranks") > F.col("k"))
        .select(*_DOC, F.col("s").alias("i"), "length", F.col("head_ranks")[F.col("k")].alias("head"), F.col("tail_ranks")[F.col("k")].alias("tail"))
    )
    found = materialize(found, "intervals")
    keys = ["length", "head", "tail"]
    later = _with_rank(found, keys, "runs-alike").where(F.col("rank") != _position())
    covered = later.select(*_DOC, F.explode(F.sequence(F.col("i"), F.col("i") + length - 1)).alias("i")).distinct()
    return ranks.select(*_AT, "n").join(covered, _AT).groupBy(*_DOC).agg(F.array_sort(F.collect_list("n")).alias("gone"))


def dedup_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    removed_col: str | None = None,
) -> DataFrame:
    """The documents without later copies of repeated runs; ``removed_col`` adds the number of deleted lines."""
    gone, key, mark = (free_name(documents, n) for n in ("_gone", "_key", "_mark"))
    drop = materialize(deleted_lines(documents, id_col, text_col, min_words), "deleted")
    d, t = _document_key(id_col, text_col)
    keyed = documents.withColumn(key, d).withColumn(mark, t)
    drop = drop.select(F.col("d").alias(key), F.col("t").alias(mark), F.col("gone").alias(gone))
    # The deletions grow with the corpus, so they are never broadcast; hashing them spares a sort of the texts.
    joined = keyed.join(drop.hint("shuffle_hash"), [key, mark], "left")
    # A set difference over line numbers, so that the work is linear in a document; the split text is a variable of
    # the outer function and made once.
    kept = F.transform(
        F.array(F.split(text_col, "\n", -1)),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda n: F.get(lines, n)), "\n"
        ),
    )
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept[0]))
    if removed_col:
        out = out.withColumn(removed_col, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        return out.select(*documents.columns, removed_col)
    return out.select(*documents.columns)


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), p AS (
  SELECT b.doc_id, b.i, b.w, a.doc_id AS other, b.i - a.i AS shift,
    b.i - row_number() OVER (PARTITION BY b.doc_id, a.doc_id, b.i - a.i ORDER BY b.i) AS island
  FROM l a JOIN l b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(min(i), max(i) + 1)) AS i FROM p
  GROUP BY doc_id, other, shift, island HAVING sum(w) >= 50
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text, count(g) AS removed FROM (
    SELECT s.doc_id, s.n, CASE WHEN g.i IS NULL THEN s.line END AS line, g.i AS g
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) s
    LEFT JOIN l ON l.doc_id = s.doc_id AND l.n = s.n
    LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
  ) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
