"""Audit of interacting filters: count-weighted decision diagrams of failure masks, reordered by level swaps.

Every document is reduced to the mask of the filters that it fails. Per part, the masks with their weights (documents,
good ones, toxic ones) make an ordered decision diagram: one level per filter, an edge for pass and one for fail, equal
sub-diagrams shared, and each node weighing what lies below it. Neighbouring levels are swapped in place, in an order of
single swaps that meets every permutation once. Under each order the path of passes from the root gives the steps:
at a node, what its fail edge weighs is removed by that filter and what its pass edge weighs is kept.

Only masks travel: a part has at most 2^filters of them, whatever its number of documents.

Copies ("identical to the text of any smaller id") need no join and no group of copies in one place. Rows are counted by
(text, part, mask, labels, id), then by (text, part, mask, labels) with the smallest id and how often it stands there;
both combine before the shuffle. What is left of a text, one row per part and labels, meets in a window.

Defined results: a null text is an empty one; a null part is the empty string; rows with a null id are copies of nothing
and nothing is a copy of them; repeated rows count as often as they stand, and rows that share the smallest id of a text are
no copies; of several labels of one id the largest counts, a missing or null label is none; very long texts are read whole,
by slices of documents; an empty table gives no rows; other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstress.llm.tokens import slices, utf8

# ---- the diagram -------------------------------------------------------------------------------

Weight = tuple[int, ...]


class Diagram:
    """Ordered decision diagram over the bits of a mask, with a weight vector at every node.

    No level is skipped, so that weights add up; equal sub-diagrams are one node. A node is a number; ``order`` names
    the bit that each level tests.
    """

    def __init__(self, weights: dict[int, Weight], bits: int, size: int):
        self.order = list(range(bits))
        self.weight: list[Weight] = []
        self.edges: list[tuple[int, int] | None] = []  # (pass, fail); none at the bottom
        self._leaves: dict[Weight, int] = {}
        self._unique: list[dict[tuple[int, int], int]] = [{} for _ in range(bits)]
        nothing = (0,) * size

        def build(level: int, mask: int) -> int:
            if level == bits:
                return self._leaf(weights.get(mask, nothing))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, weight: Weight, edges: tuple[int, int] | None) -> int:
        self.weight.append(weight)
        self.edges.append(edges)
        return len(self.weight) - 1

    def _leaf(self, weight: Weight) -> int:
        if weight not in self._leaves:
            self._leaves[weight] = self._new(weight, None)
        return self._leaves[weight]

    def _node(self, level: int, passed: int, failed: int) -> int:
        table, edges = self._unique[level], (passed, failed)
        if edges not in table:
            total = tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed]))
            table[edges] = self._new(total, edges)
        return table[edges]

    def swap(self, level: int) -> None:
        """Exchange the tests of a level and the next; nodes above and below keep their numbers."""
        upper = self._unique[level]
        self._unique[level], self._unique[level + 1] = {}, {}
        for (p, f), node in upper.items():
            (pp, pf), (fp, ff) = self.edges[p], self.edges[f]
            # The function below a node does not change, so neither its number nor its weight does.
            edges = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.edges[node] = edges
            self._unique[level][edges] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> list[tuple[int, Weight, Weight]]:
        """Per level: the bit tested, the weight that passes and the weight that fails, all earlier tests passed."""
        steps, node = [], self.root
        for bit in self.order:
            passed, failed = self.edges[node]
            steps.append((bit, self.weight[passed], self.weight[failed]))
            node = passed
        return steps


def single_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that every order of n is met once, the given one first."""
    place, left = list(range(n)), [True] * n  # who stands where, and which way each looks
    while True:
        best = -1
        for i, who in enumerate(place):
            j = i - 1 if left[who] else i + 1
            if 0 <= j < n and place[j] < who and (best < 0 or who > place[best]):
                best = i
        if best < 0:
            return
        who = place[best]
        j = best - 1 if left[who] else best + 1
        place[best], place[j] = place[j], place[best]
        left = [not way if k > who else way for k, way in enumerate(left)]
        yield min(best, j)


def every_order(diagram: Diagram) -> Iterator[list[tuple[int, Weight, Weight]]]:
    """The path of passes under each order of the filters, reached by one swap of neighbours at a time."""
    yield diagram.all_pass_path()
    for level in single_swaps(len(diagram.order)):
        diagram.swap(level)
        yield diagram.all_pass_path()


# ---- per part ----------------------------------------------------------------------------------

STEP_SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def steps_of_part(filters: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """All orders and steps of one part, from its (at most 2^filters) masks and their weights."""

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(filters)
        weights = {int(m): (int(d), int(g), int(t)) for m, d, g, t in zip(pdf["mask"], pdf["docs"], pdf["good"], pdf["toxic"])}
        fails = [sum(w[0] for m, w in weights.items() if m >> b & 1) for b in range(n)]
        only = [weights.get(1 << b, (0,))[0] for b in range(n)]
        paths = list(every_order(Diagram(weights, n, 3)))
        shapley = [0] * n
        for path in paths:
            for bit, _, removed in path:
                shapley[bit] += removed[0]
        rows = [
            (key[0], "".join(filters[b] for b, _, _ in path), i, passed[0], removed[0], fails[b] - removed[0], only[b], removed[1], removed[2], shapley[b])
            for path in paths
            for i, (b, passed, removed) in enumerate(path, 1)
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STEP_SCHEMA.split(", ")])

    return steps


def audit(masks: DataFrame, filters: str) -> DataFrame:
    """Every order and step per part. ``masks`` has part, mask (bit i: fails the i-th filter), docs, good, toxic.

    ``redundant`` fail the filter but went earlier, ``unique_fails`` fail it alone, ``shapley`` sums over all orders what it removes.
    """
    sums = [F.sum(c).alias(c) for c in ("docs", "good", "toxic")]
    small = masks.groupBy("part", "mask").agg(*sums)
    return small.groupBy("part").applyInPandas(steps_of_part(filters), STEP_SCHEMA)


# ---- the five filters --------------------------------------------------------------------------

#: Filters in the order of their bits. The limits of each.
FILTERS = "ABCDE"
FEW_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SIGNS = b"#$%&*|"
#: Column "deal" of rows with an id, and the parts to which rows without one are dealt.
_HAS_ID, _NULL_PARTS = -1, 1024
COPY_BIT = 1 << FILTERS.index("E")

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(SIGNS)] = True


def _count(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_masks(texts) -> np.ndarray:
    """Bits A to D of each text of an Arrow column."""
    raw, offsets = utf8(texts)
    out = np.zeros(len(offsets) - 1, dtype=np.int32)
    for lo, hi in slices(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        data = part.tobytes()
        points = _count((part & 0xC0) != 0x80, at)
        n, distinct = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=np.int64)
        for i in range(hi - lo):
            words = data[at[i] : at[i + 1]].split()  # bytes are split at ASCII white space only
            n[i], distinct[i] = len(words), len(set(words))
        out[lo:hi] = (
            (n < FEW_WORDS) * 1
            + (100 * distinct < MIN_DISTINCT_PERCENT * n) * 2
            + (100 * _count(_CAPITAL[part], at) > MAX_CAPITAL_PERCENT * points) * 4
            + (_count(_SIGN[part], at) > 0) * 8
        )
    return out


def _add_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
        kept.append(("mask", pa.array(text_masks(batch.column("text")), pa.int32())))
        yield pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])


def failure_masks(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Documents, good and toxic ones per (part, mask): (part, mask, docs, good, toxic)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        # Together more than 100 independent bits: equal only where the texts are.
        F.xxhash64(text).alias("h"),
        F.crc32(text).alias("c"),
        F.octet_length(text).alias("size"),
        text.alias("text"),
    )
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", mask int"
    masked = rows.mapInArrow(_add_masks, schema)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        *[F.coalesce(F.max((F.col(source) == 1).cast("int")), F.lit(0)).alias(name) for source, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    # Rows without an id have no labels; they are dealt by their text, not all to one task.
    dealt = masked.withColumn("deal", F.when(F.col("id").isNull(), F.pmod("h", F.lit(_NULL_PARTS))).otherwise(F.lit(_HAS_ID)))
    return copies_marked(dealt.join(marks.withColumn("deal", F.lit(_HAS_ID)), ["id", "deal"], "left").na.fill(0, ["good", "toxic"]))


def copies_marked(rows: DataFrame) -> DataFrame:
    """Bit E set and rows counted; rows without an id, told by ``deal``, take no part in copies."""
    text, group = ["h", "c", "size", "deal"], ["part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*text, *group, "id").agg(F.count(F.lit(1)).alias("n"))
    by_group = by_id.groupBy(*text, *group).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    first = F.min("first.id").over(Window.partitionBy(*text))
    # Of a text's rows in this part, those with its smallest id are no copies.
    own = F.when(F.col("deal") != _HAS_ID, F.col("n")).when(F.col("first.id") == first, F.col("first.n")).otherwise(F.lit(0))
    split = by_group.select(*group, "n", own.alias("own"))
    as_copy = F.col("mask").bitwiseOR(F.lit(COPY_BIT))
    both = split.select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct(as_copy.alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("x"),
    ).select("part", "good", "toxic", F.col("x.mask").alias("mask"), F.col("x.n").alias("n"))
    weights = [F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return both.groupBy("part", "mask").agg(*weights)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(ws) < 200,
    'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS f
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (
  SELECT part, f.A::INT + 2 * f.B::INT + 4 * f.C::INT + 8 * f.D::INT + 16 * f.E::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, unnest([1, 2, 3, 4, 5]) AS step,
    unnest([f1.b, f2.b, f3.b, f4.b, f5.b]) AS b, unnest([0, f1.b, f1.b + f2.b, f1.b + f2.b + f3.b, f1.b + f2.b + f3.b + f4.b]) AS before
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5
), s AS (
  SELECT part, filter_order, step, b,
    coalesce(sum(n) FILTER (WHERE mask & (before | b) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & b <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & b <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = b), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & b <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & b <> 0), 0)::BIGINT AS toxic_lost
  FROM c, o GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM s
"""
