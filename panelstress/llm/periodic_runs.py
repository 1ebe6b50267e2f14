"""Runs of repeated words in a text, found on a grammar made by recompression.

A run is a stretch of words with smallest period q that neither neighbour extends, of at least ``min_words`` words and two periods.

The grammar: rounds of block compression (a maximal block of one symbol becomes one symbol, named by the symbol and its
number) and pair compression (symbols are split in two classes; where one of the first class stands before one of the
second, the two become one symbol). Equal stretches are compressed alike but for their ends, so that the longest common
extension of two places is found by climbing: at every level the two places move on by at most one block or symbol to where
both open a symbol of the next level, until they meet different symbols; from there one step down per level leads to the words
that differ. Extensions to the left use the same grammar read backwards. No suffix array and no hash of a text is made;
names are exact, so the extensions are.

Candidates: a run of period q covers two neighbours of the grid 0, q, 2q, ..., so the neighbours of all grids, n ln(n) pairs
in all, hold every run. Pairs of unequal words fall out at once; the others are extended both ways. A run is met with its
smallest period and with multiples of it; the smallest stays.

Work is done inside tasks, on slices of documents that share one grammar; marks that occur once stand between documents. Nothing is
shuffled. A slice holds about one megabyte of text or one document, candidates are made by blocks, and output leaves by slices.

Defined results: a null or empty text has no words and no runs; repeated rows are judged one by one, a null id is carried; a very
long text is one slice, read whole; an empty table gives an empty one; other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.llm.common import WORD
from panelstress.llm.tokens import mix, slices, utf8

MIN_WORDS = 12
#: Candidate pairs made at once.
BLOCK = 1 << 19
#: Ways to split the symbols that are tried per round; the one that joins most pairs is taken.
_SPLITS = 3

# ---- the grammar -------------------------------------------------------------------------------


class Level:
    """One step of compression: symbols below, and where each symbol above starts."""

    __slots__ = ("symbols", "first", "parent", "blocks")

    def __init__(self, symbols: np.ndarray, first: np.ndarray, blocks: bool):
        self.symbols = symbols  # with places 0 .. n-1
        self.first = first  # of every symbol above, and n
        self.blocks = blocks
        opens = np.zeros(len(symbols), dtype=np.int32)
        opens[first[1:-1]] = 1
        self.parent = np.cumsum(opens, dtype=np.int32)

    def backwards(self) -> Level:
        n = len(self.symbols)
        return Level(self.symbols[::-1], n - self.first[::-1], self.blocks)


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    values, names = np.unique(keys, return_inverse=True)
    return names.astype(np.int64), len(values)


def _blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the maximal blocks (and n), and a key per block."""
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1], [True]]))
    length = np.diff(first)
    return first, symbols[first[:-1]] * (int(length.max()) + 1) + length


def _pairs(symbols: np.ndarray, names: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts after joining pairs (and n), and a key per symbol or pair."""
    best, joined = -1, None
    for k in range(_SPLITS):
        bit = (mix(np.arange(names, dtype=np.uint64) + np.uint64(1 + (turn * _SPLITS + k) * 0x9E3779B1)) >> np.uint64(40)) & np.uint64(1)
        side = bit.astype(bool)[symbols]
        for one in (side, ~side):
            at = one[:-1] & ~one[1:]
            number = int(np.count_nonzero(at))
            if number > best:
                best, joined = number, at
    second = np.concatenate([[False], joined])
    first = np.flatnonzero(np.concatenate([~second, [True]]))
    keys = symbols[first[:-1]] * (names + 1)
    opens = np.concatenate([joined, [False]])[first[:-1]]
    keys[opens] += symbols[first[:-1][opens] + 1] + 1
    return first, keys


class Grammar:
    """Levels of the compression of a sequence of names 0 .. names-1, and exact extensions in it.

    The first and the last symbol must occur once, so that no extension passes an end.
    """

    def __init__(self, symbols: np.ndarray, names: int):
        levels, turn = [], 0
        symbols = symbols.astype(np.int64)
        while names < len(symbols):  # at the top all symbols differ
            for blocks in (True, False):
                if len(symbols) == 1:
                    break
                first, keys = _blocks(symbols) if blocks else _pairs(symbols, names, turn)
                if len(first) - 1 == len(symbols):
                    continue  # nothing was joined
                levels.append(Level(symbols.astype(np.int32), first.astype(np.int32), blocks))
                symbols, names = _named(keys)
            turn += 1
        top = symbols.astype(np.int32)
        self._forward = levels, top
        self._backward = [level.backwards() for level in levels], top[::-1]
        self._n = len(levels[0].symbols) if levels else len(top)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and from j on."""
        return _extend(*self._forward, i, j)

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols before i and before j."""
        return _extend(*self._backward, self._n - i, self._n - j)


def _extend(levels: list[Level], top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = i.astype(np.int32), j.astype(np.int32)
    stopped = np.full(len(a), len(levels), dtype=np.int32)  # level at which the two symbols differ
    active = np.arange(len(a))
    for h, level in enumerate(levels):
        if len(active) == 0:
            break
        x, y = a[active], b[active]
        px, py = level.parent[x], level.parent[y]
        inside = (level.first[px] != x) | (level.first[py] != y)  # one of them stands inside a symbol of the next level
        same = level.symbols[x] == level.symbols[y]
        if level.blocks:
            rx, ry = level.first[px + 1] - x, level.first[py + 1] - y
            step = np.where(inside & same, np.minimum(rx, ry), 0).astype(np.int32)
            stop = inside & (~same | (rx != ry))
        else:
            step = (inside & same).astype(np.int32)
            stop = inside & ~same
        x, y = x + step, y + step
        a[active], b[active] = x, y
        stopped[active[stop]] = h
        active, x, y = active[~stop], x[~stop], y[~stop]
        a[active], b[active] = level.parent[x], level.parent[y]
    for h in range(len(levels) - 1, -1, -1):
        level = levels[h]
        above = np.flatnonzero(stopped > h)
        if len(above) == 0:
            continue
        px, py = a[above], b[above]
        x, y = level.first[px], level.first[py]
        same = level.symbols[x] == level.symbols[y]
        if level.blocks:
            step = np.where(same, np.minimum(level.first[px + 1] - x, level.first[py + 1] - y), 0)
        else:
            step = same
        a[above], b[above] = x + step, y + step
    return a.astype(np.int64) - i


# ---- runs --------------------------------------------------------------------------------------


def _candidates(start: np.ndarray, n: np.ndarray, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Neighbours of all grids of all documents, by blocks: place of the first, and the period."""
    most = np.where(n >= min_words, n // 2, 0)
    doc = np.repeat(np.arange(len(n)), most)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (n[doc] - 1) // q
    upto = np.cumsum(pairs)
    lo = 0
    while lo < len(doc):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
        count = pairs[lo:hi]
        period = np.repeat(q[lo:hi], count)
        step = np.arange(len(period)) - np.repeat(upto[lo:hi] - count - done, count)
        yield np.repeat(start[doc[lo:hi]], count) + step * period, period
        lo = hi


def runs_of(symbols: np.ndarray, names: int, start: np.ndarray, n: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Starts, ends and smallest periods of the runs of documents at ``start`` with ``n`` words, in order.

    Each document has a symbol before and after it that occurs nowhere else.
    """
    grammar, found = None, []
    for i, q in _candidates(start, n, min_words):
        equal = symbols[i] == symbols[i + q]
        i, q = i[equal], q[equal]
        if len(i) == 0:
            continue
        grammar = grammar or Grammar(symbols, names)
        right = grammar.right(i, i + q)
        left = grammar.left(i, i + q)
        run = left + right + q >= np.maximum(min_words, 2 * q)
        found.append((i[run] - left[run], i[run] + q[run] + right[run], q[run]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[: len(s)]
    s, e, q = s[new], e[new], q[new]
    by_period = np.lexsort((q, s))
    return s[by_period], e[by_period], q[by_period]


def _slice_runs(texts: list[bytes], min_words: int):
    """Per text: words, and its runs as (start, length, period) arrays with offsets; kept words joined."""
    names: dict[bytes, int] = {}
    words = [t.split() for t in texts]  # bytes are split at ASCII white space only
    n = np.array([len(w) for w in words], dtype=np.int64)
    start = np.cumsum(n + 1) - n  # one mark before every text, one at the end
    symbols = np.zeros(int(n.sum()) + len(n) + 1, dtype=np.int64)
    for at, w in zip(start, words):
        symbols[at : at + len(w)] = [names.setdefault(x, len(names)) for x in w]
    marks = np.append(start - 1, len(symbols) - 1)
    symbols[marks] = len(names) + np.arange(len(marks))
    s, e, q = runs_of(symbols, len(names) + len(marks), start, n, min_words)
    change = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, e, -1)
    dropped = np.cumsum(change) > 0
    doc = np.searchsorted(start, s, "right") - 1
    offsets = np.searchsorted(doc, np.arange(len(n) + 1))
    collapsed = []
    for d, w in enumerate(words):
        if offsets[d] < offsets[d + 1]:
            gone = dropped[start[d] : start[d] + n[d]]
            w = [x for x, g in zip(w, gone.tolist()) if not g]
        collapsed.append(b" ".join(w))
    return n, offsets, (s - start[doc], e - s, q), collapsed


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(min_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            raw, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets):
                data = raw[offsets[lo] : offsets[hi]].tobytes()
                at = offsets[lo : hi + 1] - offsets[lo]
                n, upto, runs, collapsed = _slice_runs([data[x:y] for x, y in zip(at[:-1], at[1:])], min_words)
                cells = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in runs], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo), pa.array(n), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), cells),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return find


def find_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of every document and its text without the repeats: doc_id, n_words, runs, collapsed.

    ``runs`` are (start, length, period) by start, then period. A word is left out of ``collapsed`` when a run holds it after the
    run's first period; the words that stay are joined by single spaces.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(_find(min_words), schema)


# ---- the query ---------------------------------------------------------------------------------


def with_planted_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, text), where texts chosen by a hash of the id repeat a stretch of their words up to the end.

    With h = crc32 of the decimal id and g = h div 10: where h % 10 = 0, each word i >= a becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = documents.select("doc_id", "text", h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0))
    parts = chosen.select("doc_id", "text", "h", words.alias("words"))
    n = F.size("words").cast("long")
    g = F.expr("h div 10")
    placed = parts.select("doc_id", "text", "words", n.alias("n"), g.alias("g")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    timed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(words, (w, i) -> IF(i >= a, words[int(a + (i - a) % p)], w)), ' ')")
    return timed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one, and digests of all runs and of the text without repeats."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    rows = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )
