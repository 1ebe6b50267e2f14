"""Boosted regression trees with second-order gain and penalties, many models grown together.

All models of a call (settings, targets, groups of rows such as backtest origins) grow at once: one pass over the rows
per tree level adds up, inside the tasks, the gradients and counts per (model, node, feature, bin); the sums of the tasks meet in one
shuffle, and the best cut of each node is found where its sums are. Only cuts reach the driver: a few numbers per node. The number of
passes is the number of rounds times the depth, however many models there are.

Features are binned once, at quantiles of the training rows of their group, and written as one byte each. The written rows are kept by the
executors as blocks, one per group and batch, with the bins column by column; what does not fit in memory goes to disk. Margins (the
forecasts so far) are part of a block and are brought up to date every ``KEEP`` rounds; the trees since then are applied as a block is read.
A lost executor repeats its part of the passes from the written rows on.

For squared error the gradient is the error and the second derivative is one. With G and N the sums of a node, soft thresholding
T(G) by the L1 penalty and L2 penalty l2, a cut gains T(Gl)^2/(Nl+l2) + T(Gr)^2/(Nr+l2) - T(G)^2/(N+l2), and a leaf is worth -step * T(G)/(N+l2).
Gradients are multiples of 2^-20, so that their sums do not depend on the order of adding, and equal data give equal trees under any
partitioning. Rows and columns are drawn per tree by a hash of the row's key, or of the column, with the round.

A group whose bins take no more than ``ALONE_BYTES`` is sent to single tasks instead, which grow its models from the first round to the last
(:func:`grow_alone`): a level then costs no job, and no row is read twice. As sums are whole numbers, a cut side's sums are the node's less the
other side's, and the trees are those of the passes over all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstress.session import materialize

#: Bins of a feature, at most.
BINS = 64
#: Rounds after which margins are brought up to date.
KEEP = 25
#: Rows of a part of the written rows, when there are more than every core needs.
PART_ROWS = 500_000
#: Bins of a group, in bytes, up to which single tasks grow its models.
ALONE_BYTES = 256 << 20
#: Rows that such a task adds up at a time, and rows from which on two features share a sum.
_SLICE = 1 << 15
_PAIRED = 1 << 16
_UNIT = 2.0**20
# Smallest gain of a cut, fewest rows of a side.
MIN_GAIN = 1e-6
MIN_ROWS = 1


@dataclass(frozen=True)
class TreeSetting:
    """One candidate: shape, step, shares of rows and columns per tree, penalties."""

    max_depth: int = 3
    step: float = 0.3
    rows: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0


@dataclass(frozen=True)
class Booster:
    """One model to grow: on the rows of a group, for one entry of the targets."""

    group: int
    target: int
    setting: TreeSetting


@dataclass
class Tree:
    """Nodes as a heap from 1: feature (-1 for a leaf), cut (bins up to it go left) and value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1)
        return cls(np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node that each row has reached after ``depth`` steps, or its leaf before."""
        at = np.ones(len(bins), dtype=np.uint8 if len(self.feature) <= 256 else np.int32)
        for level in range(depth):
            step = at.copy()
            for node in range(2**level, 2 ** (level + 1)):
                if self.feature[node] >= 0:
                    go = bins[:, self.feature[node]] > self.cut[node]
                    step += (at + go) * (at == node)
            at = step
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, len(self.value).bit_length() - 2)]


@dataclass
class BoostedModel:
    """A grown model; ``errors`` and ``absolute`` are its mean squared and absolute validation errors after every round."""

    booster: Booster
    base: float
    edges: np.ndarray  # (features, bins - 1), filled up with infinity
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    absolute: list[float] = field(default_factory=list)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += tree.values(bins)
        return out


# ---- draws and bins ----------------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _key(seed: int, turn: int) -> np.uint64:
    return _mix(np.array([seed * 1_000_003 + turn], dtype=np.uint64))[0]


def drawn_rows(ids: np.ndarray, share: float, seed: int, turn: int) -> np.ndarray:
    """Rows that take part in the tree of a round."""
    if share >= 1.0:
        return np.ones(len(ids), dtype=bool)
    return (_mix(ids.astype(np.int64).view(np.uint64) ^ _key(seed, turn)) >> np.uint64(11)) * 2.0**-53 < share


def drawn_columns(features: int, share: float, seed: int, turn: int) -> np.ndarray:
    """Mask of the columns that take part in the tree of a round."""
    number = max(1, int(share * features))
    order = np.argsort(_mix(np.arange(1, features + 1, dtype=np.uint64) ^ _key(seed + 1, turn)), kind="stable")
    mask = np.zeros(features, dtype=bool)
    mask[order[:number]] = True
    return mask


def _cells(x: np.ndarray) -> np.ndarray:
    """Upper half of a monotone code of single-precision values: 128 cells per doubling."""
    x = x.astype(np.float32)
    x[np.isnan(x)] = np.nan  # of either sign
    bits = x.view(np.int32)
    return (bits ^ ((bits >> 31) & 0x7FFFFFFF)) >> 16


def _cell_top(cells: np.ndarray) -> np.ndarray:
    """Largest value of each cell."""
    code = (cells.astype(np.int32) << 16) | 0xFFFF
    return (code ^ ((code >> 31) & 0x7FFFFFFF)).view(np.float32).astype(np.float64)


def quantile_edges(cells: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of at most ``bins`` - 1 bins of about equal counts; the last bin is open."""
    order = np.argsort(cells)
    upto, tops = np.cumsum(counts[order]), _cell_top(cells[order])
    if len(tops) <= bins:
        chosen = np.arange(len(tops))
    else:
        chosen = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
    return tops[chosen[chosen < len(tops) - 1]]


def cell_numbers(x: np.ndarray) -> np.ndarray:
    """The cell of each value, counted from the smallest on."""
    out = np.empty(x.shape, np.uint16)
    for row, cells in zip(x, out):  # a row at a time, as the codes take more room than the values
        cells[:] = _cells(row) + (1 << 15)
    return out


def cell_bins(counts: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """From the rows of every cell the edges, filled up with infinity, and each cell's bin: the number of edges below it."""
    cells = np.flatnonzero(counts)
    found = quantile_edges(cells - (1 << 15), counts[cells], bins)
    edges = np.full(bins - 1, np.inf)
    edges[: len(found)] = found
    steps = np.bincount(_cells(edges) + (1 << 15) + 1, minlength=1 << 16)
    return edges, np.cumsum(steps)[: 1 << 16].astype(np.uint8)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of edges below each value, as a byte; a missing value stands above all."""
    return np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, x.astype(np.float32).astype(float).T)], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


#: Cells that a task holds before it adds up equal ones.
_CELLS = 4_000_000


def fit_edges(rows: DataFrame, bins: int = BINS) -> dict[int, np.ndarray]:
    """Bin edges per group from all its rows (group, x); a task counts its cells, at most 2^16 a feature, and sends one list a feature."""

    def compact(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(n[order], first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held, limit = 0, _CELLS
        for batch in batches:
            if batch.num_rows == 0:
                continue
            group, x = batch.column("group").to_numpy(), _matrix(batch.column("x"))
            for g in np.unique(group):
                cells = np.sort(_cells(x[group == g]).astype(np.int16).T, axis=1, kind="stable")  # by digits, as they have 16 bits
                at = np.flatnonzero(np.diff(cells, axis=1, prepend=cells[:, :1] ^ 1))
                keys = (((int(g) << 16) + at // cells.shape[1]) << 16) + (cells.ravel()[at].astype(np.int64) + (1 << 15))
                seen.append((keys, np.diff(at, append=cells.size)))
                held += len(keys)
            if held > limit:
                seen = [compact(*map(np.concatenate, zip(*seen)))]
                held = len(seen[0][0])
                limit = max(_CELLS, 2 * held)
        if not seen:
            return
        keys, n = compact(*map(np.concatenate, zip(*seen)))
        starts = np.flatnonzero(np.diff(keys >> 16, prepend=-1))
        for some in np.array_split(starts, -(-len(starts) // 64)):
            stop = starts[starts > some[-1]][:1]
            at = slice(some[0], stop[0] if len(stop) else len(keys))
            cells = pa.array(((keys[at] & 0xFFFF) - (1 << 15)).astype(np.int32))
            ends = pa.array(np.append(some - some[0], len(cells)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys[some] >> 32).astype(np.int32)), pa.array(((keys[some] >> 16) & 0xFFFF).astype(np.int32)),
                 pa.ListArray.from_arrays(ends, cells), pa.ListArray.from_arrays(ends, pa.array(n[at].astype(np.int64)))],
                names=["group", "feature", "cell", "n"],
            )

    def merged(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, n = compact(cells.astype(np.int64) + (1 << 15), n)
        return keys - (1 << 15), n

    def edges(key: tuple, table: pa.Table) -> pa.Table:
        cells, n = (table[c].combine_chunks().flatten().to_numpy() for c in ("cell", "n"))
        found = quantile_edges(*merged(cells, n), bins)
        return pa.table({"group": pa.array([key[0].as_py()], pa.int32()), "feature": pa.array([key[1].as_py()], pa.int32()), "edges": pa.array([found.tolist()], pa.list_(pa.float64()))})

    cells = rows.select("group", "x").mapInArrow(count, "group int, feature int, cell array<int>, n array<bigint>")
    found = cells.groupBy("group", "feature").applyInArrow(edges, "group int, feature int, edges array<double>").collect()
    out: dict[int, np.ndarray] = {}
    width = 1 + max((r["feature"] for r in found), default=-1)
    for r in found:
        out.setdefault(r["group"], np.full((width, bins - 1), np.inf))[r["feature"], : len(r["edges"])] = r["edges"]
    return out


# ---- growing -----------------------------------------------------------------------------------


class _Growing:
    """What the driver knows of one model while it grows."""

    def __init__(self, model: BoostedModel, place: int, seed: int, rounds: int, patience: int | None):
        self.model, self.place, self.seed, self.rounds, self.patience = model, place, seed, rounds, patience
        self.written = 0  # trees that the margins hold
        self.tree: Tree | None = None
        self.open: list[int] = []
        self.best = (np.inf, 0)
        self.done = False

    @property
    def setting(self) -> TreeSetting:
        return self.model.booster.setting

    def judge(self, stats: np.ndarray | None) -> None:
        """Take the validation error of the last round; stop after enough rounds without a better one."""
        if stats is not None and stats[2] > 0:
            error = stats[0] / stats[2]
            self.model.errors.append(error)
            self.model.absolute.append(stats[1] / stats[2])
            if error < self.best[0]:
                self.best = (error, len(self.model.errors))
            elif self.patience is not None and len(self.model.errors) - self.best[1] >= self.patience:
                self.done = True
        if len(self.model.trees) >= self.rounds:
            self.done = True

    def kept(self) -> BoostedModel:
        if self.patience is not None and self.model.errors:
            self.model.trees = self.model.trees[: self.best[1]]
        return self.model


@dataclass(frozen=True)
class _Part:
    """What a task needs of one model: the trees that the written margins lack, and the tree in hand."""

    place: int
    target: int
    setting: TreeSetting
    seed: int
    turn: int
    pending: list[Tree]
    tree: Tree | None = None
    open: tuple[int, ...] = ()

    def margin(self, bins: np.ndarray, margins: np.ndarray) -> np.ndarray:
        out = margins[:, self.place].copy()
        for tree in self.pending:
            out += tree.values(bins)
        return out


_Plan = dict[int, list[tuple[int, _Part]]]


def _plan(growing: list[tuple[int, _Growing]]) -> _Plan:
    out: _Plan = {}
    for number, s in growing:
        b, trees = s.model.booster, s.model.trees
        part = _Part(s.place, b.target, b.setting, s.seed, len(trees), trees[s.written :], s.tree, tuple(s.open))
        out.setdefault(b.group, []).append((number, part))
    return out


#: Of the rows of a group in one batch: whether validation, ids, bins by column, targets, margins.
_Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(state: DataFrame, features: int) -> RDD:
    """The written rows as (group, block), kept by the executors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = batch.column("group").to_numpy()
            raw = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(len(group), features)
            y, margins = _matrix(batch.column("y")), batch.column("m")
            val, ids = batch.column("is_val").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                block = (val[at], ids[at], np.asfortranarray(raw[at]), y[at], np.asfortranarray(_matrix(margins.take(pa.array(at)))))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([pickle.dumps(block)], pa.binary())], names=["group", "block"])

    packed = state.mapInArrow(pack, "group int, block binary")
    return packed.rdd.map(lambda r: (r[0], pickle.loads(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)


def _node_sums(raw: np.ndarray, place: np.ndarray, nodes: int, gradient: np.ndarray, use: np.ndarray, bins: int) -> np.ndarray:
    """Gradients (in units) and counts per (node, feature, bin) of the rows in ``use``; ``place`` is the node's number.

    Both sums are whole numbers. As long as they fit, they share one sum: the count stands above the gradients' highest bit.
    """
    out = np.zeros((2, nodes, raw.shape[1], bins))
    start, size = place.astype(np.int64) * bins, nodes * bins
    count = use.astype(float)
    gradient = np.where(use, gradient, 0.0)
    unit = 2.0 ** np.ceil(np.log2(2.0 * np.abs(gradient).sum() + 2.0))
    together = unit * (len(use) + 1) < 2.0**53
    for f in range(raw.shape[1]):
        index = start + raw[:, f]
        if together:
            both = np.bincount(index, gradient + unit * count, size)
            n = np.rint(both / unit)
            g = both - unit * n
        else:
            g, n = np.bincount(index, gradient, size), np.bincount(index, count, size)
        out[0, :, f], out[1, :, f] = g.reshape(nodes, bins), n.reshape(nodes, bins)
    return out


def _level_sums(plan: _Plan, depth: int, features: int, bins: int, judged: bool):
    """Task-side sums of one level: per model and open node the gradients and counts of every (feature, bin).

    Node 0 holds the validation sums: squared errors, absolute errors, rows.
    """

    def sums(blocks: Iterator[tuple[int, _Block]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        first = 2**depth
        totals: dict[int, np.ndarray] = {}
        stats: dict[int, np.ndarray] = {}
        for group, (val, ids, raw, y, margins) in blocks:
            for number, part in plan.get(group, ()):
                error = part.margin(raw, margins) - y[:, part.target]
                if judged and val.any():
                    e = error[val]
                    stats[number] = stats.get(number, 0.0) + np.array([np.sum(e * e), np.sum(np.abs(e)), len(e)])
                if part.tree is None:
                    continue
                use = ~val & drawn_rows(ids, part.setting.rows, part.seed, part.turn)
                node = part.tree.nodes(raw, depth)
                wanted = np.zeros(2 * first, dtype=bool)
                wanted[list(part.open)] = True
                use &= wanted[node]
                if not use.any():
                    continue
                found = _node_sums(raw, np.where(use, node, first) - first, first, np.rint(error * _UNIT), use, bins)
                found[0] /= _UNIT
                if number in totals:
                    totals[number] += found
                else:
                    totals[number] = found
        for number, v in stats.items():
            yield (number, 0), v
        for number, out in totals.items():
            for k in np.flatnonzero(out[1].any(axis=(1, 2))):
                yield (number, first + int(k)), out[:, k].ravel()

    return sums


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_cut(g: np.ndarray, n: np.ndarray, setting: TreeSetting, columns: np.ndarray) -> tuple[int, int, float, float, float, float]:
    """Feature and bin of the best cut (-1 when none gains enough), with gradients and counts left and in all.

    Of equal gains the first feature and bin win.
    """
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    all_g, all_n = float(g[0].sum()), float(n[0].sum())

    def score(gradient, count):
        return _soft(gradient, setting.l1) ** 2 / np.maximum(count + setting.l2, 1e-12)

    gain = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(np.float64(all_g), all_n)
    allowed = (left_n >= MIN_ROWS) & (all_n - left_n >= MIN_ROWS) & columns[:, None]
    gain = np.where(allowed, gain, -np.inf)
    at = int(np.argmax(gain))
    if not gain.flat[at] > MIN_GAIN:
        return -1, 0, 0.0, 0.0, all_g, all_n
    feature, cut = divmod(at, gain.shape[1])
    return feature, cut, float(left_g[feature, cut]), float(left_n[feature, cut]), all_g, all_n


def _cuts(settings: dict[int, tuple[TreeSetting, np.ndarray]], features: int, bins: int):
    """Best cut of every node from its sums; validation sums pass through."""

    def find(item: tuple[tuple[int, int], np.ndarray]) -> tuple[tuple[int, int], np.ndarray]:
        (model, node), v = item
        if node > 0:
            g, n = (np.rint(v * _UNIT) / _UNIT).reshape(2, features, bins)
            v = np.array(best_cut(g, np.rint(n), *settings[model]))
        return (model, node), v

    return find


def _run_level(blocks: RDD, plan: _Plan, depth: int, features: int, bins: int, judged: bool, columns) -> dict[tuple[int, int], np.ndarray]:
    nodes = sum(1 + len(part.open) for parts in plan.values() for _, part in parts)
    added = blocks.mapPartitions(_level_sums(plan, depth, features, bins, judged)).reduceByKey(
        lambda a, b: a + b, min(nodes, blocks.getNumPartitions()), lambda key: key[0] * 2 + key[1]
    )
    return dict(added.map(_cuts(columns, features, bins)).collect())


def _grow_node(tree: Tree, node: int, numbers: np.ndarray, setting: TreeSetting) -> list[int]:
    """Write a node's cut and its children's values; the children that may be cut in turn."""
    feature, cut, left_g, left_n, g, n = numbers

    def worth(gradient: float, count: float) -> float:
        return float(-setting.step * _soft(np.float64(gradient), setting.l1) / (count + setting.l2))

    if node == 1:
        tree.value[1] = worth(g, n)
    if feature < 0:
        return []
    tree.feature[node], tree.cut[node] = int(feature), int(cut)
    tree.value[2 * node], tree.value[2 * node + 1] = worth(left_g, left_n), worth(g - left_g, n - left_n)
    return [2 * node, 2 * node + 1]


def _with_margins(plan: _Plan):
    """A block with the margins of all models brought up to date."""

    def update(item: tuple[int, _Block]) -> tuple[int, _Block]:
        group, (val, ids, raw, y, old) = item
        margins = old.copy(order="F")
        for _, part in plan.get(group, ()):
            margins[:, part.place] = part.margin(raw, old)
        return group, (val, ids, raw, y, margins)

    return update


# ---- growing in one task -----------------------------------------------------------------------


class Columns:
    """Bins of a task's rows, column by column; with many rows a column holds two features, so that one sum serves both."""

    def __init__(self, features: int, bins: int, rows: int):
        self.features, self.bins, self.rows = features, bins, rows
        self.per = 2 if rows >= _PAIRED and bins <= 256 else 1
        self.data = np.zeros((-(-features // self.per), rows), np.uint16 if self.per == 2 else np.uint8)

    def put(self, feature: int, bins: np.ndarray, at: slice = slice(None)) -> None:
        column = self.data[feature // self.per, at]
        if self.per == 1:
            column[:] = bins
        else:
            column += bins if feature % 2 else bins * np.uint16(self.bins)

    def above(self, rows: np.ndarray | None, feature: int, cut: int) -> np.ndarray:
        """Which of the rows (None for all) have a bin above the cut."""
        column = self.data[feature // self.per]
        v = column if rows is None else column.take(rows)
        if self.per == 1:
            return v > cut
        return v % np.uint16(self.bins) > cut if feature % 2 else v >= (int(cut) + 1) * self.bins

    def sums(self, rows: np.ndarray | None, gradient: np.ndarray, use: np.ndarray | None) -> np.ndarray:
        """Gradients (in units) and counts per (feature, bin) of the rows (None for all) in ``use`` (None for all)."""
        out = np.zeros((2, self.features, self.bins))
        if rows is not None and use is not None:
            rows = rows[use[rows]]
        index = np.empty(_SLICE, np.intp)
        for start in range(0, self.rows if rows is None else len(rows), _SLICE):
            at = slice(start, start + _SLICE) if rows is None else rows[start : start + _SLICE].astype(np.intp)
            g, n = gradient[at], 1.0
            if rows is None and use is not None:
                g, n = np.where(use[at], g, 0.0), use[at].astype(float)
            unit = 2.0 ** np.ceil(np.log2(2.0 * np.abs(g).sum() + 2.0))
            if unit * (len(g) + 1) < 2.0**53:  # see _node_sums
                both = self._added(at, g + unit * n, index)
                n = np.rint(both / unit)
                out[0] += both - unit * n
                out[1] += n
            else:
                out[0] += self._added(at, g, index)
                out[1] += self._added(at, np.zeros(len(g)) + n, index)
        return out

    def _added(self, at, weights: np.ndarray, index: np.ndarray) -> np.ndarray:
        index, size = index[: len(weights)], self.bins**self.per
        found = np.empty((len(self.data), size))
        for column, sums in zip(self.data, found):
            index[:] = column[at] if isinstance(at, slice) else column.take(at)
            sums[:] = np.bincount(index, weights, size)
        if self.per == 2:
            found = found.reshape(-1, self.bins, self.bins)
            found = np.stack([found.sum(axis=2), found.sum(axis=1)], axis=1).reshape(-1, self.bins)
        return found[: self.features]

    def add_values(self, tree: Tree, margins: np.ndarray) -> None:
        """Add to each row's margin the value of the leaf that it reaches."""
        held: dict[int, np.ndarray | None] = {1: None}
        while held:
            node, rows = held.popitem()
            if tree.feature[node] < 0:
                margins[slice(None) if rows is None else rows] += tree.value[node]
            else:
                held[2 * node], held[2 * node + 1] = _sides(self.above(rows, tree.feature[node], tree.cut[node]), rows)


def _sides(go: np.ndarray, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if rows is None:
        return np.flatnonzero(~go).astype(np.int32), np.flatnonzero(go).astype(np.int32)
    return rows[~go], rows[go]


def _one_tree(columns: Columns, gradient: np.ndarray, use: np.ndarray | None, setting: TreeSetting, mask: np.ndarray, margins: np.ndarray) -> Tree:
    """Grow the tree of a round on a task's own rows and add it to their margins; only the smaller side of a cut is added up."""
    tree = Tree.empty(setting.max_depth)
    rows: dict[int, np.ndarray | None] = {1: None}
    held = {1: columns.sums(None, gradient, use)}
    whole = np.abs(gradient).sum() < 2.0**53  # all sums are exact
    for depth in range(setting.max_depth):
        below: dict[int, np.ndarray] = {}
        for node, sums in held.items():
            if not sums[1, 0].any():
                continue
            numbers = best_cut(sums[0] / _UNIT, sums[1], setting, mask)
            if not _grow_node(tree, node, numbers, setting):
                continue
            left, right = 2 * node, 2 * node + 1
            at = rows.pop(node)
            go = columns.above(at, tree.feature[node], tree.cut[node])
            if depth + 1 == setting.max_depth:
                margins[slice(None) if at is None else at] += np.where(go, tree.value[right], tree.value[left])
                continue
            rows[left], rows[right] = _sides(go, at)
            small, large = (left, right) if 2 * numbers[3] <= numbers[5] else (right, left)
            below[small] = columns.sums(rows[small], gradient, use)
            below[large] = sums - below[small] if whole else columns.sums(rows[large], gradient, use)
        held = below
    for node, at in rows.items():
        margins[slice(None) if at is None else at] += tree.value[node]
    return tree


def grow_alone(
    booster: Booster, edges: np.ndarray, columns: Columns, y: np.ndarray, ids: np.ndarray | None, base: float, rounds: int, patience: int | None,
    seed: int, val: Columns | None = None, y_val: np.ndarray | None = None,
) -> BoostedModel:
    """One model on a task's own training rows, judged on its validation rows. ``ids`` may be left out when all rows take part."""
    state = _Growing(BoostedModel(booster, base, edges), 0, seed, rounds, patience)
    model, setting = state.model, booster.setting
    margins = np.full(columns.rows, base)
    judged = None if val is None or not val.rows else np.full(val.rows, base)
    while not state.done and len(model.trees) < rounds:
        turn = len(model.trees)
        gradient = margins - y
        gradient *= _UNIT
        np.rint(gradient, out=gradient)
        use = None if setting.rows >= 1.0 else drawn_rows(ids, setting.rows, seed, turn)
        tree = _one_tree(columns, gradient, use, setting, drawn_columns(columns.features, setting.columns, seed, turn), margins)
        model.trees.append(tree)
        if patience is None and len(model.trees) >= rounds:  # nothing to judge: the last tree ends it
            break
        stats = None
        if judged is not None:
            val.add_values(tree, judged)
            e = judged - y_val
            stats = np.array([np.sum(e * e), np.sum(np.abs(e)), len(e)])
        state.judge(stats)
    return state.kept()


#: A task's work: its group and the numbers of the models that it grows.
_Work = tuple[int, list[int]]


def deal_models(boosters: list[Booster], sizes: dict[int, int], cores: int) -> list[_Work]:
    """Tasks that grow the models of the groups in ``sizes`` (rows): a group's models are parted when there are fewer groups than twice the cores."""
    members: dict[int, list[int]] = {}
    for number, b in enumerate(boosters):
        if b.group in sizes:
            members.setdefault(b.group, []).append(number)
    out: list[tuple[int, int, list[int]]] = []
    for group, numbers in members.items():
        tasks = min(len(numbers), -(-2 * cores // len(members)))
        deepest = sorted(numbers, key=lambda n: -boosters[n].setting.max_depth)
        for k in range(tasks):
            mine = sorted(deepest[k::tasks])
            out.append((sizes[group] * sum(boosters[n].setting.max_depth for n in mine), group, mine))
    return [(group, mine) for _, group, mine in sorted(out, key=lambda w: (-w[0], w[1:]))]


def grow_in_tasks(values: RDD, work: list[_Work], grow) -> dict[int, BoostedModel]:
    """Send the values (group, value) of a group to each of its tasks; ``grow`` makes the models, by number, of a task's work and values."""
    tasks: dict[int, list[int]] = {}
    for k, (group, _) in enumerate(work):
        tasks.setdefault(group, []).append(k)

    def run(sent: Iterator) -> Iterator[tuple[int, BoostedModel]]:
        for task, value in sent:  # those of one task, or none when there are more parts than tasks
            yield from grow(work[task], chain([value], (v for _, v in sent)))

    sent = values.flatMap(lambda v: [(k, v[1]) for k in tasks.get(v[0], ())]).partitionBy(len(work), int)
    return dict(sent.mapPartitions(run).collect())


def _grow_blocks(
    boosters: list[Booster], limits: list[int], patience: int | None, seed: int, bins: int, edges: dict[int, np.ndarray], bases: dict[int, list[float]],
    sizes: dict[int, tuple[int, int]],
):
    """Task-side growing from blocks; ``sizes`` are the training and the validation rows of a group."""

    def grow(work: _Work, blocks: Iterator[_Block]) -> Iterator[tuple[int, BoostedModel]]:
        group, numbers = work
        targets, features = 1 + max(boosters[n].target for n in numbers), len(edges[group])
        columns, ids = [Columns(features, bins, n) for n in sizes[group]], np.zeros(sizes[group][0], np.int64)
        ys, at = [np.zeros((targets, n)) for n in sizes[group]], [0, 0]
        for val, some, raw, y, _ in blocks:
            for k, mine in enumerate((~val, val)):
                place = slice(at[k], at[k] + int(mine.sum()))
                at[k] = place.stop
                for f in range(features):
                    columns[k].put(f, raw[mine, f], place)
                ys[k][:, place] = y[mine, :targets].T
                if k == 0:
                    ids[place] = some[mine]
        if tuple(at) != sizes[group]:
            raise ValueError(f"group {group} has {at} rows where {sizes[group]} were counted")
        for number in numbers:
            b = boosters[number]
            yield number, grow_alone(
                b, edges[group], columns[0], ys[0][b.target], ids, bases[group][b.target], limits[number], patience, seed, columns[1], ys[1][b.target]
            )

    return grow


# ---- growing in passes over all tasks ----------------------------------------------------------


_STATE = "group int, is_val boolean, id bigint, bins binary, y array<double>, m array<double>"


def _binned_rows(rows: DataFrame, edges: dict[int, np.ndarray], bases: dict[int, list[float]]) -> DataFrame:
    """Binned rows of the groups in ``bases`` with their first margins."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, x = batch.column("group").to_numpy(), _matrix(batch.column("x"))
            raw: list[bytes] = [b""] * len(group)
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                for i, b in zip(at, binned(x[at], edges[int(g)])):
                    raw[i] = b.tobytes()
            margins = pa.array([bases[int(g)] for g in group], pa.list_(pa.float64()))
            columns = [batch.column("group"), batch.column("is_val"), batch.column("id"), pa.array(raw, pa.binary()), batch.column("y"), margins]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "is_val", "id", "bins", "y", "m"])

    return rows.where(F.col("group").isin(list(bases))).mapInArrow(prepare, _STATE)


def _state_rows(rows: DataFrame, edges: dict[int, np.ndarray], bases: dict[int, list[float]], parts: int) -> DataFrame:
    """Binned rows dealt by group and id to so many parts, written once."""
    return materialize(_binned_rows(rows, edges, bases).repartitionByRange(parts, "group", "id"), "boost-rows")


def fit_boosters(
    rows: DataFrame, boosters: list[Booster], rounds: int | list[int], patience: int | None = None, seed: int = 42, bins: int = BINS,
    base: float | None = None,
) -> list[BoostedModel | None]:
    """Grow all models at once. ``rows``: group int, is_val boolean, id bigint, x array<double>, y array<double>.

    ``rounds`` holds for all models or has one entry each. With ``patience`` a model stops that many rounds after its smallest
    squared error on the validation rows of its group, and keeps the trees up to it. A group without training rows has no
    model. ``base`` is the first forecast; by default the mean of the training targets.
    """
    train = rows.where(~F.col("is_val"))
    edges = fit_edges(train, bins)
    targets = 1 + max(b.target for b in boosters)
    mine = ~F.col("is_val")
    counted = rows.groupBy("group").agg(
        F.count_if(mine).alias("train"), F.count_if(~mine).alias("val"), *[F.avg(F.when(mine, F.col("y")[t])).alias(f"t{t}") for t in range(targets)]
    )
    found = [r for r in counted.collect() if r["group"] in edges]
    means = {r["group"]: [round(float(v), 6) if base is None else base for v in r[3:]] for r in found}
    sizes = {r["group"]: (r["train"], r["val"]) for r in found}
    limits = rounds if isinstance(rounds, list) else [rounds] * len(boosters)
    features = len(next(iter(edges.values()), []))
    alone = {g: n for g, n in sizes.items() if sum(n) * features <= ALONE_BYTES}
    done: dict[int, BoostedModel] = {}
    if work := deal_models(boosters, {g: sum(n) for g, n in alone.items()}, rows.sparkSession.sparkContext.defaultParallelism):
        blocks = _blocks(_binned_rows(rows, edges, {g: [] for g in alone}), features).unpersist()  # read once
        done = grow_in_tasks(blocks, work, _grow_blocks(boosters, limits, patience, seed, bins, edges, means, sizes))
    large = [n for n, b in enumerate(boosters) if b.group in edges and n not in done]
    if large:
        grown = _fit_in_passes(rows, [boosters[n] for n in large], [limits[n] for n in large], patience, seed, bins, edges, means, sizes)
        done |= dict(zip(large, grown))
    return [done.get(n) for n in range(len(boosters))]


def _fit_in_passes(
    rows: DataFrame, boosters: list[Booster], limits: list[int], patience: int | None, seed: int, bins: int, edges: dict[int, np.ndarray],
    means: dict[int, list[float]], sizes: dict[int, tuple[int, int]],
) -> list[BoostedModel]:
    """Grow models on groups of any size."""
    growing: list[_Growing] = []
    by_group: dict[int, list[_Growing]] = {}
    for booster, limit in zip(boosters, limits, strict=True):
        members = by_group.setdefault(booster.group, [])
        model = BoostedModel(booster, means[booster.group][booster.target], edges[booster.group])
        growing.append(_Growing(model, len(members), seed, limit, patience))
        members.append(growing[-1])
    features = len(next(iter(edges.values())))
    # A number of parts that is given is kept: few rows go to all cores, too.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, sum(sizes[g][0] for g in by_group) // PART_ROWS)
    blocks = _blocks(_state_rows(rows, edges, {g: [s.model.base for s in m] for g, m in by_group.items()}, parts), features)
    kept = [blocks]
    try:
        _grow(kept, growing, features, bins, patience)
    finally:
        for blocks in kept:
            blocks.unpersist()
    return [s.kept() for s in growing]


def _grow(kept: list[RDD], growing: list[_Growing], features: int, bins: int, patience: int | None) -> None:
    """Grow all models to their end; ``kept`` holds the blocks that the executors keep."""
    turn = 0
    while True:
        active = [(n, s) for n, s in enumerate(growing) if not s.done]
        if not active:
            break
        for _, s in active:
            s.tree, s.open = (Tree.empty(s.setting.max_depth), [1]) if len(s.model.trees) < s.rounds else (None, [])
        columns = {n: (s.setting, drawn_columns(features, s.setting.columns, s.seed, len(s.model.trees))) for n, s in active}
        for depth in range(max(s.setting.max_depth for _, s in active)):
            live = [(n, s) for n, s in active if not s.done and (depth == 0 or (s.open and depth < s.setting.max_depth))]
            if not live:
                break
            found = _run_level(kept[-1], _plan(live), depth, features, bins, depth == 0 and turn > 0, columns)
            if depth == 0 and len(kept) > 1:  # all blocks have the newer margins
                kept.pop(0).unpersist()
            for n, s in live:
                if depth == 0 and turn > 0:
                    s.judge(found.get((n, 0)))
                if not s.done:
                    s.open = [c for node in s.open if (n, node) in found for c in _grow_node(s.tree, node, found[n, node], s.setting)]
        for _, s in active:
            if not s.done:
                s.model.trees.append(s.tree)
        if patience is None:  # nothing to judge: the last tree ends it
            for _, s in active:
                s.done = s.done or len(s.model.trees) >= s.rounds
        turn += 1
        if turn % KEEP == 0 and not all(s.done for s in growing):
            alive = [(n, s) for n, s in enumerate(growing) if not s.done]
            kept.append(kept[-1].map(_with_margins(_plan(alive))).persist(StorageLevel.MEMORY_AND_DISK))
            for _, s in alive:
                s.written = len(s.model.trees)


def predict_boosted(rows: DataFrame, models: list[BoostedModel | None], x: Column, group: Column | None = None) -> DataFrame:
    """Rows with ``pred``, one forecast per target in order; rows of groups without models are left out."""
    by_group: dict[int, list[BoostedModel]] = {}
    for model in models:
        if model is not None:
            by_group.setdefault(model.booster.group, []).append(model)
    for members in by_group.values():
        members.sort(key=lambda m: m.booster.target)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, values = batch.column("_group").to_numpy(), _matrix(batch.column("_x"))
            preds: list[list[float]] = [[]] * len(groups)
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                bins = binned(values[at], by_group[int(g)][0].edges)
                for i, p in zip(at, np.stack([m.predict(bins) for m in by_group[int(g)]], axis=1).astype(np.float32).tolist()):
                    preds[i] = p
            kept = [n for n in batch.schema.names if n not in ("_group", "_x")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(preds, pa.list_(pa.float32()))], names=[*kept, "pred"])

    schema = T.StructType([*rows.schema.fields, T.StructField("pred", T.ArrayType(T.FloatType()))])
    keyed = rows.withColumns({"_group": (F.lit(0) if group is None else group).cast("int"), "_x": x.cast("array<double>")})
    return keyed.where(F.col("_group").isin(list(by_group))).mapInArrow(apply, schema)
