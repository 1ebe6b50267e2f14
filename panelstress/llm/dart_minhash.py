"""Near duplicates by weighted Jaccard similarity of word shingles, found with DartMinHash signatures.

A text is a bag of shingles of five lower-cased words, weighted by their numbers. Darts are points of a Poisson
process over (shingle, weight, rank), made from hashes, so that every text sees the same darts. A text keeps the
darts that hit below its weights; each dart belongs to one coordinate of the signature, and the earliest rank per
coordinate stays. Work per text is in proportion to its shingles plus k log k, instead of their product. Rows of
coordinates form bands; texts that agree on a band are candidates.

Texts with equal bags are one node from the start. In a bucket (nodes that share a band) candidates are the pairs
of each node with two pivots: the node that meets the most others over all its bands, which lies in the middle
of its group, and the smallest node key. Every candidate is verified by its exact similarity
unless the links found so far already join it. Buckets that still hold several components are then searched for
the remaining links between components, block against block inside tasks, so that no link is lost and no bucket is
written out as all of its pairs.

Defined results: null texts and texts without a word are classes of their own; texts shorter than five words
are one shingle; rows that repeat id and text are exact copies; null ids join classes like others and sort last;
an empty table gives an empty one; extra columns are not read by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.llm import tokens
from panelstress.llm.common import free_name
from panelstress.session import materialize

SIMILARITY = (4, 5)
SHINGLE = 5
BANDS = 25
ROWS = 5
#: Nodes of a bucket that meet in one task, per side.
BLOCK = 1024
#: Pairs that agree on fewer coordinates of the sketch are not verified; 4.5 standard deviations below the bound.
SKETCH_SHARE = 0.64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _poisson_table(mean: float) -> np.ndarray:
    """Distribution function of a Poisson count, up to where it is 1 in double precision."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 30))
    logs = n * np.log(mean) - mean - np.cumsum(np.log(np.maximum(n, 1)))
    return np.cumsum(np.exp(logs))


_TABLES: dict[int, np.ndarray] = {}


def _throw(h: np.ndarray, level: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Darts of one region per element: index of the element, share of the weight, share of the rank, hash.

    A region spans the weights [2^level - 1, 2^(level+1) - 1) and a block of ranks; it holds 1, 1, 2, 4, ... darts
    on average, for blocks 0, 1, 2, 3, ...
    """
    mean = max(0, block - 1)
    if mean not in _TABLES:
        _TABLES[mean] = _poisson_table(2.0**mean)
    seed = tokens.mix(h ^ np.uint64((level * 64 + block + 1) * 0x9E3779B97F4A7C15 % 2**64))
    number = np.searchsorted(_TABLES[mean], tokens.unit(seed), "right")
    element = np.repeat(np.arange(len(h)), number)
    place = np.arange(len(element)) - np.repeat(np.cumsum(number) - number, number)
    dart = tokens.mix(seed[element] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return element, tokens.unit(tokens.mix(dart ^ np.uint64(1))), tokens.unit(tokens.mix(dart ^ np.uint64(2))), dart


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) signatures of weighted sets given as (doc, element hash, weight); rows without elements stay empty.

    Two texts agree on a coordinate with the probability of their weighted Jaccard similarity.
    """
    out = np.full((n_docs, k), _EMPTY, dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    darts = k * (np.log(k) + 6.0)  # leaves one text in 400 with an empty coordinate; those throw again
    todo = total > 0
    while todo.any():
        theta = np.where(todo, darts / np.maximum(total, 1e-300), -1.0)
        flat = np.full(n_docs * k, _EMPTY, dtype=np.uint64)
        level = 0
        while True:
            low = 2.0**level - 1
            heavy = np.flatnonzero((weight > low) & todo[doc])
            if len(heavy) == 0:
                break
            block = 0
            while True:
                begin = 0.0 if block == 0 else 2.0 ** (block - 1 - level)
                size = 2.0**-level if block == 0 else begin
                hit = heavy[theta[doc[heavy]] >= begin]
                if len(hit) == 0:
                    break
                element, across, along, dart = _throw(h[hit], level, block)
                element, rank = hit[element], begin + size * along
                kept = (low + across * 2.0**level < weight[element]) & (rank <= theta[doc[element]])
                element, rank, dart = element[kept], rank[kept].astype(np.float32), dart[kept]
                spread = tokens.mix(dart ^ np.uint64(3))
                value = (rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (spread & np.uint64(0xFFFFFFFF))
                place = doc[element] * k + ((spread >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
                np.minimum.at(flat, place, value)
                block += 1
            level += 1
        flat = flat.reshape(n_docs, k)
        full = todo & (flat != _EMPTY).all(axis=1)
        out[full] = flat[full]
        todo = todo & ~full
        darts *= 2.0
    return out


def _bags(column, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: range of rows, and (row in the slice, shingle, number) in order."""
    raw, offsets = tokens.utf8(column)
    for lo, hi in tokens.slices(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        doc, start, end = tokens.words(part, at)
        yield lo, hi, *tokens.counted(*tokens.shingles(doc, tokens.run_hash(part, start, end), n))


def _keys(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> list[bytes | None]:
    """128-bit key of each bag; None for an empty one."""
    halves = np.zeros((n, 2), dtype=np.uint64)
    number = count.astype(np.uint64)
    for j, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        np.add.at(halves[:, j], doc, tokens.mix(h ^ np.uint64(seed)) * (np.uint64(2) * number + np.uint64(1)) + tokens.mix(number + np.uint64(seed)))
    present = np.zeros(n, dtype=bool)
    present[doc] = True
    return [halves[i].tobytes() if present[i] else None for i in range(n)]


def _sketch(documents: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, fingerprint of the text, node (key of the bag), band hashes and sketch of every row.

    The sketch is the last byte of every coordinate: 125 bytes that estimate the similarity of two nodes.
    """
    factors = tokens.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salts = tokens.mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, doc, h, count in _bags(batch.column("_text"), SHINGLE):
                n = hi - lo
                sig = signatures(doc, h, count.astype(np.float64), n, bands * rows)
                hashes = tokens.mix((sig.reshape(n, bands, rows) * factors).sum(axis=2, dtype=np.uint64) + salts)
                low = np.ascontiguousarray((sig & np.uint64(255)).astype(np.uint8))
                flat = pa.array(hashes.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), flat)
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_th"), pa.array(_keys(doc, h, count, n), pa.binary()), lists,
                     pa.array([row.tobytes() for row in low], pa.binary())],
                    ["_id", "_th", "node", "bands", "sketch"],
                )

    source = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.lower(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, _th bigint, node binary, bands array<bigint>, sketch binary")


def _similar(pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose exact weighted Jaccard similarity reaches the bound, as (a, b)."""
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")]
            sizes = sum(pc.fill_null(pc.binary_length(x), 0).to_numpy() for x in sides)
            for lo, hi in tokens.slices(np.concatenate([[0], np.cumsum(sizes)])):
                n = hi - lo
                parts = [[], [], []]
                for first, _, row, h, count in _bags(pa.concat_arrays([x.slice(lo, n) for x in sides]), SHINGLE):
                    for box, x in zip(parts, ((row + first) % n, h, count), strict=True):
                        box.append(x)
                pair, h, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
                by = np.lexsort((h, pair))
                pair, h, count = pair[by], h[by], count[by]
                both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
                common = np.bincount(pair[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
                union = np.bincount(pair, weights=count, minlength=n) - common
                yield batch.slice(lo, n).select(["a", "b"]).filter(pa.array((den * common >= num * union) & (union > 0)))

    return pairs.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links among the pairs (a, b) of nodes; each node's text is fetched for the pairs that need it."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(_similar(both.select("a", "b", "text_a", "text_b"), similarity), "links")


def components(links: DataFrame) -> DataFrame:
    """node, comp: smallest node of the connected component of every linked node.

    Labels spread to the neighbours and are then replaced by the label of their label, so that the number of
    rounds grows with the logarithm of the longest chain. Each round is a written table.
    """
    ends = links.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")),
        F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"),
    )).alias("e")).select("e.*")
    edges = materialize(ends.distinct(), "edges")  # both ways, and each node with itself
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    while True:
        met = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("step"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("old")
        )
        up = labels.select(F.col("node").alias("step"), F.col("comp").alias("top"))
        new = materialize(met.join(up, "step").select("node", "old", F.least("step", "top").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where(F.col("old") != F.col("comp")).isEmpty():
            return labels


def _with_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components, with comp_a and comp_b."""
    out = pairs
    for side in ("a", "b"):
        names = labels.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
        out = out.join(names, side, "left").withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side))
    return out.where(F.col("comp_a") != F.col("comp_b"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted partition; a run may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if table.num_rows == 0:
            continue
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])
        for lo, hi in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield table.slice(lo, hi - lo)
        rest = table.slice(bounds[-2])
    if rest is not None and rest.num_rows:
        yield rest


def _likely(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each node outside the main component with the rows of the other side that may be linked to it.

    These are in another component, agree on at least SKETCH_SHARE of the coordinates, and have this bucket as the first one
    that both share, so that a pair is looked at once. Pairs of two nodes outside come once as well.
    """
    n = group.num_rows
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint8).reshape(n, -1)
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    side, stray = (group[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("outside", "stray"))
    comp, code, bucket = (group[c].to_numpy() for c in ("comp", "code", "bucket"))
    floor = SKETCH_SHARE * sketch.shape[1]
    right = np.flatnonzero(~side)
    for row in np.flatnonzero(side):
        other = right[(comp[right] != comp[row]) & (~stray[right] | (code[right] > code[row]))]
        if not len(other):
            continue
        other = other[(sketch[other] == sketch[row]).sum(axis=1) >= floor]
        equal = bands[other] == bands[row]
        first = bands[row][equal.argmax(axis=1)]
        other = other[equal.any(axis=1) & (first == bucket[row])]
        if len(other):
            yield int(row), other


def _between_components(shared: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All links between different components within buckets, found without writing out pairs.

    In every bucket that holds several components, the nodes outside its main component meet all nodes of the
    bucket, in blocks of bounded size. A first pass over sketches keeps the nodes that have a likely partner; a second
    one over their texts gives the links by exact similarity.
    """
    tagged = shared.join(labels, "node", "left").select("bucket", "node", F.xxhash64(F.coalesce("comp", "node")).alias("comp"))
    sizes = tagged.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("strays")
    ).where((F.col("strays") > 0) & (F.col("all") > 2))
    mixed = tagged.join(main, "bucket").withColumn("stray", F.col("comp") != F.col("main")).withColumn("code", F.xxhash64("node"))
    mixed = materialize(mixed.join(nodes.select("node", "bands", "sketch"), "node"), "mixed")
    blocks_out = F.ceil(F.col("strays") / BLOCK).cast("int")
    blocks_all = F.ceil(F.col("all") / BLOCK).cast("int")

    def dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
        own = F.pmod(F.col("code"), F.lit(1 << 40))
        as_outside = rows.where("stray").select(
            *columns, F.lit(True).alias("outside"), F.pmod(own, blocks_out).cast("int").alias("i"),
            F.explode(F.sequence(F.lit(0), blocks_all - 1)).alias("j"),
        )
        as_all = rows.select(
            *columns, F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), blocks_out - 1)).alias("i"),
            F.pmod(own, blocks_all).cast("int").alias("j"),
        )
        return as_outside.unionByName(as_all).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    keys = ["bucket", "i", "j"]
    num, den = similarity

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            rows: set[int] = set()
            for row, other in _likely(group):
                rows.update([row, *other.tolist()])
            if rows:
                yield group.select(["bucket", "node"]).take(sorted(rows)).combine_chunks().to_batches()[0]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            doc, h, count = (np.concatenate(x) for x in zip(*((d + lo, h, c) for lo, _, d, h, c in _bags(group["text"], SHINGLE)), strict=True))
            at = np.searchsorted(doc, np.arange(group.num_rows + 1))
            total = np.bincount(doc, weights=count, minlength=group.num_rows)
            left, right = [], []
            for row, other in _likely(group):
                mine, number = h[at[row] : at[row + 1]], count[at[row] : at[row + 1]]
                sizes = at[other + 1] - at[other]
                index = np.repeat(at[other] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                place = np.minimum(np.searchsorted(mine, h[index]), len(mine) - 1)
                both = np.where(mine[place] == h[index], np.minimum(number[place], count[index]), 0)
                common = np.add.reduceat(both, np.cumsum(sizes) - sizes)
                near = other[den * common >= num * (total[row] + total[other] - common)]
                left += [row] * len(near)
                right += near.tolist()
            if left:
                names = group["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(left)), names.take(pa.array(right))], ["a", "b"])

    columns = ["bucket", "node", "comp", "code", "stray", "bands", "sketch"]
    flagged = materialize(dealt(mixed, columns).mapInArrow(likely, "bucket bigint, node binary").distinct(), "likely")
    full = mixed.join(flagged, ["bucket", "node"], "left_semi").join(texts, "node")
    return materialize(dealt(full, [*columns, "text"]).mapInArrow(exact, "a binary, b binary").distinct(), "links")


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """_id, _th (fingerprint of the text), class_id and kept for every row.

    class_id is the smallest id of the class; kept marks the first (id, fingerprint) of a class.
    """
    sketch = materialize(_sketch(documents, id_col, text_col, bands, rows), "sketch")
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_th").alias("th"))
    nodes = materialize(
        sketch.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(rank).alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes"
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("a") != F.col("b"))
    met = materialize(members.join(sizes.select("bucket", "n"), "bucket"), "buckets")
    # A node in the middle of a group meets the most others over its bands.
    central = met.groupBy("node").agg(F.sum("n").alias("meets"))
    ranked = materialize(met.join(central, "node").select("bucket", "node", "meets"), "buckets")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("meets", "node"))["node"].alias("high"), F.min("node").alias("low"))
    shared = materialize(ranked.join(pivots, "bucket").select("bucket", "node", "low", "high"), "buckets")
    star = shared.select("node", F.explode(F.array("low", "high")).alias("pivot")).where(F.col("node") != F.col("pivot"))
    candidates = materialize(star.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n")), "candidates")

    wanted = candidates.select("node").distinct()
    holders = nodes.join(wanted.unionByName(candidates.select(F.col("pivot").alias("node")).distinct()).distinct(), "node", "left_semi")
    holders = holders.select("node", "rep.id", "rep.th", "rep.n")
    full = documents.select(
        F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("rep"),
        F.lower(text_col).alias("text"),
    )
    holders = holders.select("node", F.struct("n", "id", "th").alias("rep"))
    texts = materialize(full.join(holders, "rep").groupBy("node").agg(F.first("text").alias("text")), "texts")

    best = candidates.groupBy("node").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("pivot")).select(*_ordered(F.col("node"), F.col("pivot"))).distinct()
    best = materialize(best, "pairs")
    links = _verified(best, texts, similarity)
    labels = components(links)

    rest = candidates.select(*_ordered(F.col("node"), F.col("pivot"))).distinct().join(best, ["a", "b"], "left_anti")
    second = materialize(_with_components(rest, labels).select("a", "b"), "pairs")
    more = _verified(second, texts, similarity)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)

    last = _between_components(shared, nodes, labels, texts, similarity)
    if not last.isEmpty():
        labels = components(links.unionByName(last))

    named = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    heads = named.groupBy("comp").agg(F.min("rep").alias("head"))
    by_node = materialize(named.join(heads, "comp").select("node", "head"), "classes")
    out = sketch.select("_id", "_th", "node").join(by_node, "node", "left")
    own = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_th").alias("th"))
    head = F.coalesce("head", own)
    return out.select("_id", "_th", head["id"].alias("class_id"), (head == own).alias("kept"))


def keep_one_per_class(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: the first of each class stays, with all its columns.

    Rows that repeat id and text become one; texts without a word all stay.
    """
    kept = near_duplicates(documents, id_col, text_col, **options).where("kept").select("_id", "_th").distinct()
    key, mark = free_name(documents, "_key"), free_name(documents, "_mark")
    keyed = documents.withColumn(key, F.struct(F.col(id_col))).withColumn(mark, F.xxhash64(text_col))
    kept = kept.select(F.struct("_id").alias(key), F.col("_th").alias(mark))
    return keyed.join(kept, [key, mark], "left_semi").dropDuplicates([key, mark]).select(*documents.columns)
