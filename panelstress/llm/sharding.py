"""Shards of near equal bytes from a k-d tree over the documents' metadata.

A node of the tree that still needs several shards is cut along its widest dimension of metadata at the weighted median:
at the place that gives each side bytes in proportion to its number of shards. The cutting goes on until every leaf is one shard
of about the target bytes. Documents with like metadata thus stand in the same shard or in neighbouring ones.

The points of the tree are groups of equal texts, with the metadata of the group's smallest values, so that copies stay together.
A group that holds more than 1/256 of a shard, in bytes or in rows, is dealt to pieces of at most about that size by a hash
of the id; pieces are points of their own that lie side by side. No point is cut, so a cut is off by less than one point.

The order along a dimension is (coordinate, hash of the text, piece), one 63-bit number. The median's number is found digit
by digit: histograms of 2^16 digits per node, of the points that share the digits found so far, combined before the shuffle. All
nodes of a level are cut in one job; nothing is sorted as a whole, and what a window orders is bounded by 2^16 digits.
The cuts of a level are a written table of at most as many rows as there are shards; points find their node through a broadcast of it.

Dimensions: every named column by a 15-bit code of its value (equal values share it), and the length of the text on an integer
scale of 512 steps per doubling. The width of a dimension in a node is its range over its range in the whole table.

Slots number the rows of a shard without gaps: rows are dealt to 4,096 buckets of their shard by a hash, numbered inside
the bucket, and shifted by the number of rows in the buckets before.

Defined results: null and empty texts have 8 bytes and are equal texts; a null id or null metadata is a value of its own; repeated
rows are copies, each with a slot of its own; a text larger than a shard is a shard's whole content or its overweight;
fewer points than shards leave shards without rows; an empty table gives an empty one; clashing columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstress.session import materialize

#: Bytes of a row besides its text.
ROW_BYTES = 8
#: Parts of a shard above which a group of equal texts is dealt to pieces.
PIECES_PER_SHARD = 256
#: Rows up to which a table of bounded size is sent to every task; beyond, joins are left to the optimiser.
BROADCAST_ROWS = 1_000_000
SLOT_BUCKETS = 4_096
_DIGIT = 16


def _hex(text: Column, first: int, digits: int) -> Column:
    """Number made of some hexadecimal digits."""
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def _code(value: Column) -> Column:
    """15-bit code of a value; null is 0."""
    code = F.shiftright(_hex(F.md5(value.cast("string")), 1, 4), 1)
    return F.coalesce(code, F.lit(0)).cast("int")


def _length_code(size: Column) -> Column:
    """Monotone integer scale with 512 steps per doubling."""
    power = F.length(F.bin(size)) - 1
    one = F.expr("shiftleft(1L, length(bin(size)) - 1)")
    return (power * 512 + F.floor((size - one) * 512 / one)).cast("int")


def keyed_rows(documents: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    """Ids, sizes, hashes and metadata without the texts, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = _hex(F.md5(text), 1, 15)
    own = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), h))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        h.alias("h"),
        _hex(own, 1, 4).cast("int").alias("deal"),
        _hex(own, 5, 4).cast("int").alias("bucket"),
        *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(metadata)],
    )
    return materialize(rows, "shard-rows")


def _bounded(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose number of rows is bounded by ``rows``, when that bound is small."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def points(rows: DataFrame, shards: int, total: tuple[int, int], metadata: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their piece, points): a point is a group of equal texts or a piece of a large one.

    Groups above a share of 1/(256 shards) in bytes or rows are at most 2 * 256 * shards in number.
    """
    parts = PIECES_PER_SHARD * shards
    all_bytes, all_rows = max(total[0], 1), max(total[1], 1)
    groups = materialize(
        rows.groupBy("h").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"),
            *[F.min(f"m{i}").alias(f"m{i}") for i in range(metadata)],
        ),
        "shard-groups",
    )
    share = F.greatest(F.expr(f"bytes * {parts}D / {all_bytes}D"), F.expr(f"n * {parts}D / {all_rows}D"))
    bits = F.least(F.length(F.bin(F.floor(share).cast("long"))), F.lit(_DIGIT))
    large = groups.where(share > 1).select("h", bits.cast("int").alias("bits"))
    dealt = rows.join(_bounded(large, 2 * parts), "h", "left").withColumn(
        "piece", F.when(F.col("bits").isNull(), F.lit(0)).otherwise(F.expr(f"shiftright(deal, {_DIGIT} - bits)"))
    )
    coordinates = F.array(*[_code(F.col(f"m{i}")) for i in range(metadata)], _length_code(F.col("size")))
    coded = groups.select("h", "bytes", share.alias("share"), coordinates.alias("at"))
    whole = coded.where("share <= 1").select("h", F.lit(0).alias("piece"), "bytes", "at")
    pieces = dealt.where("bits IS NOT NULL").groupBy("h", "piece").agg(F.sum("size").alias("bytes"))
    # At most two pieces for every part of the bytes or rows.
    cut = pieces.join(coded.where("share > 1").select("h", "at"), "h").select("h", "piece", "bytes", "at")
    return dealt.drop("bits"), materialize(whole.unionByName(cut), "shard-points")


def _key(dimension: Column) -> Column:
    """Place of a point along a dimension."""
    coordinate = F.shiftleft(F.element_at("at", dimension + 1).cast("long"), 3 * _DIGIT)
    text = F.shiftleft(F.shiftright("h", 60 - 2 * _DIGIT), _DIGIT)
    return coordinate.bitwiseOR(text).bitwiseOR(F.col("piece").cast("long"))


#: Bytes that the left side is to reach, leaves div 2 of its shards, rounded up; no product of two large numbers.
_GOAL = "(total div leaves) * (leaves div 2) + ((total % leaves) * (leaves div 2) + leaves - 1) div leaves"


def cut_level(state: DataFrame, ranges: list[int]) -> DataFrame:
    """Cuts of all nodes that need more than one shard: (node, dimension, cut, left)."""
    open_points = state.where("leaves > 1")
    axes = F.explode(F.array(*[
        F.struct(F.lit(i).alias("dimension"), F.element_at("at", i + 1).cast("long").alias("digit"), F.lit(max(r, 1)).alias("full"))
        for i, r in enumerate(ranges)
    ]))
    counts = (
        open_points.select("node", "leaves", "bytes", axes.alias("x")).select("node", "leaves", "bytes", "x.*")
        .groupBy("node", "leaves", "dimension", "full", "digit").agg(F.sum("bytes").alias("bytes"))
    )
    axis = Window.partitionBy("node", "dimension")
    running = counts.withColumns({
        "total": F.sum("bytes").over(axis),
        "upto": F.sum("bytes").over(axis.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)),
    }).withColumn("goal", F.expr(_GOAL))
    first = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct(F.col("digit").alias("prefix"), (F.col("upto") - F.col("bytes")).alias("below"))))
    medians = running.groupBy("node", "leaves", "dimension", "full", "goal").agg(
        first.alias("at"), (F.max("digit") - F.min("digit")).alias("width")
    )
    widest = F.struct((F.col("width") / F.col("full")).alias("w"), (-F.col("dimension")).alias("d"))
    cuts = medians.groupBy("node", "leaves", "goal").agg(F.max_by(F.struct("dimension", "at.prefix", "at.below"), widest).alias("c")).select(
        "node", "goal", "c.*"
    )
    for shift in (2 * _DIGIT, _DIGIT, 0):
        near = open_points.drop("leaves").join(F.broadcast(cuts), "node")  # one row per node
        key = _key(F.col("dimension"))
        digits = (
            near.where(F.shiftright(key, shift + _DIGIT) == F.col("prefix"))
            .groupBy("node", "goal", "dimension", "prefix", "below", F.shiftright(key, shift).bitwiseAND((1 << _DIGIT) - 1).alias("digit"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        node = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        upto = digits.withColumn("upto", F.col("below") + F.sum("bytes").over(node))
        cuts = upto.where("upto >= goal").groupBy("node", "goal", "dimension").agg(
            F.min(F.struct("digit", "prefix", (F.col("upto") - F.col("bytes")).alias("below"))).alias("c")
        ).select("node", "goal", "dimension", (F.shiftleft("c.prefix", _DIGIT) + F.col("c.digit")).alias("prefix"), "c.below")
    return cuts.select("node", "dimension", F.col("prefix").alias("cut"))


def kd_tree(atoms: DataFrame, shards: int, dimensions: int) -> DataFrame:
    """Points with their leaf: (h, piece, shard). A node is named by its first shard."""
    ends = [(f(F.element_at("at", i + 1))) for i in range(dimensions) for f in (F.min, F.max)]
    spans = atoms.agg(*[c.alias(f"e{i}") for i, c in enumerate(ends)]).first()
    ranges = [(spans[2 * i + 1] or 0) - (spans[2 * i] or 0) for i in range(dimensions)]
    state = atoms.withColumns({"node": F.lit(0), "leaves": F.lit(shards)})
    for level in range((shards - 1).bit_length()):
        cuts = materialize(cut_level(state, ranges), f"shard-cuts-{level}")  # at most one row per shard
        left = F.floor(F.col("leaves") / 2).cast("int")
        right = F.col("cut").isNotNull() & (_key(F.col("dimension")) > F.col("cut"))
        state = state.join(_bounded(cuts, shards), "node", "left").select(
            "h", "piece", "bytes", "at",
            F.when(right, F.col("node") + left).otherwise(F.col("node")).alias("node"),
            F.when(F.col("cut").isNull(), F.col("leaves")).when(right, F.col("leaves") - left).otherwise(left).alias("leaves"),
        )
    return state.select("h", "piece", F.col("node").alias("shard"))


def number_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Gapless numbers from 0 per shard; no window is larger than a bucket."""
    small = F.shiftright("bucket", _DIGIT - (SLOT_BUCKETS - 1).bit_length())
    written = materialize(rows.withColumn("slots", small), "shard-assigned")
    before = Window.partitionBy("shard").orderBy("slots").rowsBetween(Window.unboundedPreceding, -1)
    counts = written.groupBy("shard", "slots").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "slots", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "slots").orderBy("bucket", "doc_id", "h")
    numbered = written.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(_bounded(offsets, shards * SLOT_BUCKETS), ["shard", "slots"]).withColumn("slot", F.col("offset") + F.col("place"))


def kd_shards(
    documents: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, shard, slot.

    Either the number of shards is given, or the bytes that a leaf is to reach, which give their number.
    """
    rows = keyed_rows(documents, id_col, text_col, metadata)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("shards or target_bytes must be given")
        shards = max(1, -(-total[0] // target_bytes))
    dealt, atoms = points(rows, shards, (total[0], total[1]), len(metadata))
    assigned = dealt.join(kd_tree(atoms, shards, len(metadata) + 1), ["h", "piece"]).select("doc_id", "size", "text_crc32", "h", "bucket", "shard")
    return number_slots(assigned, shards).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
