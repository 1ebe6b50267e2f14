"""Benchmark decontamination by template windows.

Texts become templates: numbers, names (capitalised words inside a sentence) and units turn into typed placeholders,
other words into their lower-cased letters. Windows of template words are hashed and joined between benchmark items and
documents; of windows with more placeholders than words the values are hashed too, so that these meet only as they stand. What stands in the placeholders is then compared along each alignment: a value of the item has to meet one
value of the document, and the other way round; windows with a slot against that map fall out, unless they are the
item's own words throughout. That catches questions asked again with other numbers or names, while chance meetings of
placeholders fall out.

The corpus side emits only windows whose hash is set in a bitmap of fixed size made from the benchmark, whatever
its size; the join itself is left to Spark.

Defined results: null, empty and short texts (fewer words than any window) match nothing; items of fewer than four words
cannot be told from chance and are not searched for; rows that repeat id and text count as one document; null
document ids are reported with a null id; an empty table on either side gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.llm import tokens
from panelstress.llm.common import free_name
from panelstress.session import materialize

WINDOW = 8
#: Items shorter than a window are searched for as a whole, down to this number of words.
SHORTEST = 4
#: Share of an item's windows that must be found.
COVERAGE = 0.5
BITMAP_BITS = 1 << 24

UNITS = (
    "mm cm m km inch inches foot feet mile miles g kg mg gram grams kilogram kilograms lb pound pounds ounce ounces "
    "ml l litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years "
    "euro euros dollar dollars cent cents percent degree degrees volt volts watt watts metre metres meter meters"
).split()

_KEPT = np.zeros(256, dtype=bool)
_KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:"]] = True
# What may stand between a stop and the next sentence: white space, quotes, brackets and marks of emphasis.
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in " \t\n\v\f\r\"')]}>*_"]] = True
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def _lower(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    after = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[after] += 32
    return out


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer("".join(UNITS).encode(), dtype=np.uint8)
    end = np.cumsum([len(u) for u in UNITS])
    return np.sort(tokens.run_hash(joined, np.concatenate([[0], end[:-1]]), end))


def _significant(raw: np.ndarray) -> np.ndarray:
    """Place of the last byte before each place that is neither white space nor closes a quote or bracket."""
    skip = _CLOSING[raw]
    if len(raw) > 2:  # ’ ” and ›, and »
        three = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & np.isin(raw[2:], [0x99, 0x9D, 0xBA]))
        two = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xBB))
        for at in (three, three + 1, three + 2, two, two + 1):
            skip[at] = True
    return np.concatenate([[0], np.maximum.accumulate(np.where(skip, 0, np.arange(len(raw))))])


def canonical(raw: np.ndarray, offsets: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, template hash and value hash (0 for literal words) of every word with a letter or digit.

    With ``inside`` a text's first word is read as one inside a sentence: a name if it is capitalised.
    """
    doc, start, end = tokens.words(raw, offsets)
    kept = _KEPT[raw]
    before = np.concatenate([[0], np.cumsum(kept)])
    first, last = before[start], before[end]
    solid = np.flatnonzero(last > first)
    doc, start, end, first, last = (x[solid] for x in (doc, start, end, first, last))
    if len(doc) == 0:
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    value = tokens.run_hash(_lower(raw)[kept], first, last)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    number = digits[end] > digits[start]
    lead = np.flatnonzero(kept)[first]
    upper = ((raw[lead] >= 65) & (raw[lead] <= 90)) | (
        (raw[lead] == 0xC3) & (np.append(raw, 0)[lead + 1] >= 0x80) & (np.append(raw, 0)[lead + 1] <= 0x9E)
    )
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    stopped = np.concatenate([[False], _STOP[raw[_significant(raw)[start[1:]]]]])
    opening = (stopped & ~fresh) | (fresh & (not inside))
    small = (raw >= 97) & (raw <= 122)
    small[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0xA0) & (raw[1:] <= 0xBF)
    lower = np.concatenate([[0], np.cumsum(small)])
    name = upper & ~opening & ~number & (lower[end] > lower[start])  # words all in capitals stay literal
    units = _unit_hashes()
    known = units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value
    unit = known & np.concatenate([[False], number[:-1] & (doc[1:] == doc[:-1])]) & ~number
    slot = number | name | unit
    template = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return doc, template, np.where(slot, value, np.uint64(0))


def _windows_of(doc, template, value, size: int, whole: bool, bitmap, first_only: bool = False) -> tuple[np.ndarray, ...]:
    n = len(doc) - size + 1
    factors = tokens.mix(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    h = np.full(n, size, dtype=np.uint64)
    exact = np.zeros(n, dtype=np.uint64)
    slots = np.zeros(n, dtype=np.int64)
    for j in range(size):
        h += template[j : n + j] * factors[j]
        exact += value[j : n + j] * factors[j]
        slots += value[j : n + j] != 0
    # A template of mostly placeholders says little; such windows meet by the values beside it.
    rich = 2 * slots > size
    h = tokens.mix(np.where(rich, h + tokens.mix(exact), h))
    good = doc[:n] == doc[size - 1 :]
    fresh = np.concatenate([[-1], doc[: n - 1]]) != doc[:n]
    if whole:  # texts of exactly this length
        good &= fresh & (np.append(doc, -1)[size:] != doc[:n])
    if first_only:
        good &= fresh
    if bitmap is not None:
        bit = h >> np.uint64(40)
        good &= (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    at = np.flatnonzero(good)
    values = np.zeros((len(at), WINDOW), np.uint64)
    for j in range(size):
        values[:, j] = value[at + j]
    return doc[at], at - np.searchsorted(doc, doc[at], "left"), h[at], values, rich[at]


def windows(raw: np.ndarray, offsets: np.ndarray, sizes=None, bitmap: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Document, place, hash, values (padded with 0) and richness (more than half are placeholders) of all windows.

    With ``sizes`` all windows of these lengths; without, those of WINDOW words, and shorter texts whole, and the first
    window of a text under both readings of its first word, since a text may stand inside a sentence or after a title.
    """
    words = canonical(raw, offsets)
    jobs = [(n, False) for n in sizes] if sizes is not None else [(WINDOW, False)] + [(n, True) for n in range(SHORTEST, WINDOW)]
    parts = [_windows_of(*words, n, whole, bitmap) for n, whole in jobs if n <= len(words[0])]
    if sizes is None:
        other = canonical(raw, offsets, inside=True)
        parts += [_windows_of(*other, n, whole, bitmap, first_only=True) for n, whole in jobs if n <= len(other[0])]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, WINDOW), np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _window_rows(frame: DataFrame, id_col: str, text_col: str, sizes=None, bits=None) -> DataFrame:
    """key, fp (fingerprint of the text), place, h, values and rich of the windows of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value if bits is not None else None
        for batch in batches:
            raw, offsets = tokens.utf8(batch.column("_text"))
            for lo, hi in tokens.slices(offsets):
                doc, place, h, values, rich = windows(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], sizes, bitmap)
                flat = pa.array(values.reshape(-1).view(np.int64))
                ends = pa.array(np.arange(0, len(doc) * WINDOW + 1, WINDOW, dtype=np.int32))
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(take), batch.column("fp").take(take), pa.array(place, pa.int64()),
                     pa.array(h.view(np.int64)), pa.ListArray.from_arrays(ends, flat), pa.array(rich, pa.bool_())],
                    ["key", "fp", "place", "h", "values", "rich"],
                )

    source = frame.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("_text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, fp bigint, place bigint, h bigint, values array<bigint>, rich boolean")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words of texts that are shorter than a window, but not too short."""
    for batch in batches:
        doc, _, _ = canonical(*tokens.utf8(batch.column("t")))
        n = np.bincount(doc, minlength=1)
        yield pa.RecordBatch.from_arrays([pa.array(n[(n >= SHORTEST) & (n < WINDOW)], pa.int32())], ["n"])


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of all window hashes of the benchmark; at most BITMAP_BITS / 64 rows reach the driver."""
    bit = F.call_function("shiftrightunsigned", F.col("h"), F.lit(40))
    parts = (
        items.select(F.call_function("shiftrightunsigned", bit, F.lit(6)).alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITMAP_BITS // 64, dtype=np.uint64)
    out[parts["w"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return out


def consistent(found: list[tuple[int, list[tuple[int, int]]]]) -> list[int]:
    """Numbers of the windows of one alignment that keep to a one-to-one map of the item's values to the document's.

    The map takes the pairs that most windows hold, the first of equals first. A window falls out for a slot against the
    map, unless all its values are the item's own.
    """
    if all(i == d for _, pairs in found for i, d in pairs):
        return list(range(len(found)))
    held: dict[tuple[int, int], list[int]] = {}
    for at, pairs in found:
        for pair in set(pairs):
            held.setdefault(pair, []).append(at)
    taken_item, taken_doc, good = set(), set(), set()
    for i, d in sorted(held, key=lambda p: (-len(held[p]), min(held[p]), p)):
        if i not in taken_item and d not in taken_doc:
            taken_item.add(i)
            taken_doc.add(d)
            good.add((i, d))
    return [n for n, (_, pairs) in enumerate(found) if all(p in good for p in pairs) or all(i == d for i, d in pairs)]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the consistent windows of every alignment, and whether one of them holds other values than the item."""
    for batch in batches:
        places, templates, changed = [], [], []
        for found in batch.column("found"):
            rows = [(w["at"], [(p["i"], p["d"]) for p in w["pairs"]]) for w in found.as_py()]
            good = consistent(rows)
            places.append([rows[n][0] for n in good])
            templates.append([rows[n][0] for n in good if not found[n]["rich"].as_py()])
            changed.append(any(i != d for n in good for i, d in rows[n][1]))
        columns = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays(
            [*columns, *(pa.array(x, pa.list_(pa.int64())) for x in (places, templates)), pa.array(changed, pa.bool_())],
            [*batch.schema.names[:-1], "places", "templates", "changed"],
        )


def leaks(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and item that it holds: id, fp, item, n_found, n_windows, changed (other values in slots)."""
    items = materialize(_window_rows(benchmark, item_col, item_text_col), "items")
    # Lengths of items that are windows as a whole: at most WINDOW - SHORTEST values besides WINDOW itself.
    lengths = benchmark.select(F.col(item_text_col).alias("t")).where("t IS NOT NULL").mapInArrow(_lengths, "n int").distinct()
    sizes_in_use = sorted({WINDOW} | {r.n for r in lengths.collect()})
    bits = documents.sparkSession.sparkContext.broadcast(_bitmap(items))
    sizes = items.groupBy(F.col("key").alias("item"), F.col("fp").alias("item_fp")).agg(
        F.countDistinct("place").alias("n_windows"), F.countDistinct(F.expr("CASE WHEN NOT rich THEN place END")).alias("n_templates")
    )
    found = _window_rows(documents, id_col, text_col, sizes_in_use, bits).drop("rich")
    wanted = items.select(
        "h", F.col("key").alias("item"), F.col("fp").alias("item_fp"), F.col("place").alias("item_place"), F.col("values").alias("item_values"), "rich"
    ).distinct()
    joined = found.join(wanted, "h").withColumn("shift", F.col("place") - F.col("item_place"))
    keys = ["key", "fp", "item", "item_fp"]
    pairs = F.filter(F.arrays_zip(F.col("item_values").alias("i"), F.col("values").alias("d")), lambda v: v["i"] != 0)
    # One row per alignment; it holds at most one window per place of the item, however often the rows repeat.
    runs = joined.groupBy(*keys, "shift").agg(F.collect_set(F.struct(F.col("item_place").alias("at"), pairs.alias("pairs"), "rich")).alias("found"))
    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in keys)
    judged = runs.select(*keys, "found").mapInArrow(_judge, f"{kinds}, places array<bigint>, templates array<bigint>, changed boolean")

    def same(left: DataFrame, right: DataFrame, on: list[str]):
        return [left[c].eqNullSafe(right[c]) for c in on]

    number = {c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))) for c in ("places", "templates")}
    per_item = judged.groupBy(*keys).agg(
        number["places"].alias("n_found"), number["templates"].alias("found_templates"), F.max("changed").alias("changed")
    )
    # Windows rich in placeholders are found as they stand only, so a question asked anew is judged by the others.
    enough = (F.col("n_found") >= F.lit(coverage) * F.col("n_windows")) | (
        (F.col("n_templates") > 0) & (F.col("found_templates") >= F.lit(coverage) * F.col("n_templates"))
    )
    out = per_item.join(sizes, same(per_item, sizes, ["item", "item_fp"])).where((F.col("n_found") > 0) & enough)
    return out.select(
        F.col("key").alias(id_col), per_item["fp"], per_item["item"].alias(item_col), F.col("n_found").cast("long").alias("n_found"),
        F.col("n_windows").cast("long").alias("n_windows"), "changed",
    )


def drop_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    key = free_name(documents, "_key")
    bad = leaks(documents, benchmark, id_col, text_col, **options).select(F.struct(F.col(id_col).alias("id"), F.col("fp")).alias(key)).distinct()
    keyed = documents.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp")))
    return keyed.join(bad, key, "left_anti").select(*documents.columns)
