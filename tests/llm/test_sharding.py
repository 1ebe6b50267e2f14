from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from panelstress.llm import sharding

COLUMNS = "doc_id bigint, text string, lang string, source string, size string, shard int, h string"


def _hex(s, first, n):
    return int(hashlib.md5(s.encode()).hexdigest()[first : first + n], 16)


def brute_force(rows, shards):
    """The same tree by sorting whole nodes. rows: (id, text, lang, source)."""
    keyed = []
    for i, t, lang, source in rows:
        h = _hex(t or "", 0, 15)
        own = f"{'' if i is None else i}:{h}"
        keyed.append((i, t or "", h, len((t or "").encode()) + 8, _hex(own, 0, 4), _hex(own, 4, 4), lang, source))
    groups = defaultdict(list)
    for r in keyed:
        groups[r[2]].append(r)
    all_bytes, all_rows, parts = sum(r[3] for r in keyed), len(keyed), 256 * shards
    atoms, piece_of = [], {}
    for h, members in groups.items():
        share = max(sum(r[3] for r in members) * parts / all_bytes, len(members) * parts / all_rows)
        bits = min(int(share).bit_length(), 16) if share > 1 else 0
        meta = [min((r[k] for r in members if r[k] is not None), default=None) for k in (6, 7)]
        size = members[0][3]
        power = size.bit_length() - 1
        at = [0 if m is None else _hex(m, 0, 4) >> 1 for m in meta] + [power * 512 + (size - 2**power) * 512 // 2**power]
        weights = Counter()
        for r in members:
            piece = r[4] >> (16 - bits)
            weights[piece] += r[3]
            piece_of[id(r)] = (h, piece)
        atoms += [(h, p, w, at) for p, w in weights.items()]
    full = [max(max(a[3][d] for a in atoms) - min(a[3][d] for a in atoms), 1) for d in range(3)]
    shard_of = {}

    def cut(node, first, leaves):
        if leaves == 1 or not node:
            shard_of.update({(a[0], a[1]): first for a in node})
            return
        width = [(max(a[3][d] for a in node) - min(a[3][d] for a in node)) / full[d] for d in range(3)]
        d = width.index(max(width))
        key = lambda a: a[3][d] << 48 | (a[0] >> 28) << 16 | a[1]
        by_key = Counter()
        for a in node:
            by_key[key(a)] += a[2]
        goal, upto, at = -(-sum(by_key.values()) * (leaves // 2) // leaves), 0, None
        for at in sorted(by_key):
            upto += by_key[at]
            if upto >= goal:
                break
        cut([a for a in node if key(a) <= at], first, leaves // 2)
        cut([a for a in node if key(a) > at], first + leaves // 2, leaves - leaves // 2)

    cut(atoms, 0, shards)
    inside = defaultdict(list)
    for r in keyed:
        inside[shard_of[piece_of[id(r)]]].append(r)
    out = []
    for shard, members in inside.items():
        members.sort(key=lambda r: (r[5] >> 4, r[5], r[0] is not None, r[0] or 0, r[2]))
        out += [(r[0], r[3], zlib.crc32(r[1].encode()), shard, slot) for slot, r in enumerate(members)]
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], COLUMNS)
    return sorted((tuple(r) for r in sharding.kd_shards(df, **how).collect()), key=str)


@pytest.fixture(scope="module")
def corpus(odd_texts):
    rng = random.Random(3)
    rows = [(i, t, None, "s") for i, t in odd_texts if t is None or len(t) < 10_000]
    rows += [(i, f"{i} " * rng.randrange(1, 60), rng.choice(["en", "fr", None]), f"src{rng.randrange(6)}") for i in range(10, 500)]
    rows += [(i, "one large group of copies " * 3, rng.choice(["en", "fr"]), f"src{i % 7}") for i in range(500, 900)]
    return rows


def test_tree_and_slots_equal_brute_force(spark, corpus):
    for shards in (24, 5):
        assert run(spark, corpus, shards=shards) == brute_force(corpus, shards)


def test_sizes_are_near_equal_copies_stay_together_and_slots_have_no_gaps(spark, corpus):
    got = run(spark, corpus, shards=6)
    sizes, slots = Counter(), defaultdict(list)
    for _, size, _, shard, slot in got:
        sizes[shard] += size
        slots[shard].append(slot)
    mean = sum(sizes.values()) / 6
    assert len(sizes) == 6 and max(abs(v - mean) for v in sizes.values()) < 0.1 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = defaultdict(set)
    for i, _, crc, shard, _ in got:
        where[crc].add(shard)
    torn = [crc for crc, s in where.items() if len(s) > 1]
    assert all(crc == zlib.crc32(("one large group of copies " * 3).encode()) for crc in torn)


def test_target_bytes_gives_the_number_of_shards(spark, corpus):
    total = sum(len((t or "").encode()) + 8 for _, t, _, _ in corpus)
    got = run(spark, corpus, target_bytes=total // 3 - 1)
    assert {r[3] for r in got} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        run(spark, corpus)


def test_odd_tables(spark):
    assert run(spark, [], shards=24) == []
    same = [(1, "a", None, None)] * 5
    assert run(spark, same, shards=3) == brute_force(same, 3)
    nulls = [(None, None, None, None), (None, "", "en", None), (2, None, None, "s")]
    assert run(spark, nulls, shards=24) == brute_force(nulls, 24)
    long = [(1, "w " * 400_000, "en", "s"), *[(i, f"t{i}", "en", "s") for i in range(2, 40)]]
    assert run(spark, long, shards=4) == brute_force(long, 4)
