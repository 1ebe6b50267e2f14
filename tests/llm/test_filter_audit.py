from __future__ import annotations

import itertools
import random
import re
from collections import Counter

from panelstress.llm import filter_audit as fa

LABELS = "doc_id bigint, quality bigint, toxic bigint"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, doc_id, smallest):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and smallest is not None and doc_id > smallest,
    }


def brute_force(rows, labels):
    """rows: (id, text, part); every order applied document by document."""
    smallest, marks = {}, {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    for i, q, x in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], int(q == 1)), max(old[1], int(x == 1)))
    docs = [(p or "", fails(t or "", i, smallest.get(t or "")), marks.get(i, (0, 0)) if i is not None else (0, 0)) for i, t, p in rows]
    out = []
    for part in sorted({p for p, _, _ in docs}):
        mine = [(f, m) for p, f, m in docs if p == part]
        shapley, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                failing = sum(f[x] for f, _ in mine)
                only = sum(f[x] and sum(f.values()) == 1 for f, _ in mine)
                shapley[x] += len(gone)
                lines.append(["".join(order), step, len(left), len(gone), failing - len(gone), only, sum(m[0] for _, m in gone), sum(m[1] for _, m in gone), x])
        out += [(part, *line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, 0, "s") for i, t, p in rows], "doc_id bigint, text string, lang string, mask int, part string")
    got = fa.audit(fa.failure_masks(docs, spark.createDataFrame(labels, LABELS)), fa.FILTERS)
    return sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())


def test_steps_equal_brute_force(spark, odd_texts):
    rng = random.Random(5)
    rows = [(i, t, None) for i, t in odd_texts]
    for i in range(20, 90):
        n = rng.choice([0, 3, 150, 199, 200, 260])
        words = [rng.choice(["a", "Bc", "d#", "é", "x%", "Hello"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(n)]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words), rng.choice(["en", "fr", None, ""])))
    rows += [(i + 100, t, "fr") for i, t, _ in rows[8:30]] + [(7, rows[40][1], "en"), (None, rows[40][1], "en"), (7, rows[40][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(20, 1, 1), (None, 1, 1)]
    assert run(spark, rows, labels) == brute_force(rows, labels)


def test_one_large_group_of_copies_and_empty_tables(spark):
    rows = [(i, "same text", "en") for i in range(500)] + [(500, "other", "de")]
    assert run(spark, rows, []) == brute_force(rows, [])
    assert run(spark, [], [(1, 1, 1)]) == []


def test_swaps_meet_every_order_once_and_keep_the_function():
    for n in (1, 2, 3, 5):
        rng = random.Random(n)
        weights = {m: (rng.randrange(3), rng.randrange(2)) for m in range(1 << n)}
        diagram = fa.Diagram(weights, n, 2)
        seen = []
        for path in fa.every_order(diagram):
            order = [bit for bit, _, _ in path]
            seen.append(tuple(order))
            for k, (bit, passed, failed) in enumerate(path):
                before = sum(1 << b for b in order[:k])
                alive = [m for m in weights if not m & before]
                assert passed == tuple(sum(weights[m][j] for m in alive if not m >> bit & 1) for j in range(2))
                assert failed == tuple(sum(weights[m][j] for m in alive if m >> bit & 1) for j in range(2))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_equal_sub_diagrams_are_shared():
    diagram = fa.Diagram({m: (1,) for m in range(32)}, 5, 1)
    assert len(diagram.weight) == 6  # one node per level and one leaf
    assert diagram.weight[diagram.root] == (32,)
