from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from panelstress.llm import dart_minhash as near


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(texts: dict) -> dict:
    bags, parent = {k: bag(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and bags[a] and similarity(bags[a], bags[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = a.copy()
    b[:60] = rng.integers(0, 2**63, 60)
    wa, wb = rng.integers(1, 9, 600).astype(float), rng.integers(1, 9, 600).astype(float)
    sig = near.signatures(np.repeat([0, 1, 2], [600, 600, 1]), np.concatenate([a, b, a[:1]]), np.concatenate([wa, wb, [1.0]]), 4, 2000)
    exact = np.minimum(wa, wb)[60:].sum() / (np.maximum(wa, wb)[60:].sum() + wa[:60].sum() + wb[:60].sum())
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.045
    assert (sig[2] != near._EMPTY).all() and (sig[3] == near._EMPTY).all()


def test_classes_equal_brute_force_with_a_large_group(spark, docs_of):
    """A base with many edited copies of which some are linked only through others, besides unrelated texts."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    texts = {}
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts[i] = " ".join(copy)
    texts |= {200 + i: " ".join(rng.choice(words) for _ in range(60)) for i in range(20)}
    texts |= {300: texts[205], 301: texts[205].upper(), 302: "short one", 303: "short one", 304: "", 305: None}
    got = {r["_id"]: r.class_id for r in near.near_duplicates(docs_of(list(texts.items()))).collect()}
    assert got == classes(texts)


def test_odd_rows(docs_of, odd_texts):
    df = docs_of(odd_texts).withColumnRenamed("source", "node").withColumnRenamed("lang", "_key")
    kept = near.keep_one_per_class(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(set(odd_texts), key=str)
    assert near.keep_one_per_class(df.limit(0)).count() == 0


@pytest.mark.parametrize("chain", [2, 9])
def test_components_of_a_chain(spark, chain):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(chain)], "a binary, b binary")
    assert {bytes(r.comp) for r in near.components(links).collect()} == {b"\x00"}
