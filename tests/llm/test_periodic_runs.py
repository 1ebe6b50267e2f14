from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelstress.llm import periodic_runs as pr


def brute_runs(w, min_words=12):
    """Every period by scanning for stretches of w[i] == w[i + q]."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k > i and k - i + q >= max(min_words, 2 * q):
                found.setdefault((i, k + q), q)  # the smallest period comes first
            i = k + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def grammar_runs(texts, min_words=12):
    n, offsets, runs, collapsed = pr._slice_runs([" ".join(t).encode() for t in texts], min_words)
    rows = list(zip(*[c.tolist() for c in runs]))
    return [rows[offsets[i] : offsets[i + 1]] for i in range(len(texts))], [c.decode() for c in collapsed]


def collapse(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def texts_of_many_kinds():
    rng = random.Random(11)
    fib = ["a", "b"]
    while len(fib) < 900:
        fib = fib + fib[: len(fib) * 610 // 987 + 1]
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 700, ["a", "b"] * 300, fib, ["x"] + ["a"] * 40 + ["y"], list("abc") * 4, list("abcdefghijk") * 3]
    word, other = ["a"], ["a", "b"]
    for _ in range(12):
        word, other = other, other + word
    out.append(word[:600])
    for _ in range(60):
        size, letters = rng.randrange(0, 160), rng.choice([1, 2, 3, 8])
        w = [chr(97 + rng.randrange(letters)) for _ in range(size)]
        for _ in range(rng.randrange(4)):
            at, q, times = rng.randrange(len(w) + 1), rng.randrange(1, 15), rng.randrange(2, 6)
            w[at:at] = [chr(97 + rng.randrange(letters)) for _ in range(q)] * times
        out.append(w)
    return out + out[-5:]


def test_runs_and_collapsed_texts_equal_brute_force():
    texts = texts_of_many_kinds()
    runs, collapsed = grammar_runs(texts)
    for w, got, text in zip(texts, runs, collapsed):
        assert got == brute_runs(w)
        assert text == collapse(w, got)
    for w in texts:  # alone, each with its own grammar, and with another bound
        assert grammar_runs([w], 4)[0][0] == brute_runs(w, 4)


@pytest.mark.parametrize("letters", [1, 2, 30])
def test_extensions_are_exact(letters):
    rng = np.random.default_rng(letters)
    w = rng.integers(0, letters, 300)
    w[150:250] = w[20:120]
    symbols = np.concatenate([[letters], w, [letters + 1]])
    grammar = pr.Grammar(symbols, letters + 2)
    i, j = rng.integers(1, 301, 2000), rng.integers(1, 301, 2000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    right, left = grammar.right(i, j), grammar.left(i, j)
    for a, b, r, back in zip(i, j, right, left):
        k = 0
        while symbols[a + k] == symbols[b + k]:
            k += 1
        assert r == k
        k = 0
        while symbols[a - 1 - k] == symbols[b - 1 - k]:
            k += 1
        assert back == k


def test_blocks_of_candidates_and_a_very_long_repetitive_text(monkeypatch):
    rng = random.Random(2)
    w = [f"w{rng.randrange(5000)}" for _ in range(30_000)] + ["p", "q", "r"] * 20_000 + ["z"] * 5_000
    runs, _ = grammar_runs([w])
    assert (30_000, 60_000, 3) in runs[0] and (90_000, 5_000, 1) in runs[0] and len(runs[0]) == 2
    texts = texts_of_many_kinds()[:30]
    whole = grammar_runs(texts)
    monkeypatch.setattr(pr, "BLOCK", 50)
    assert grammar_runs(texts) == whole


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_query_equals_brute_force(spark, docs_of, odd_texts):
    rng = random.Random(4)
    rows = [r for r in odd_texts if len(r[1] or "") < 1000]
    rows += [(i, rng.choice([" ", "\n", " \t"]).join(rng.choice("abcdefghé") for _ in range(rng.randrange(0, 90)))) for i in range(10, 150)]
    found = pr.run_digests(pr.find_runs(pr.with_planted_repeats(docs_of(rows))))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    expected = []
    for i, t in rows:
        w = planted(i, t)
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        milli = best[1] * 1000 // best[2] if runs else None
        expected.append((i, len(runs), *best, milli, digest, hashlib.sha256(collapse(w, runs).encode()).hexdigest(), len(w)))
    assert got == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in got) > 10
    assert pr.run_digests(pr.find_runs(docs_of([]))).count() == 0
    assert pr.find_runs(docs_of(odd_texts)).count() == len(odd_texts)
