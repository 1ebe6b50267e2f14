from __future__ import annotations

import random
import re

import pytest

from panelstress.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs: dict[int, str], min_words: int) -> dict[int, str]:
    """Every position against every earlier one."""
    seq, where = {}, {}
    for d, text in docs.items():
        lines = text.split("\n")
        where[d] = [n for n, x in enumerate(lines) if WORD.search(x)]
        seq[d] = [lines[n] for n in where[d]]
    at = [(d, i) for d in sorted(seq) for i in range(len(seq[d]))]
    gone = {d: set() for d in seq}
    for b, (d, i) in enumerate(at):
        for e, j in at[:b]:
            n = 0
            while i + n < len(seq[d]) and j + n < len(seq[e]) and seq[d][i + n] == seq[e][j + n]:
                n += 1
            if n and sum(len(WORD.findall(x)) for x in seq[d][i : i + n]) >= min_words:
                gone[d].update(where[d][i : i + n])
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in docs.items()}


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_equals_brute_force(spark, docs_of, min_words):
    rng = random.Random(min_words)
    lines = ["a", "b c", "d e f", "g", "", "h i j k"]
    docs = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for i in range(25)}
    docs[30] = "\n".join(["a"] * 20)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(list(docs.items())), min_words=min_words).collect()}
    assert got == brute(docs, min_words)


def test_hot_lines_are_spread(spark, docs_of, monkeypatch):
    """One line makes up half of all lines: its rows meet their class in several parts, and results stay the same."""
    rng = random.Random(5)
    docs = {i: "\n".join(rng.choice(["a b", rng.choice(["c d", "e", f"f {i} g"])]) for _ in range(12)) for i in range(40)}
    for share in (1000, 3):  # every class is hot, or the one line alone
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(list(docs.items())), min_words=6).collect()}
        assert got == brute(docs, 6)
    rows = spark.createDataFrame([(1, 1, i, "hot" if i % 2 else f"k{i // 4}") for i in range(4000)], "d int, t int, i int, h string")
    ranked = line_dedup._with_rank(rows, ["h"], "test")
    assert ranked.where("h = 'hot'").count() == 2000
    assert ranked.where("h = 'hot' and rank = struct(1, 1, 1)").count() == 2000


def test_odd_rows(docs_of, odd_texts):
    df = docs_of(odd_texts).withColumnRenamed("source", "gone").withColumnRenamed("lang", "d")
    out = line_dedup.dedup_lines(df, min_words=3, removed_col="n_removed")
    assert out.columns == [*df.columns, "n_removed"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted(odd_texts, key=str)  # rows that repeat are one document, so neither is a later copy
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_long_documents_in_linear_time(docs_of):
    """Two equal documents of 100,000 lines: the later one loses all of them but a new line in the middle."""
    import time

    lines = [f"line {i} " + "w" * (i % 7 + 1) for i in range(100_000)]
    texts = [(1, "\n".join(lines)), (2, "\n".join([*lines[:50_000], "something new", *lines[50_000:]]))]
    start = time.monotonic()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs_of(texts), removed_col="n_removed").collect()}
    assert got == {1: (texts[0][1], 0), 2: ("something new", 100_000)}
    assert time.monotonic() - start < 120
