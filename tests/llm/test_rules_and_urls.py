from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from panelstress.llm import quality_rules as rules
from panelstress.llm import url_filters as urls


def test_ledger_equals_brute_force(docs_of, odd_texts):
    texts = odd_texts + [(10, "a b c a b c d"), (11, "x\nx\n \nx y | # %"), (12, "é " * 60), (13, "a a a a")]
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.apply_policy(rules.ledger(docs_of(texts))).collect())
    expected = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 2000 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected.append((i or -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(expected)
    assert rules.ledger(docs_of(texts).limit(0)).count() == 0


def brute_repeats(words):
    seen, hit = {}, set()
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            hit.update(k + j for k in places for j in range(3))
    return len(hit)


def test_ledger_of_long_repetitive_texts(docs_of):
    """A million words of one repeated line, and repeats strewn over a text, in time close to their length."""
    import random
    import time

    rng = random.Random(1)
    texts = {
        1: ["a", "b", "c", "d"] * 250_000,
        2: [f"w{rng.randrange(300)}" for _ in range(40_000)],
        3: ["x"] * 300_000 + [f"u{i}" for i in range(50_000)],
        4: [w for i in range(3000) for w in (f"v{i}", "same", "three", "words")],
    }
    start = time.monotonic()
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in rules.ledger(docs_of([(i, " ".join(w)) for i, w in texts.items()])).collect()}
    assert got == {i: (len(w), brute_repeats(w)) for i, w in texts.items()}
    assert time.monotonic() - start < 60


def test_ablation_counts_what_each_rule_does(spark):
    rows = spark.createDataFrame([(b,) for b in (0, 1, 1, 3, 4, 5)], "failed_rules bigint")
    got = {r.rule: (r.failed, r.only_this, r.without_it) for r in rules.ablation(rows, rules.POLICIES[1]).collect()}
    assert got == {"few_words": (4, 2, 3), "repeated_words": (1, 0, 5), "symbols": (2, 1, 4)}


@pytest.mark.parametrize("shard_keys", [urls.SHARD_KEYS, 100])
def test_cascade_is_exact_on_its_universe(spark, shard_keys):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = F.pmod(F.crc32("key"), F.lit(3)) == 0
    cascade = urls.build_cascade(keys, listed, shard_keys)
    assert len(cascade.sizes) >= 2 and (cascade.shards > 9) == (shard_keys == 100)
    assert cascade.sizes[0] > 50 * cascade.sizes[1]
    got = urls.with_membership(keys, "key", cascade, ["key"])
    assert got.count() == 3000 and got.where(F.col("listed") != listed).count() == 0
    empty = urls.build_cascade(keys.limit(0), listed, shard_keys)
    assert empty.sizes == () and urls.with_membership(keys, "key", empty, ["key"]).where("listed").count() == 0


def test_judgements(spark):
    rows = [
        (1, "http://A.Example.org/es/5?x#y", "example.org/es/", "block"), (2, "https://example.org/en/17", "example.org/en/1", "block"),
        (3, "https://notexample.org/es/1", "org/", "allow"), (4, "http://x.com/fr/1", "com/fr/", "allow"), (5, "http://x.com/de/1", "com/de/", "block"),
        (6, "http://spam-farm.x.net/en", None, "block"), (7, "http://x.net", None, "allow"), (8, None, None, "allow"), (9, "nothing", None, "allow"),
        (9, "nothing", None, "allow"), (None, "http://org", None, "allow"), (11, "http://x.com?/fr/", None, "allow"),
        (12, "http://a.b.Spam-farm.x.net", None, "block"), (13, "http://notspam-farm.x.net", None, "allow"), (14, "http://net", None, "allow"),
        (15, "http://" + "a." * 5000 + "spam-farm.x.net/", None, "block"), (16, "http://.", None, "allow"),
    ]
    domains = spark.createDataFrame([("spam-farm.x.net",), ("spam-farm.x.net",), ("unseen.net",)], "domain string")
    pages = spark.createDataFrame([(i, u, "b") for i, u, _, _ in rows], "page_id bigint, url string, rule string")
    for shard_keys in (urls.SHARD_KEYS, 1):
        got = sorted(((r.page_id, r.rule, r.verdict) for r in urls.judge(pages, domains, shard_keys=shard_keys).collect()), key=str)
        assert got == sorted(((i, r, v) for i, _, r, v in rows), key=str)
    assert urls.judge(pages.limit(0), domains).count() == 0
    assert urls.judge(pages, domains.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_list_from_pages(spark):
    """Domains by name, and by thin pages of all their subdomains together; scripts and tags hold no words."""
    long, thin = "<p>" + "word " * 60 + "</p>", "<script>" + "x " * 90 + "</script><b>few words</b>"
    rows = [(f"http://s{i % 3}.thin.net/{i}", thin if i % 2 else long) for i in range(12)]
    rows += [(f"http://s{i}.good.net/", long if i else None) for i in range(12)]
    rows += [("http://small.info/", thin), ("http://cheap-pills.biz/", long), ("http://pillsbury.biz/", long), (None, None)]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert {r.domain for r in urls.listed_domains(pages).collect()} == {"thin.net", "cheap-pills.biz"}
    assert urls.listed_domains(pages.limit(0)).count() == 0
