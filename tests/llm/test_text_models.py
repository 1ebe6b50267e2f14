from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from panelstress.llm import byte_bpe, language_id, pii, quality_classifier, templates, toxicity
from panelstress.llm.common import held_out

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

KEY = b"tests"


def test_bpe_equals_the_library(docs_of, odd_texts):
    texts = odd_texts + [(20, "é日本 don't  stop\n\n 123!!"), (21, "ab" * 3000), (22, "<|endoftext|> x")]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rows = byte_bpe.encode_documents(docs_of(texts), RANKS, public_tokenizers.PATTERN, ids_array=True).collect()
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted(tuple(enc.encode_ordinary(t or "")) for _, t in texts)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert byte_bpe.encode_documents(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pipeline_returns_ids_that_decode_to_the_texts(spark, docs_of, odd_texts):
    rows = corpus_pipeline.tokenize(spark, docs_of(odd_texts + [(20, "é日本 don't stop")]), "")
    got = byte_bpe.decode_documents(rows, RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in got) == sorted((str(i), t or "") for i, t in odd_texts + [(20, "é日本 don't stop")])
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode_documents(none, RANKS).collect()} == {1: None, 2: b""}


def test_toxicity_learns_terms_and_folds(spark, docs_of):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["sun", "tree", "road", "clownfish"], 30)) + (" you idiot here" if i % 5 == 0 else "") for i in range(400)]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert any("idiot" in t for t in lexicon.weights)
    probe = docs_of([(1, "such an ІDІОT"), (2, "an 1d10t!"), (3, "sun and tree"), (4, ""), (5, None), (None, "idiot"), (6, "tree " * 50_000 + "idiot")])
    out = {(r.doc_id): r for r in toxicity.score(probe, lexicon).collect()}
    assert out[1].predicted == out[2].predicted == out[None].predicted == 1
    assert out[3].predicted == out[4].predicted == out[5].predicted == 0 and out[6].n_hits == 1
    assert {r.doc_id for r in toxicity.keep_clean(probe, lexicon).collect()} >= {3, 4, 5}
    assert toxicity.keep_clean(probe.limit(0), lexicon).count() == 0
    assert toxicity.learn(docs, labels.limit(0)).weights == {}


def test_toxic_words_that_stand_together_are_all_kept(spark, docs_of):
    """Words seen only beside a stronger one count on their own; a stem that finds no other row than its word does not."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["sun", "tree", "road"], 30)) + (" idiot pathetic scum" if i % 5 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs_of(texts), labels)
    assert set(lexicon.weights) == {" idiot ", " pathetic ", " scum "}
    probe = docs_of([(1, "how pathetic"), (2, "you scum"), (3, "sympathetic to patho")])
    assert {r.doc_id: r.n_hits for r in toxicity.score(probe, lexicon).collect()} == {1: 1, 2: 1, 3: 0}


def test_exceptions_take_back_what_was_added_once():
    lexicon = toxicity.Lexicon({" clown ": 4.0, " clow": 3.5, " scum ": 5.0}, toxicity.EXCEPTIONS, (0.0, 1.0, 1.0))
    assert toxicity._found(lexicon.automaton(), toxicity.fold("a clown fish, you scum")) == (5.0, 2)


def test_exception_phrases_take_hits_back():
    lexicon = toxicity.Lexicon({" clown ": 4.0, " trash ": 4.0}, toxicity.EXCEPTIONS, (0.0, 1.0, 1.0))
    found = toxicity._found(lexicon.automaton(), toxicity.fold("A clown fish in a trash can, you CL0WN"))
    assert found == (4.0, 3)


def test_quality_model_and_its_corner_cases(spark, docs_of):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["river", "stone", "green", "walks", "under"], 40)) for _ in range(150)]
    bad = [" ".join(f"{w}%%%" for w in rng.choice(["river", "stone", "green"], 40)) for _ in range(150)]
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)], "doc_id bigint, quality int")
    vectors = quality_classifier.word_vectors(docs)
    net = quality_classifier.learn(docs, labels, vectors)
    rows = quality_classifier.score(docs, vectors, net).withColumn("h", held_out(F.col("doc_id"))).where("h").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 150) for r in rows]) > 0.95
    odd = quality_classifier.score(docs_of([(1, None), (2, ""), (3, "%" * 200_000), (None, "x")]), vectors, net).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    one = quality_classifier.learn(docs, labels.where("quality = 1"), vectors)
    assert one.probability(np.zeros((1, 49)))[0] > 0.9
    assert quality_classifier.score(docs.limit(0), vectors, net).count() == 0


def _words_of(texts, names):
    raw = np.frombuffer(" ".join(texts).encode(), dtype=np.uint8)
    _, start, end = language_id.runs(raw, np.array([0, len(raw)]))
    return language_id.distinct(raw, start, end, language_id.Trie(names))


def test_forward_sums_all_segmentations():
    names = language_id.letter_pieces([b"ab", b" abc", b"bc", b"A1", b"!"])
    assert b"abc" in names and b"A1" not in names and b"!" not in names
    p = np.zeros((len(names), 1))
    value = {b"a": 0.1, b"b": 0.2, b"c": 0.3, b"ab": 0.15, b"bc": 0.05, b"abc": 0.01}
    for k, v in value.items():
        p[names.index(k), 0] = v
    words, _ = _words_of(["abc"], names)
    exact = 0.1 * 0.2 * 0.3 + 0.15 * 0.3 + 0.1 * 0.05 + 0.01
    assert language_id.word_scores(words, p)[0, 0] == pytest.approx(np.log(exact))
    counts = language_id.expected_counts(words, p, np.ones((1, 1)))
    assert counts[names.index(b"abc"), 0] == pytest.approx(0.01 / exact)
    assert sum(len(n) * counts[i, 0] for i, n in enumerate(names)) == pytest.approx(3.0)


def test_sums_over_the_whole_vocabulary_equal_brute_force():
    """Every segmentation of short words is listed; longer runs are summed by a plain recursion in logarithms."""
    import itertools

    names = language_id.letter_pieces(list(RANKS))
    lowered = {x.removeprefix(b" ").decode(errors="replace").lower() for x in RANKS}
    assert max(map(len, names)) > 12 and "international" in lowered and b"international" in names
    rng = np.random.default_rng(8)
    p = rng.random((len(names), 2)) ** 4 * 1e-3
    number = {n: i for i, n in enumerate(names)}
    texts = ["internationally", "theshorthouse", "größe", "straßenbahn", "привет", "язык", "日本語", "한국어", "ελλάδα", "e\u0301te\u0301"]
    words, back = _words_of(texts, names)
    scores = language_id.word_scores(words, p)
    counts = np.zeros_like(p)
    for text, at in zip(texts, back):
        raw, total = text.encode(), np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(raw) - 1):
            parts, begin = [], 0
            for i, cut in enumerate((*cuts, 1), 1):
                if cut:
                    parts.append(number.get(raw[begin:i], -1))
                    begin = i
            if -1 not in parts:
                total += np.prod(p[parts], axis=0)
        assert np.exp(scores[at]) == pytest.approx(total, rel=1e-9)
    long = ["haus" * 1500, "привет" * 400, "".join(chr(97 + c) for c in rng.integers(0, 26, 5000))]
    words, back = _words_of([*long, *texts], names)
    scores = language_id.word_scores(words, p)
    for text, at in zip(long, back):
        raw = text.encode()
        alpha = np.full((len(raw) + 1, 2), -np.inf)
        alpha[0] = 0.0
        for j in range(1, len(raw) + 1):
            found = [(m, number[raw[j - m : j]]) for m in range(1, min(j, words.longest_piece) + 1) if raw[j - m : j] in number]
            alpha[j] = np.logaddexp.reduce([alpha[j - m] + np.log(p[i]) for m, i in found], axis=0)
        assert scores[at] == pytest.approx(alpha[-1], rel=1e-10)
    weight = rng.random((len(words.length), 2))
    counts = language_id.expected_counts(words, p, weight)
    lengths = np.array([len(n) for n in names])
    assert lengths @ counts == pytest.approx(words.length @ weight, rel=1e-9)
    assert np.allclose(counts, language_id.expected_counts(words, p, weight, places=50), rtol=1e-9)


def test_languages(spark):
    one, two = "the house and the garden with that river", "das haus und der garten mit dem fluss"
    rows = [(i, (one if i % 2 else two), "en" if i % 2 else "de") for i in range(80)] + [(90, one, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.learn(docs, list(RANKS))
    probe = spark.createDataFrame([(1, "the river and that house"), (2, "der fluss und das haus"), (3, None), (4, "123 ?!"), (None, "garden"), (5, "haus" * 20_000), (6, "\u201c\u0661\u0662\u201d")], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(probe, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, None, 5, 6)] == ["en", "de", "und", "und", "en", "de", "und"]
    assert got[3][1] == 0 and 0.5 <= got[1][1] <= 1
    assert language_id.predict(probe, language_id.learn(docs.limit(0), list(RANKS))).where("lang_pred <> 'und'").count() == 0


def test_templates_catch_changed_numbers_and_check_slots(spark, docs_of):
    item = "A train leaves the old station at 7 hours with 120 kg of coal, and Maria counts 7 bags of 120 kg before the long evening ride begins"
    changed = item.replace("120", "450").replace("7", "9").replace("Maria", "Elena")
    broken = changed.replace("9 bags of 450", "8 bags of 460")
    docs = docs_of([(1, f"Some words. {item} and more."), (2, f"Here is {changed} indeed"), (3, broken), (4, "clean text " * 30), (5, None), (6, ""), (None, item), (8, "Two three words stand")])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "Two three words stand"), (4, "x")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.changed for r in templates.leaks(docs, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (None, 1): False, (8, 3): False}
    assert {r.doc_id for r in templates.drop_leaks(docs, bench).collect()} == {3, 4, 5, 6}
    assert templates.leaks(docs.limit(0), bench).count() == 0 and templates.leaks(docs, bench.limit(0)).count() == 0


def test_templates_void_windows_and_not_alignments(spark, docs_of):
    """One number used for two things, new numbers that coincide, and a copy with one of two equal numbers changed."""
    two = "Anyone who has 2 apples and wants to share them with 2 friends should first ask how many pieces each of them would like to get"
    other = two.replace("2 friends", "4 friends")
    docs = docs_of([(1, two.replace("2 a", "3 a").replace("2 f", "5 f")), (2, other.replace("2 a", "5 a").replace("4 f", "5 f")), (3, two.replace("2 f", "6 f")), (4, "clean text " * 20)])
    found = templates.leaks(docs, spark.createDataFrame([(1, two), (2, other)], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in found if r.item_id == 1} >= {1, 3} and (2, 2) in {(r.doc_id, r.item_id) for r in found}
    assert {r.doc_id for r in templates.drop_leaks(docs, spark.createDataFrame([(1, two), (2, other)], "item_id bigint, text string")).collect()} == {4}
    # All windows but those with the odd slot stay, and windows equal to the item stay whatever the map says.
    assert templates.consistent([(0, [(2, 3)]), (1, [(2, 3), (7, 7)]), (2, [(2, 5)]), (3, [(2, 2)])]) == [0, 1, 3]


def test_templates_find_items_of_placeholders_and_under_titles(spark, docs_of):
    title = "What Is The Capital City Of France Today And Why"
    sums = "Compute 12 + 7, 19 - 4, 3 x 5, 18 / 6, 44 and 81, then 5 and 17 and 23"
    short = "Where does the old river end"
    names = "Anna Maria Paul Peter"
    bench = spark.createDataFrame(list(enumerate([title, sums, short, names])), "item_id int, text string")
    docs = docs_of([
        (1, f"some text then {title} and on"), (2, f"Quiz\n{sums} end"), (3, f"Exercise 5\n\n{short}"), (4, f"with {names} here"),
        (5, f'He said "stop." {short}'), (6, "The Big Book Of Small Towns Today And Then"), (7, "Compute 13 + 8, 20 - 5, 4 x 6, 19 / 7, 45 and 82 only"), (8, "from Carl Otto Fritz Hans"),
    ])
    got = {(r.doc_id, r.item_id) for r in templates.leaks(docs, bench).collect()}
    assert got >= {(1, 0), (2, 1), (3, 2), (4, 3), (5, 2)} and not {d for d, _ in got} & {6, 8}
    raw = [np.frombuffer(t.encode(), np.uint8) for t in ('it ends." What now', "it ends.” What now", "it ends. What now", "the firm etc., What now")]
    assert [templates.canonical(r, np.array([0, len(r)]))[2][-2] != 0 for r in raw] == [False, False, False, True]


def test_surrogates(docs_of):
    texts = [
        (1, "Write to ann.b@mail.example.com or +1 (555) 555-0199, from 10.1.2.3."), (2, "again ann.b@mail.example.com; card 4111 1111 1111 1111"),
        (3, 'token = "abcdef0123456789abcdef01"'), (4, "Frau Anna Keller met Mr. Paul Weber. Mr. Paul Weber left."), (5, "Nothing here: 12 of 13"), (6, None), (7, ""), (None, "ip 10.1.2.3"), (5, "Nothing here: 12 of 13"),
    ]
    rows = {(r.doc_id, i): r for i, r in enumerate(sorted(pii.replace_entities(docs_of(texts), KEY, count_col="n").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))}
    out = {k[0]: r.text for k, r in rows.items()}
    assert out[5] == "Nothing here: 12 of 13" and out[6] is None and out[7] == ""
    mail = next(pii.find(out[1]))
    assert mail[2] == "email" and mail[3] in out[2] and "ann.b" not in out[1] + out[2]
    assert [k for _, _, k, _ in pii.find(out[1])] == ["email", "phone", "ip"]
    assert next(pii.find(out[None]))[3] in out[1]
    card = [v for _, _, k, v in pii.find(out[2]) if k == "card"][0]
    assert card.count(" ") == 3 and pii._luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    names = [(k, v) for _, _, k, v in pii.find(out[4])]
    assert [k for k, _ in names] == ["name:f:latin", "name:m:latin", "name:m:latin"] and names[1] == names[2]
    assert pii.replace_entities(docs_of([]), KEY).count() == 0


def test_colliding_surrogates_draw_again(spark):
    """Far more names than pairs in the lists: later draws must settle all of them."""
    many = spark.range(3000).selectExpr("'name:f:latin' AS kind", "concat('Anna N', id) AS value")
    table = pii.surrogate_table(many, KEY)
    assert table.select("surrogate").distinct().count() == 3000
    assert table.where("attempt > 0").count() > 0


def test_surrogates_of_more_addresses_than_their_form_has_room_for(spark):
    """5,000 addresses as short as a@b.com: brute-force check that surrogates are distinct, new and of the same type."""
    import itertools
    import re

    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    values = [f"{a}{b}@{c}.com" for a, b, c in itertools.islice(itertools.product(signs, ["", *signs], signs), 0, 45_000, 9)]
    assert len(set(values)) == 5000
    ips = [f"10.0.{i // 200}.{i % 200}" for i in range(300)]
    rows = [("email", v) for v in values] + [("ip", v) for v in ips]
    table = pii.surrogate_table(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()
    new = [r.surrogate for r in table]
    assert len(table) == len(rows) and len(set(new)) == len(new) and not set(new) & {v for _, v in rows}
    assert all(re.fullmatch(r"[a-z0-9]+@[a-z0-9]+\.com", r.surrogate) for r in table if r.kind == "email")
    again = pii.surrogate_table(spark.createDataFrame(rows[::-1], "kind string, value string"), KEY).collect()
    assert sorted(map(tuple, table)) == sorted(map(tuple, again))
    other = pii.surrogate_table(spark.createDataFrame(rows[:50], "kind string, value string"), b"another").collect()
    assert {r.surrogate for r in other}.isdisjoint({r.surrogate for r in table if r.value in {v for _, v in rows[:50]}})


def test_spellings_of_one_entity_share_a_surrogate(spark):
    texts = [
        (1, "Mail Ann.Lee@Site.org or ann.lee@site.org now"), (2, "pay 4111 1111 1111 1111 or 4111111111111111 or 4111-1111-1111-1111"),
        (3, "iban DE89 3704 0044 0532 0130 00 or DE89370400440532013000"), (4, "x" * 300_000 + " mail ann.lee@site.org"),
    ]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], "doc_id bigint, text string, kind string, value string")
    out = {r.doc_id: r.text for r in pii.replace_entities(df, KEY).collect()}
    mails = [v for _, _, k, v in pii.find(out[1]) if k == "email"]
    assert mails[0].lower() == mails[1] and mails[0] != mails[1] and mails[1] != "ann.lee@site.org" and out[4].endswith(mails[1])
    cards = [v for _, _, k, v in pii.find(out[2]) if k == "card"]
    assert len({v.replace(" ", "").replace("-", "") for v in cards}) == 1 and cards[0].count(" ") == 3 and cards[2].count("-") == 3 and pii._luhn(cards[1])
    ibans = [v for _, _, k, v in pii.find(out[3]) if k == "iban"]
    assert ibans[0].replace(" ", "") == ibans[1] and ibans[0][:2] == "DE" and ibans[0].count(" ") == 5
