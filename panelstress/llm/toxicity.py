"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs of other scripts to Latin letters, and reads digits and signs inside words as the
letters they stand for. Terms are whole words or beginnings of words; exception phrases take a hit back. The
lexicon and its weights (log odds) are learned from a bounded sample of labelled rows: all words and beginnings of
words that enough toxic rows hold and that stand far more often there. The score is a logistic function of
the weight found, and of the weight per word, so that length counts.

Defined results: null and empty texts have no hits and get the score of such texts; rows that repeat are scored
each; null ids stay null and are not held out; labels that are null are not learned from; an empty table gives an
empty one; without labelled rows of both classes the lexicon is empty and every score is the prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.llm.common import held_out

#: Bound of the sample of labelled rows that the lexicon and the curve are fitted on.
SAMPLE_ROWS = 20_000
MIN_DOCS = 5
MIN_LOG_ODDS = 3.0
THRESHOLD = 0.3
_STEMS = (4, 5, 6)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k", "υ": "u", "ε": "e", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("clown fish", "clown fishes", "trash can", "trash cans", "trash bin", "waste and trash collection")

_FOLD = str.maketrans(HOMOGLYPHS)
_SUBSTITUTE = str.maketrans(DIGITS)
# A sign or digit counts as a letter between letters, or a digit before one, never at the end of a word.
_LEET = re.compile(r"[^\W\d_]*(?:[0-9@$!]+[^\W\d_]+)+")
_MARKED = re.compile(r"[0-9@$!][^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    if _MARKED.search(low):
        low = _LEET.sub(lambda m: m.group().translate(_SUBSTITUTE), low)
    return f" {_OTHER.sub(' ', low).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Terms (``" word "`` or ``" stem"``) with weights, exception phrases, and the curve of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        if not self.weights:
            return out
        out.make_automaton()
        inside = {p: _found(out, p)[0] for p in map(fold, self.exceptions)}
        for phrase, weight in inside.items():
            if weight > 0:  # takes back what the terms inside add
                out.add_word(phrase, (len(phrase), -weight))
        out.make_automaton()
        return out


def _found(automaton: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Weight and number of hits; of terms that begin at the same letter only the heaviest counts."""
    best: dict[int, float] = {}
    back = 0.0
    for end, (length, weight) in automaton.iter(folded):
        if weight < 0:
            back += weight
            continue
        at = end - length
        if weight > best.get(at, 0.0):
            best[at] = weight
    return max(0.0, sum(best.values()) + back), len(best)


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(100.0 * weight / np.maximum(words, 1.0))], axis=1)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y), x.T @ (y - p) - len(y) * (ridge @ beta))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def candidate_terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in _STEMS if len(w) > n}


def training_rows(documents: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and y of a bounded sample of labelled rows that are not held out, in the order of a hash.

    The sample holds ids and labels only, has at most ``rows`` rows and is broadcast, so no text is shuffled.
    """
    usable = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(target))
    sample = usable.groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).orderBy(order, "doc_id").limit(rows)
    return documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            counts[y].update(candidate_terms(fold(text or "")))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string())] + [pa.array([c[t] for t in terms], pa.int64()) for c in counts], ["term", "clean", "toxic"]
        )


def _without_idle_stems(rows: list[tuple[int, list[str]]]) -> set[str]:
    """All terms of the rows but the beginnings of words that find no row which their longer terms do not find too.

    Such a beginning adds nothing to its words on what is known, and would meet unrelated words elsewhere.
    """
    holders = defaultdict(set)
    for i, terms in rows:
        for t in terms:
            holders[t].add(i)
    longer: dict[str, set[int]] = defaultdict(set)
    kept: set[str] = set()
    for term in sorted(holders, key=lambda t: (-len(t), t)):
        if not term.endswith(" ") and holders[term] <= longer[term]:
            continue
        kept.add(term)
        for n in _STEMS:
            if n + 1 < len(term):
                longer[term[: n + 1]] |= holders[term]
    return kept


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, target: str = "toxic", exceptions=EXCEPTIONS) -> Lexicon:
    """Lexicon and curve. What reaches the driver is bounded by the sample: its terms, and one list of terms per toxic row.

    Every term that passes the filters on support and odds has its weight; how much the weight found tells is left to the curve.
    """
    sample = training_rows(documents, labels, target, rows)
    totals = dict(sample.groupBy("y").count().collect())
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Lexicon({}, tuple(exceptions), (math.log((toxic + 1) / (clean + 1)), 0.0, 0.0))
    counts = (
        sample.select("text", "y").mapInArrow(_term_counts, "term string, clean bigint, toxic bigint")
        .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= MIN_DOCS)
        .withColumn("odds", F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0)))
        .where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("toxic") >= F.col("clean")))
    )
    odds = {r.term: float(r.odds) for r in counts.select("term", "odds").collect()}

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(candidate_terms(fold(t or "")) & odds.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "terms"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    marked = sample.where("y = 1").select("doc_id", "text").mapInArrow(terms_of, f"doc_id {kind}, terms array<string>")
    chosen = _without_idle_stems([(i, r.terms) for i, r in enumerate(marked.collect())])
    lexicon = Lexicon({t: odds[t] for t in sorted(chosen)}, tuple(exceptions), (0.0, 0.0, 0.0))
    seen = hits(sample, lexicon, ["y"]).toArrow()
    x = features(seen["weight"].to_numpy(), seen["n_words"].to_numpy().astype(float))
    beta = _fit_curve(x, seen["y"].to_numpy().astype(float))
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(float(b) for b in beta))


def hits(documents: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep with weight, n_hits and n_words of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton() if lexicon.weights else None
        for batch in batches:
            weights, numbers, words = [], [], []
            for text in batch.column("_text").to_pylist():
                folded = fold(text or "")
                weight, number = _found(automaton, folded) if automaton is not None else (0.0, 0)
                weights.append(weight)
                numbers.append(number)
                words.append(max(0, folded.count(" ") - 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(weights, pa.float64()), pa.array(numbers, pa.int64()), pa.array(words, pa.int64())],
                [*keep, "weight", "n_hits", "n_words"],
            )

    source = documents.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, weight double, n_hits bigint, n_words bigint")


def score(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, weight, n_hits and n_words of every document."""
    b = lexicon.curve
    found = hits(documents, lexicon, [id_col], text_col)
    z = b[0] + b[1] * F.log1p("weight") + b[2] * F.log1p(100.0 * F.col("weight") / F.greatest(F.col("n_words").cast("double"), F.lit(1.0)))
    scored = found.withColumn("score", 1.0 / (1.0 + F.exp(-z)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(documents: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns; judged where they are, without a join."""
    beta = np.array(lexicon.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton() if lexicon.weights else None
        for batch in batches:
            weight, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                folded = fold(text or "")
                weight[i] = _found(automaton, folded)[0] if automaton is not None else 0.0
                words[i] = max(0, folded.count(" ") - 1)
            score = 1.0 / (1.0 + np.exp(-np.clip(features(weight, words) @ beta, -30, 30)))
            yield batch.filter(pa.array(score < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
