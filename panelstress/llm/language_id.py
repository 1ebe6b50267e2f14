"""Language identification by unigram pieces, summed over all segmentations.

The pieces come from a fixed public vocabulary: every piece of letters, of any length, with a leading space taken off. Each
language has a probability per piece. The probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm: alpha(j) is the sum over pieces ending at j of alpha(their start) times their probability. Piece
probabilities are learned by expectation-maximisation, whose expected counts come from the same forward pass and its backward
mirror, on a bounded sample of texts per language. A text's score is the posterior of its best language under equal priors, over
all its words.

Words are maximal runs of Unicode letters and marks, lower-cased, of any length. The passes work on the distinct words of a
slice of texts at once. All pieces that start at any place are found by walking a trie of the pieces from all places together; the
sums keep a window as long as the longest piece, with a power of two per word and language set apart, so that no
run is too long for them.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing was learned; texts with a
null language are not learned from; repeated rows are predicted each and learned from each; null ids stay null and are not held
out; very long texts and runs are read whole; an empty table gives an empty one; extra columns are not read. Languages are
a closed set: a model holds one number per piece and language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.llm import tokens
from panelstress.llm.common import held_out
from panelstress.session import materialize

#: Texts per language that the probabilities are learned from, about: a share of the rows chosen by a hash.
SAMPLE_PER_LANGUAGE = 3_000
ROUNDS = 3
UNKNOWN = "und"
#: Bytes of text whose distinct words are taken together.
SLICE = 1 << 23
#: Places of words whose sums are worked on at once.
PLACES = 1 << 18
_NO_LETTERS = r"[^\p{L}\p{M}]+"
#: Sums below 2^-_SHIFT are scaled up by as much, and the number of times is kept.
_SHIFT = 400
_SMALL = 2.0**-_SHIFT


def letters_only(text: Column) -> Column:
    """Lower-cased words of letters, one space between them."""
    return F.regexp_replace(F.lower(text), _NO_LETTERS, " ")


def letter_pieces(vocabulary: list[bytes]) -> list[bytes]:
    """Pieces made of letters, lower-cased and without a leading space, with all single bytes that letters are made of.

    A piece that is no whole UTF-8 text is kept when it is a part of longer characters.
    """
    found = {bytes([b]) for b in (*range(97, 123), *range(128, 256))}
    for piece in vocabulary:
        piece = piece.removeprefix(b" ")
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            if all(b >= 128 for b in piece):
                found.add(piece)
            continue
        if text and all(c.isalpha() or unicodedata.category(c).startswith("M") for c in text):
            found.add(text.lower().encode())
    return sorted(found)


class Trie:
    """Prefixes of the pieces as numbered nodes; steps are found by open addressing in numpy."""

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}
        number, longest = [-1], 0
        for i, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                node = step.setdefault(key, len(number))
                if node == len(number):
                    number.append(-1)
            number[node], longest = i, max(longest, len(piece))
        self.size, self.longest = len(pieces), longest
        self.piece = np.array(number, dtype=np.int32)  # piece that ends at a node, or -1
        keys = np.fromiter(step.keys(), np.int64, len(step)) + 1
        nodes = np.fromiter(step.values(), np.int32, len(step))
        self._bits = max(4, (3 * len(keys)).bit_length())
        self._keys, self._nodes = np.zeros(1 << self._bits, np.int64), np.zeros(1 << self._bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[slot[left]] == 0]
            self._keys[slot[free]] = keys[free]
            placed = self._keys[slot[left]] == keys[left]
            self._nodes[slot[left[placed]]] = nodes[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & (len(self._keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next node, or 0 where no piece goes on like that."""
        keys = (nodes.astype(np.int64) << 8 | byte) + 1
        slot, out, left = self._slot(keys), np.zeros(len(keys), np.int32), np.arange(len(keys))
        while len(left):
            found = self._keys[slot[left]]
            same = found == keys[left]
            out[left[same]] = self._nodes[slot[left[same]]]
            left = left[~same & (found != 0)]
            slot[left] = (slot[left] + 1) & (len(self._keys) - 1)
        return out


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every word."""
    return tokens.words(raw, offsets)


@dataclass
class Words:
    """Distinct words of a slice, by falling length, and every piece that stands in them.

    Pieces are ordered by the place where they end: those that end after j bytes are ``upto[j - 1]`` .. ``upto[j]``.
    """

    length: np.ndarray
    longest_piece: int
    word: np.ndarray
    size: np.ndarray
    piece: np.ndarray
    upto: np.ndarray

    def ending(self, j: int) -> slice:
        return slice(self.upto[j - 1], self.upto[j])

    @cached_property
    def first(self) -> np.ndarray:
        """Place of each word's beginning among the places of all words, one more than it has bytes."""
        return np.cumsum(self.length + 1) - self.length - 1


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of small numbers that are not negative."""
    return np.argsort(values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values, kind="stable")


def _found_pieces(raw: np.ndarray, first: np.ndarray, length: np.ndarray, trie: Trie) -> Words:
    word = np.repeat(np.arange(len(length)), length)
    begin = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    at, left = first[word] + begin, length[word] - begin
    node, found = np.zeros(len(word), np.int32), []
    size = 0
    while len(word):
        node = trie.step(node, raw[at + size])
        size += 1
        ends = np.flatnonzero(trie.piece[node] >= 0)
        found.append((word[ends].astype(np.int32), (begin[ends] + size).astype(np.int32), np.full(len(ends), size, np.int32), trie.piece[node[ends]]))
        go = (node > 0) & (left > size)
        word, begin, at, left, node = word[go], begin[go], at[go], left[go], node[go]
    names, ends, sizes, pieces = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int32),) * 4
    order = _order(ends)
    longest = int(length.max()) if len(length) else 0
    upto = np.searchsorted(ends[order], np.arange(longest + 1), "right")
    return Words(length, trie.longest, names[order], sizes[order], pieces[order], upto)


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray, trie: Trie) -> tuple[Words, np.ndarray]:
    """Distinct words and the number of the distinct word of every run."""
    h = tokens.run_hash(raw, start, end)
    _, where, back = np.unique(h, return_index=True, return_inverse=True)
    length = (end - start)[where]
    order = np.argsort(-length, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return _found_pieces(raw, start[where][order], length[order], trie), rank[back]


def _added(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by index."""
    return np.stack([np.bincount(index, values[:, c], n) for c in range(values.shape[1])], axis=1)


def word_scores(words: Words, p: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Log probability of every word per language."""
    parts = [_window_scores(part, p) for _, part in _chunks(words, places)]
    return np.concatenate(parts) if parts else np.zeros((0, p.shape[1]))


def _window_scores(words: Words, p: np.ndarray) -> np.ndarray:
    """The forward pass with no more sums than a window as long as the longest piece."""
    ring = min(words.longest_piece, int(words.length[0]) if len(words.length) else 0) + 1
    window = np.zeros((len(words.length), ring, p.shape[1]))
    window[:, 0] = 1.0
    scale = np.zeros((len(words.length), p.shape[1]), dtype=np.int64)
    out = np.zeros((len(words.length), p.shape[1]))
    ending = np.searchsorted(-words.length, -np.arange(len(words.upto)), "right")  # words of at least j bytes
    for j in range(1, len(words.upto)):
        n, part = ending[j], words.ending(j)
        word, piece = words.word[part], words.piece[part]
        now = _added(word, window[word, (j - words.size[part]) % ring] * p[piece], n)
        window[:n, j % ring] = now
        low = np.nonzero((now < _SMALL) & (now > 0))
        if len(low[0]):
            window[low[0], :, low[1]] *= 2.0**_SHIFT
            scale[low] += 1
        done = slice(ending[j + 1] if j + 1 < len(ending) else 0, n)
        with np.errstate(divide="ignore"):
            out[done] = np.log(window[done, j % ring]) - scale[done] * (_SHIFT * np.log(2.0))
    return np.maximum(out, -1e300)


def _all_sums(words: Words, p: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """alpha (or beta) at all places of all words as value and number of scalings."""
    places = int((words.length + 1).sum())
    value, scale = np.zeros((places, p.shape[1])), np.zeros((places, p.shape[1]), dtype=np.int32)
    longest, none = len(words.upto) - 1, np.iinfo(np.int32).max
    value[words.first + (0 if forward else words.length)] = 1.0
    end = np.repeat(np.arange(1, longest + 1, dtype=np.int32), np.diff(words.upto))
    if forward:
        word, piece, source, upto = words.word, words.piece, words.first[words.word] + end - words.size, words.upto
    else:  # pieces by where they start, counted from the end of the word
        turn = words.length[words.word] - (end - words.size)
        order = _order(turn)
        word, piece, source = words.word[order], words.piece[order], (words.first[words.word] + end)[order]
        upto = np.searchsorted(turn[order], np.arange(longest + 1), "right")
    ending = np.searchsorted(-words.length, -np.arange(longest + 1), "right")  # words of at least j bytes
    scaled = False
    for j in range(1, longest + 1):
        part, n = slice(upto[j - 1], upto[j]), ending[j]
        at, before = word[part], value[source[part]]
        least = np.zeros((n, p.shape[1]), dtype=np.int32)
        if scaled:
            exps = scale[source[part]]
            least[:] = none
            np.minimum.at(least, at, np.where(before > 0, exps, none))
            least[least == none] = 0
            before = np.ldexp(before, np.clip(-_SHIFT * (exps - least[at]), -2000, 0))
        now = _added(at, before * p[piece[part]], n)
        low = (now < _SMALL) & (now > 0)
        if low.any():
            scaled = True
            now[low] *= 2.0**_SHIFT
            least += low
        spots = words.first[:n] + (j if forward else words.length[:n] - j)
        value[spots] = now
        if scaled:
            scale[spots] = least
    return value, scale


def _chunks(words: Words, places: int) -> Iterator[tuple[np.ndarray, Words]]:
    """Words whose places fit together, or one word; by rows of the table of pieces."""
    total = np.cumsum(words.length + 1)
    lo, longest = 0, len(words.upto) - 1
    end = np.repeat(np.arange(1, longest + 1), np.diff(words.upto))
    while lo < len(words.length):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + places, "right")))
        mine = np.flatnonzero((words.word >= lo) & (words.word < hi))
        upto = np.searchsorted(end[mine], np.arange(int(words.length[lo]) + 1), "right")
        yield np.arange(lo, hi), Words(words.length[lo:hi], words.longest_piece, words.word[mine] - lo, words.size[mine], words.piece[mine], upto)
        lo = hi


def expected_counts(words: Words, p: np.ndarray, weight: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Expected numbers of every piece per language, for words with a weight per language."""
    counts = np.zeros((p.shape[0], p.shape[1]))
    for rows, part in _chunks(words, places):
        (alpha, a), (beta, b) = _all_sums(part, p, True), _all_sums(part, p, False)
        last = part.first + part.length
        end = part.first[part.word] + np.repeat(np.arange(1, len(part.upto)), np.diff(part.upto))
        start = end - part.size
        total, t = alpha[last][part.word], a[last][part.word]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = alpha[start] * p[part.piece] / total * beta[end]
        if a.any() or b.any():
            share = np.ldexp(share, np.clip(-_SHIFT * (a[start] + b[end] - t), -2000, 2000))
        share = np.where(total > 0, share, 0.0) * weight[rows][part.word]
        counts += _added(part.piece, share, p.shape[0])
    return counts


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[bytes, ...]
    #: One row per piece.
    p: np.ndarray


def _sample(documents: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """Distinct words of the training texts with their numbers per language (word, lang, n), written once.

    Of every language about the given number of texts, chosen by a hash of the id.
    """
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    counts = usable.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    languages = sorted(r[0] for r in counts.select("_lang").collect())
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).where(draw * F.col("_n") < per_language)  # one row per language
    words = chosen.select("lang", F.explode(F.split(letters_only(F.col("text")), " ")).alias("word")).where("word <> ''")
    return materialize(words.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")).repartition("word"), "language-words"), languages


def learn(documents: DataFrame, vocabulary: list[bytes], per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities by expectation-maximisation; the driver sees pieces x languages numbers per round."""
    sample, languages = _sample(documents, per_language)
    pieces = letter_pieces(vocabulary)
    number = {lang: i for i, lang in enumerate(languages)}
    p = np.repeat(np.array([[10.0 ** -min(len(x), 12)] for x in pieces]), len(languages), axis=1)
    p /= max(p[:, :1].sum(), 1e-300)
    context = documents.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        shared = context.broadcast((pieces, p))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, now = shared.value
            trie = Trie(names)
            total = np.zeros_like(now)
            for batch in batches:
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
                raw, offsets = tokens.utf8(batch.column("word"))
                for lo, hi in tokens.slices(offsets, SLICE):
                    at = offsets[lo : hi + 1] - offsets[lo]
                    words, back = distinct(raw[offsets[lo] : offsets[hi]], at[:-1], at[1:], trie)
                    times = batch.column("n").to_numpy()[lo:hi]
                    weight = np.bincount(back * len(number) + lang[lo:hi], weights=times, minlength=len(words.length) * len(number))
                    total += expected_counts(words, now, weight.reshape(-1, len(number)))
            piece, which = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(which, pa.int32()), pa.array(total[piece, which])], ["piece", "lang", "n"]
            )

        counts = sample.mapInArrow(count, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        p = np.zeros_like(p)
        p[counts["piece"].to_numpy(), counts["lang"].to_numpy()] = counts["n"].to_numpy()
        p += 0.1
        p /= p.sum(axis=0, keepdims=True)
    return Model(tuple(languages), tuple(pieces), p)


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p = shared.value.languages, shared.value.p
        trie = Trie(list(shared.value.pieces))
        for batch in batches:
            raw, offsets = tokens.utf8(batch.column("_text"))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            for lo, hi in tokens.slices(offsets, SLICE):
                n = hi - lo
                doc, start, end = runs(part := raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                known = letters[lo:hi].astype(bool) & (len(languages) > 0)
                names, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
                if len(doc) and len(languages):
                    words, back = distinct(part, start, end, trie)
                    each = word_scores(words, p)
                    total = np.stack([np.bincount(doc, weights=each[back, c], minlength=n) for c in range(len(languages))], axis=1)
                    top = total.max(axis=1, keepdims=True)
                    odds = np.exp(total - top)
                    names[known] = np.array(languages, dtype=object)[total.argmax(axis=1)[known]]
                    scores[known] = (1.0 / odds.sum(axis=1))[known]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(lo, n), pa.array(names, pa.string()), pa.array(scores)], [id_col, "lang_pred", "score"]
                )

    source = documents.select(
        id_col, letters_only(F.col(text_col)).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    )
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
