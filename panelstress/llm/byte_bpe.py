"""Byte-level BPE encoding and decoding by a file of ranks.

Texts are split by the public pattern; every distinct piece of text (word) is encoded once per group of documents,
and the encoded words are put back in the order of the text. The fold over ranked merges runs on the byte arrays of all
new words at once: each round finds every word's lowest-ranked, leftmost pair in a table of pairs and joins it, until
no word has a pair left. Decoding concatenates the binary pieces of the ids.

Memory per task is bounded: words are kept in a dictionary of at most ``CACHE_WORDS`` entries, which is emptied when
full; documents are split in groups of about 1 MB; a word of more than ``LONG_WORD`` bytes is folded alone with a heap.

Defined results: a null text counts as empty; an empty text has no ids, and digests of the empty string; null ids
stay null; repeated rows give a row each; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 300_000
GROUP_CHARS = 1 << 20
LONG_WORD = 256
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 bytes and a number."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Merges:
    """The rank map as a table of pairs: (left id, right id) to the id of their joint bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = {str(i): b for b, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs: dict[tuple[int, int], int] = {}
        for joint, rank in ranks.items():
            for cut in range(1, len(joint)):
                left, right = ranks.get(joint[:cut]), ranks.get(joint[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        size = 1 << max(4, (4 * len(self.pairs)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, _NONE, dtype=np.int32)
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        values = np.fromiter(self.pairs.values(), dtype=np.int32, count=len(keys))
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # open addressing: whoever finds its slot taken tries the next one
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joint pieces, or the largest integer where there is none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        out = np.full(len(key), _NONE, dtype=np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[slot[open_]]
            same = found == key[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (found != -1)]
            slot[open_] = (slot[open_] + 1) % len(self.keys)
        return out

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, which must not be empty: the lowest-ranked leftmost pair is merged until none is left."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._fold_long(w)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if not short:
            return out
        lengths = np.array([len(words[i]) for i in short])
        ids = self.bytes[np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8)]
        word = np.repeat(np.arange(len(short)), lengths)
        rank = np.full(len(ids), _NONE, dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            if (low == _NONE).any():
                for s, e in zip(first[low == _NONE], np.append(first[1:], len(ids))[low == _NONE], strict=True):
                    out[short[word[s]]] = ids[s:e]
                stay = np.repeat(low != _NONE, np.diff(np.append(first, len(ids))))
                ids, word, rank = ids[stay], word[stay], rank[stay]
                low = low[low != _NONE]
                if not len(ids):
                    break
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            hit = np.flatnonzero(rank == np.repeat(low, np.diff(np.append(first, len(ids)))))
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # one earlier entry is dropped per earlier word
            ids, word, rank = ids[keep], word[keep], rank[keep]
            rank[at] = _NONE
            right = at[(at + 1 < len(ids))]
            right = right[word[right + 1] == word[right]]
            rank[right] = self.ranks(ids[right], ids[right + 1])
            left = at[at > 0] - 1
            left = left[word[left + 1] == word[left]]
            rank[left] = self.ranks(ids[left], ids[left + 1])
        return out

    def _fold_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, in n log n."""
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.pairs.get
        heap = [(r, i) for i in range(len(ids) - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := get((rank, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := get((ids[before[i]], rank))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)


class Codec:
    """Encoder with its dictionary of words; one per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.find, self.known = Merges(ranks), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        split = [self.find(t) for t in texts]
        new = list({w for ws in split for w in ws}.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = list({w for ws in split for w in ws})
        for w, ids in zip(new, self.merges.fold([w.encode() for w in new]), strict=True):
            self.known[w] = ",".join(map(str, ids.tolist()))
        get = self.known.__getitem__
        return [",".join(map(get, ws)) for ws in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.merges.pieces.__getitem__, ids.split(","))) if ids else b""


def groups(lengths: list[int], size: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


_CODECS: dict[tuple[str, int], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """The codec of this worker: the table of pairs is built once per Python process and vocabulary, not per task."""
    key = (pattern, hash(frozenset(shared.value.items())))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def encode_documents(
    documents: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    ids_array: bool = False,
) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, round_trip; with ``ids_array`` also the ids themselves.

    The ranks have the fixed size of the vocabulary file and are broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            lengths = [x or 0 for x in batch.column("_n").to_pylist()]
            for lo, hi in groups(lengths):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column("_text").to_pylist()]
                encoded = codec.encode(texts)
                decoded = [codec.decode(x) for x in encoded]
                columns = [
                    part.column("_id"),
                    pa.array([x.count(",") + 1 if x else 0 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    pa.array([d == t.encode() for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ]
                names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if ids_array:
                    flat = np.fromstring(",".join(x for x in encoded if x), dtype=np.int32, sep=",")
                    ends = np.concatenate([[0], np.cumsum(columns[1].to_numpy())]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.length(text_col).alias("_n"))
    kind = source.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return source.mapInArrow(run, schema + (", ids array<int>" if ids_array else "")).withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded: the bytes that the ids of every row stand for; null ids give null, an id outside the ranks is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in shared.value.items()}
        for batch in batches:
            decoded = [b"".join(map(pieces.__getitem__, x.as_py())) if x.is_valid else None for x in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(decoded, pa.binary())], ["_id", "decoded"])

    source = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, decoded binary").withColumnRenamed("_id", id_col)
