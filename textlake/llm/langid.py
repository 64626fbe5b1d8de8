"""Language ID: per-language unigram piece probabilities over a fixed public vocabulary, summed over all segmentations.

A word (cut at ASCII white space, A-Z lower-cased, with a leading space) is any sequence of vocabulary pieces. Its
probability in a language is the sum over all segmentations of the product of piece probabilities, by the forward
algorithm; a text's log-likelihood is the sum over its words. The vocabulary holds every byte, so each word has a
segmentation. A word of more than ``PART`` bytes (a run without white space) is scored in parts that end between
characters and, but for the first, have no leading space; segmentations across these ends, and vocabulary pieces of more
than ``PART`` bytes, aren't summed.

Training is one expectation step from equal piece probabilities, by forward and backward sums over all rows that may be
learned from: expected piece counts, weighted by the languages' word counts, aggregated as (language, piece) rows. The
model is mixed with a share ``EVEN`` of equal chances, whatever the counts, so that no part's probability is less than
(EVEN / pieces) ** (PART + 1), which a double holds. It has as many numbers as there are pieces and languages. Workers
handle each distinct word of a chunk once, all words of a length together. Of languages that tie the first by name is taken.

Learned from: text with a non-null language and a doc_id whose crc32 (as text) mod 5 isn't 0; null ids aren't. Null text
and text without a letter is ``und`` with score 0, as is all text if nothing could be learned. Repeated rows count as often
as they occur. An empty table gives an empty result. Other columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pandas import factorize
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm._common import LOWER, Words, chunks, in_chunks, others, raw, rows

RESULT = ("held_out", "lang_pred", "score")
PART = 32
#: Text handled at once: the more, the fewer words are scored again.
CHUNK = 2 << 20
#: Share of equal chances in the model.
EVEN = 1e-3
UNKNOWN = "und"
ASCII_LETTER = re.compile(b"[A-Za-z]")
BITS = 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """The vocabulary's pieces by number from 1, found by the polynomial hash of their bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            found = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
        self.pieces = sorted(x for x in {*found, *(bytes([b]) for b in range(256))} if len(x) <= PART + 1)
        self.longest = max(map(len, self.pieces))
        self.sizes = np.isin(np.arange(self.longest + 1), [len(x) for x in self.pieces])
        keys = np.array([int(self.prefix(np.frombuffer(x, np.uint8)[None])[0, -1]) for x in self.pieces], np.uint64)
        self.tables = []
        left = np.arange(1, len(keys) + 1, dtype=np.int32)
        while len(left):  # what finds its slot taken goes to the next table
            shift = np.uint64(64 - BITS - len(self.tables))
            slots = self._slots(keys[left - 1], shift, len(self.tables))
            _, first = np.unique(slots, return_index=True)
            table, number = np.zeros(1 << (BITS + len(self.tables)), np.uint64), np.zeros(1 << (BITS + len(self.tables)), np.int32)
            table[slots[first]], number[slots[first]] = keys[left[first] - 1], left[first]
            self.tables.append((shift, table, number))
            left = np.delete(left, first)

    @staticmethod
    def _slots(keys: np.ndarray, shift: np.uint64, turn: int) -> np.ndarray:
        return (keys * np.uint64(0xBF58476D1CE4E5B9 + 2 * turn) >> shift).astype(np.int64)

    @staticmethod
    def prefix(words: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of words of one length."""
        out = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
        for i in range(words.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + words[:, i] + np.uint64(1)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers; 0 where there is none."""
        out = np.zeros(len(keys), np.int32)
        for turn, (shift, table, number) in enumerate(self.tables):
            slots = self._slots(keys, shift, turn)
            out = np.where(table[slots] == keys, number[slots], out)
        return out

    def arcs(self, words: np.ndarray):
        """(start, end, rows, pieces) of the pieces in words of one length, by end, then start."""
        prefix, n = self.prefix(words), words.shape[1]
        power = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if not self.sizes[end - start]:
                    continue
                piece = self.find(prefix[:, end] - prefix[:, start] * power[end - start])
                hit = np.flatnonzero(piece)
                if len(hit):
                    yield start, end, hit, piece[hit]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """Loaded once in a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def parts_of(word: bytes) -> list[bytes]:
    """A long word's parts of at most ``PART`` bytes, which end between characters."""
    out, begin = [], 0
    while begin < len(word):
        end = begin + PART
        if end < len(word):
            while end > begin + PART - 4 and word[end] & 0xC0 == 0x80:
                end -= 1
        out.append(word[begin:end])
        begin = end
    return out


#: A byte that no text has at a word's begin, which marks a part that has no leading space.
INNER = b"\xff"


def distinct_words(texts: list[bytes]):
    """Word codes, the texts' bounds among them, and the distinct words as (codes, matrix of bytes) by length."""
    parts = []
    for text in texts:
        text = text.translate(LOWER)
        parts.append(b" ".join(x if len(x) <= PART else (b" " + INNER).join(parts_of(x)) for x in text.split()))
    words = Words(parts)
    codes, _ = factorize(words.hashes)
    first = np.flatnonzero(codes > np.concatenate([[-1], np.maximum.accumulate(codes)[:-1]])) if len(codes) else np.empty(0, np.int64)
    inner = words.data[words.starts[first]] == INNER[0] if len(first) else np.empty(0, bool)
    groups = []
    for size in np.unique(words.sizes[first]):
        for marked in (False, True):
            own = np.flatnonzero((words.sizes[first] == size) & (inner == marked))
            if len(own):
                matrix = words.data[words.starts[first[own]][:, None] + np.arange(size)]
                groups.append((own, matrix[:, 1:] if marked else np.concatenate([np.full((len(own), 1), 32, np.uint8), matrix], axis=1)))
    return codes, words.bounds, groups


def forward(vocabulary: Pieces, words: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of words of one length; chance: pieces (0: none) by languages."""
    alpha = np.zeros((words.shape[1] + 1, words.shape[0], chance.shape[1]))
    alpha[0] = 1
    for start, end, hit, piece in vocabulary.arcs(words):
        alpha[end, hit] += alpha[start, hit] * chance[piece]
    return np.log(alpha[-1])


def expected(vocabulary: Pieces, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces by languages) of words of one length and their weights, all pieces being alike."""
    even, n = 1 / len(vocabulary.pieces), words.shape[1]
    arcs = list(vocabulary.arcs(words))
    alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    alpha[0] = beta[n] = 1
    for start, end, hit, _ in arcs:
        alpha[end, hit] += alpha[start, hit] * even
    for start, end, hit, _ in sorted(arcs, key=lambda x: (-x[0], -x[1])):
        beta[start, hit] += beta[end, hit] * even
    piece = np.concatenate([x[3] for x in arcs])
    word = np.concatenate([x[2] for x in arcs])
    gamma = np.concatenate([alpha[s, h] * beta[e, h] for s, e, h, _ in arcs]) * even / alpha[n, word]
    return np.stack([np.bincount(piece, gamma * weight[word, k], len(vocabulary.pieces) + 1) for k in range(weight.shape[1])], axis=1)


def _gather(path: str):
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.float64())])

    def run(batches):
        vocabulary = pieces(path)
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(vocabulary.pieces) + 1))
        for batch in chunks(batches, limit=CHUNK):
            lang, names = factorize(np.array(batch.column("lang").to_pylist(), object))
            codes, bounds, groups = distinct_words(raw(batch))
            if not len(codes):
                continue
            by_word = np.repeat(lang, np.diff(bounds))
            weight = np.bincount(codes * len(names) + by_word, minlength=(codes.max() + 1) * len(names)).reshape(-1, len(names)).astype(float)
            total = sum(expected(vocabulary, matrix, weight[own]) for own, matrix in groups)
            for k, name in enumerate(names):
                held[name] += total[:, k]
        for name, counts in held.items():
            own = np.flatnonzero(counts)
            yield rows(schema, lang=pa.array([name] * len(own), pa.string()), piece=pa.array(own.astype(np.int32)), n=pa.array(counts[own]))

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def learn(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and piece chances (row 0: none) by languages, from rows (text, lang)."""
    counted = docs.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_gather(path), "lang string, piece int, n double")
    found = counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages
    names, n = sorted(found["lang"].unique()), len(pieces(path).pieces)
    chance = np.zeros((n + 1, len(names)))
    chance[found["piece"].to_numpy(int), [names.index(x) for x in found["lang"]]] = found["n"].to_numpy(float)
    chance = (1 - EVEN) * chance / chance.sum(axis=0) + EVEN / n
    chance[0] = 0
    return names, chance


def _letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def classify(vocabulary: Pieces, texts: list[bytes], names: list[str], chance: np.ndarray) -> tuple[list[str], list[float]]:
    """Languages of texts, and the chance of each among all languages."""
    codes, bounds, groups = distinct_words(texts)
    logs = np.zeros((codes.max() + 1 if len(codes) else 0, len(names)))
    for own, matrix in groups:
        logs[own] = forward(vocabulary, matrix, chance)
    total = np.concatenate([np.zeros((1, len(names))), np.cumsum(logs[codes], axis=0)]) if len(codes) else np.zeros((1, len(names)))
    out, score = [], []
    for text, begin, end in zip(texts, bounds, bounds[1:], strict=False):
        if not names or not _letter(text):
            out.append(UNKNOWN)
            score.append(0.0)
            continue
        own = total[end] - total[begin]
        best = int(own.argmax())
        out.append(names[best])
        score.append(float(1 / np.exp(own - own[best]).sum()))
    return out, score


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with held_out, lang_pred and score."""
    path = path or default_vocabulary()
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    names, chance = learn(docs.where(remainder != 0).select("text", "lang"), path)
    model = docs.sparkSession.sparkContext.broadcast((names, chance))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def found(text: pa.Array) -> pa.Array:
        def judged(chunk: pa.RecordBatch) -> pa.Array:
            langs, scores = classify(pieces(path), raw(chunk), *model.value)
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

        return in_chunks(judged, text, limit=CHUNK)

    keep = [F.col(f"`{c}`") for c in others(docs, RESULT)]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return docs.select(*keep, held, found("text").alias("_made")).select(*keep, "held_out", "_made.*")
