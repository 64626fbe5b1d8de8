"""Harmonic packing: every worker fills sequences of its own, class by class, with a fixed number of pieces for each class.

A document's tokens are cut greedily into lengths floor(capacity / k), the largest that still fits first: 2048, 1024, 682,
512, 409, ... Class k takes the pieces of that length, and k of them fill a sequence but for fewer than k tokens. So a
sequence is known to be full by counting, and no worker needs another's: there is no shuffle. When a worker's share
ends, the fewer than k pieces that each class still holds (some thousand pieces in all, whatever the share's size) go
into common sequences, the longest first, each to the first sequence with room.

Null text is empty; it gives a piece that holds the end token only. Repeated rows are packed as often as they occur; a
null doc_id is kept. Pieces of equal length are packed in the order in which they come. One very long text takes some fifty
times its size in one worker. An empty table gives no piece. Sequence ids are unique and depend on how the table is
partitioned. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pandas import factorize
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm._common import chunks, lists, raw, rows

CAPACITY, END = 2048, 1
#: Bytes of the longest word, with its space, that is known by a hash.
LONGEST = 1024
#: Text handled at once: the more, the fewer words are merged again, but arrays of some 40 bytes a byte are made of it.
CHUNK = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
IDS = ", ids array<int>"
#: Pieces, and tokens of pieces with their ids, that are passed on at once.
MOST_PIECES, MOST_TOKENS = 20_000, 1 << 20
GAP, LETTER, DIGIT, OTHER = range(4)
#: What an ASCII byte is to the tokenizer's word pattern; all other bytes of plain texts belong to letters.
KIND = np.array([GAP if x in b" \t\n\r\x0b\x0c" else LETTER if x >= 128 or chr(x).isalpha() else DIGIT if 48 <= x <= 57 else OTHER for x in range(256)], np.uint8)
#: Bytes of texts that aren't plain: controls that only some count as white space, and those outside U+0000-007F and U+00C0-01FF.
ODD = np.array([0x1C <= x <= 0x1F or x == 0xC2 or x >= 0xC8 for x in range(256)])


def byte_symbols() -> dict[str, int]:
    """Byte-level BPE's printable characters and the bytes that they stand for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """The ids of texts as little-endian 32-bit values, equal to those of the tokenizer file in ``tokenizers``.

    Plain texts (ASCII and Latin letters, without contractions and special tokens) are cut into words here, each closed by
    a space in place of the file's end-of-word mark. ``tiktoken``, with the file's merges as ranks, merges each distinct
    word (by a 64-bit hash) of a chunk once. All other texts go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        symbols = byte_symbols()
        vocab, mark, merges = model["vocab"], model["end_of_word_suffix"], model["merges"]
        ranks = {bytes([b]): b for b in range(256)}
        self.ids = np.zeros(512 + len(merges), "<u4")
        for symbol, b in symbols.items():
            self.ids[b], self.ids[256 + b] = vocab[symbol], vocab[symbol + mark]
            if b != 32:
                ranks[bytes([b, 32])] = 256 + b
        for i, pair in enumerate(merges):
            made = "".join(pair if isinstance(pair, list) else pair.split(" "))
            ranks.setdefault(bytes(symbols[c] for c in made.removesuffix(mark)) + b" " * made.endswith(mark), 512 + i)
            self.ids[512 + i] = vocab[made]
        self.closes = np.zeros(len(self.ids), bool)
        self.closes[[rank for made, rank in ranks.items() if made.endswith(b" ")]] = True
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.factors = np.random.default_rng(7).integers(1, 2**64, LONGEST, np.uint64) | np.uint64(1)

    def _other(self, text: bytes) -> bytes:
        """The ids of any text. The tokenizer is loaded for the first of these."""
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, texts: list[bytes]) -> list[bytes | None]:
        """The ids of plain texts; None for those with words that are too long for a hash."""
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind = KIND[joined]
        kept = kind != GAP
        closed = kept & ((np.append(kind[1:], GAP) != kind) | (kind == DIGIT))
        at = np.cumsum(kept.view(np.uint8) + closed.view(np.uint8), dtype=np.int32)
        words = np.full(at[-1], 32, np.uint8)  # each word and a space
        words[at[kept] - closed[kept] - 1] = joined[kept]
        ends = at[closed]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int32)
        sizes = ends - starts
        bounds = np.searchsorted(ends, np.concatenate([[0], at[np.cumsum([len(x) + 1 for x in texts]) - 1]]), side="right")
        if not len(ends):
            return [b""] * len(texts)
        place = np.arange(len(words), dtype=np.int32) - np.repeat(starts, sizes)
        hashes = np.add.reduceat((words + np.uint64(1)) * self.factors[np.minimum(place, LONGEST - 1)], starts)
        codes, _ = factorize(hashes)
        first = np.flatnonzero(codes > np.concatenate([[-1], np.maximum.accumulate(codes)[:-1]]))
        size = sizes[first]
        held = words[np.repeat(starts[first] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        ranks = self.merger.encode_to_numpy(held.tobytes().decode())
        ids = self.ids[ranks]
        stop = 1 + np.flatnonzero(self.closes[ranks])
        begin = np.concatenate([[0], stop[:-1]])
        count = (stop - begin)[codes]
        last = np.concatenate([[0], np.cumsum(count)])
        flat = ids[np.repeat(begin[codes] - last[:-1], count) + np.arange(last[-1])].tobytes()
        bounds = bounds.tolist()
        longest = np.maximum.reduceat(np.append(sizes, 0), np.minimum(bounds[:-1], len(sizes))).tolist()
        last = (4 * last[bounds]).tolist()
        return [None if y > x and most > LONGEST else flat[i:j] for x, y, most, i, j in zip(bounds, bounds[1:], longest, last, last[1:], strict=False)]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, without an end token."""
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        after = np.append(joined[1:], 0).astype(np.uint8)
        odd = ODD[joined] | (joined == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (joined == 0xC4) & (after == 0xB0)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        odd = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
        odd = odd[starts[1:]] > odd[starts[:-1]]
        plain = [i for i, x in enumerate(texts) if not odd[i] and b"'" not in x and b"<|" not in x]
        found = dict(zip(plain, self._plain([texts[i].lower() if texts[i].isascii() else texts[i].decode().lower().encode() for i in plain]), strict=True)) if plain else {}
        return [self._other(text) if (ids := found.get(i)) is None else ids for i, text in enumerate(texts)]


def lengths(capacity: int) -> list[int]:
    """The pieces' lengths: capacity / k, rounded down, for each k."""
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """Loaded once in a worker process."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _pack(tokenizer: str, capacity: int, end: int, with_ids: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kind = pa.schema([*((c, pa.int64()) for c in names), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    cuts = np.zeros(capacity + 1, np.int64)
    for one in lengths(capacity):
        cuts[one:] = np.maximum(cuts[one:], one)
    cuts = cuts.tolist()

    def run(batches):
        ids, last = word_ids(tokenizer), int(end).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}
        out: list[tuple] = []
        tokens = 0

        def batch():
            nonlocal tokens
            *columns, ids = zip(*out, strict=True)
            made = dict(zip(names, (pa.array(x, pa.int64()) for x in columns), strict=True))
            if with_ids:
                made["ids"] = lists(np.frombuffer(b"".join(ids), np.int32), [len(x) // 4 for x in ids], pa.int32())
            out.clear()
            tokens = 0
            return rows(kind, **made)

        def add(piece: tuple, sequence: int, offset: int) -> None:
            nonlocal tokens
            out.append((*piece[:-1], sequence, offset, piece[-1]))
            tokens += piece[2]

        for part in chunks(batches, limit=CHUNK):
            for doc, own in zip(part.column("doc_id").to_pylist(), ids.of(raw(part)), strict=True):
                own += last
                n, at = len(own) // 4, 0
                while at < n:
                    size = cuts[min(capacity, n - at)]
                    wait = held.setdefault(size, [])
                    piece = own[4 * at : 4 * (at + size)]
                    wait.append((doc, at, size, zlib.crc32(piece), n, piece if with_ids else b""))
                    at += size
                    if len(wait) == capacity // size:
                        for i, x in enumerate(wait):
                            add(x, sequence, i * size)
                        wait.clear()
                        sequence += 1
                        if len(out) >= MOST_PIECES or with_ids and tokens >= MOST_TOKENS:
                            yield batch()
        room: list[list[int]] = []  # sequence, tokens so far
        for size in sorted(held, reverse=True):
            first = 0
            for x in held[size]:
                while first < len(room) and room[first][1] + size > capacity:
                    first += 1
                if first == len(room):
                    room.append([sequence, 0])
                    sequence += 1
                add(x, *room[first])
                room[first][1] += size
                if with_ids and tokens >= MOST_TOKENS:
                    yield batch()
        if out:
            yield batch()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece: its document, place, length, checksum of its ids, and its sequence and offset there; and its ids if wanted."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, capacity, end, with_ids), SCHEMA + IDS * with_ids)
