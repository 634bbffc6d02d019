"""Byte-level BPE encoding by a priority queue over a linked symbol list (problem 7).

Text is cut by the vocabulary's pre-tokenizer pattern.  Each piece starts as a doubly
linked list of its bytes; a heap holds the mergeable neighbours by rank, then place.
The least rank is merged, its new neighbours are pushed, and entries whose symbols
have changed since are skipped as stale.  Decoding concatenates the vocabulary's
byte strings.

Two exact short cuts keep this affordable: a piece is first cut between bytes that no
vocabulary entry holds side by side (no merge can cross there), and encoded segments
are remembered per Python worker, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kelpline.functions.frames import pick

#: Fixed value: the pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered segments per Python worker; the memory of full tables is let go at once.
REMEMBERED = 400_000
_LOADED: dict[str, ByteBPE] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file installed beside Python; never copied here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ByteBPE:
    """A vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.adjacent = {b[i : i + 2] for b in ranks if len(b) > 1 for i in range(len(b) - 1)}
        self.known: dict[str, array] = {}
        self.segments: dict[bytes, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        """The vocabulary at *path*, once per process."""
        with open(path, "rb") as f:
            return cls.of(f.read())

    @classmethod
    def of(cls, data: bytes) -> ByteBPE:
        """The vocabulary of a file's content (lines of base64 bytes and rank), once per process."""
        key = hashlib.sha256(data).hexdigest()
        if key not in _LOADED:
            pairs = (line.split() for line in data.splitlines() if line.strip())
            _LOADED[key] = cls({base64.b64decode(b): int(r) for b, r in pairs})
        return _LOADED[key]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one segment: the linked list and heap described above."""
        ranks, n = self.ranks, len(piece)
        symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                queue.append((rank, i, 2))
        heapq.heapify(queue)
        while queue:
            rank, i, size = heapq.heappop(queue)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            # Stale: the left symbol, or the one after it, was merged since this entry was pushed.
            if j >= n or len(left) + len(symbols[j]) != size:
                continue
            left = symbols[i] = left + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = left + symbols[k]
                rank = ranks.get(pair)
                if rank is not None:
                    heapq.heappush(queue, (rank, i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + left
                rank = ranks.get(pair)
                if rank is not None:
                    heapq.heappush(queue, (rank, h, len(pair)))
        return [ranks[s] for s in symbols if s is not None]

    def encode_piece(self, piece: str) -> array:
        data, adjacent, segments = piece.encode(), self.adjacent, self.segments
        out, start = array("i"), 0
        for i in range(1, len(data) + 1):
            if i == len(data) or data[i - 1 : i + 1] not in adjacent:
                segment = data[start:i]
                ids = segments.get(segment)
                if ids is None:
                    ids = self.merge(segment)
                    if len(segments) >= REMEMBERED:
                        segments.clear()
                    if len(segment) <= 64:
                        segments[segment] = ids
                out.extend(ids)
                start = i
        return out

    def encode(self, text: str) -> array:
        known, out = self.known, array("i")
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 32:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Ids unknown to the vocabulary give nothing; broken UTF-8 gives U+FFFD."""
        strings = self.strings
        return b"".join(strings.get(i, b"") for i in ids).decode("utf-8", "replace")


#: Largest vocabulary file; it travels to the executors, which need not have it.
MAX_VOCABULARY_BYTES = 32 << 20


def _shared(df: DataFrame, path: str | None):
    """The vocabulary file at *path* on the driver, broadcast."""
    path = path or vocabulary_path()
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (ARRAY<INT>, no special tokens) of every row, in a single pass.

    Null and empty texts give an empty list.  The strings of special tokens in a text
    are ordinary text.  Repeated rows are encoded each.  Nothing is shuffled.
    """
    vocabulary = _shared(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(vocabulary.value)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column("text"):
                text = text.as_py()
                if text:
                    ids += bpe.encode(text)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return pick(documents, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids); a null list gives an empty text."""
    vocabulary = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(vocabulary.value)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
