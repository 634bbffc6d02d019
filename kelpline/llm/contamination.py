"""Evaluation passages leaking into training text (problem 8).

SimHash of item-sized windows.  Every item is cut, at each of its tokens, into windows
of a size that goes with its length: its PARTS-th part, taken down to the next size of
a short ladder (WORDS, 1.5 times that, twice that, ...; CHARACTERS likewise for items in
scripts without word spaces).  Documents are cut, at each token, into windows of the
sizes in use.  A window's fingerprint is 64 bits of the weighted sum of its tokens'
hashes.  Fingerprints are cut into ``radius + 1`` blocks; two within the radius agree
in at least one block, so looking up every block finds them all.

Candidates within the radius are verified by the exact weighted-shingle similarity of
the two windows: shingles of SHINGLE tokens, each weighing what its tokens weigh, shared
weight over united weight, SIMILARITY or more.  Of a document and item with such a
window pair the rule of the problem is checked last and exactly, over the whole
document: runs of the item's own words, WORDS or more each, that make up SHARE of it.

What is found.  A run at least as long as the item's window contains a whole window,
whose fingerprint is equal, so it is always a candidate.  An item that stands in a
document only in shorter runs (items of PARTS * 1.5 * WORDS tokens and more, all runs
shorter than their windows) is a candidate where a window that spans an edit is within
the radius and similar enough; the longer the windows the likelier.

The items are the query set.  They are taken in blocks of bounded size; each block's
index travels with the tasks of one pass over the documents.  No document fingerprint
leaves its task.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.frames import pick

#: Tokens of the shortest run that counts, and the share of the item that runs must make up.
WORDS, CHARACTERS = 8, 14
SHARE = (1, 4)
#: An item's windows are this part of it, WORDS or CHARACTERS at least: runs that make up a
#: quarter of an item may be several.
PARTS = 8
RADIUS = 3
#: Tokens of a shingle, and the weighted similarity that makes two windows a match.
SHINGLE, SIMILARITY = 5, 0.8
#: Items whose index travels at once, and the bytes of text they have together (on average: items go
#: to blocks by a hash of their id, and one item is never split).  An index has 40 bytes a window and
#: 8 a token, about 10 bytes per byte of text: 20 MB a block.
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 2_000_000

#: Bytes of neighbouring texts searched at once.
GROUP_BYTES = 100_000
#: Windows handled at once; bounds memory however long a text is.
CHUNK = 8_192
#: Largest window: sums of its weights stay within 16 bits.
LONGEST = 8_192

UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}ー々〆"
_MARKUP = (
    (regex.compile(r"<!--.*?-->", regex.S), " "),
    (regex.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)"), r"\1"),
    (regex.compile(r"!?\[([^\[\]]*)\]\[[^\[\]]*\]"), r"\1"),
    (regex.compile(r"</?[A-Za-z][^<>]*>"), ""),
)
#: Format characters, the grapheme joiner, Hangul fillers, and variation selectors.
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]")
_ENTITY = regex.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z]+);")
_TOKEN = regex.compile(rf"(?V1)[{UNSPACED}]|[[\p{{L}}\p{{N}}\p{{M}}]--[{UNSPACED}]]+")
_ASCII_TOKEN = re.compile("[a-z0-9]+")
_CHARACTER = regex.compile(r"[\p{L}\p{N}\p{M}]")
_HAS_UNSPACED = regex.compile(rf"[{UNSPACED}]")


def plain(text: str) -> str:
    """*text* without what is set aside: markup and link targets, invisible characters,
    width and composition, case.  Punctuation and white space go when tokens are cut."""
    if "<" in text or "](" in text or "][" in text:
        for pattern, to in _MARKUP:
            text = pattern.sub(to, text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
    return unicodedata.normalize("NFKC", folded)


@lru_cache(maxsize=200_000)
def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode())


def words(text: str) -> np.ndarray:
    """Hashes of the words of a plain text; a character written without spaces is a word."""
    return np.array([_hash(t) for t in (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text)], np.uint64)


def characters(text: str) -> np.ndarray:
    return np.array([_hash(t) for t in _CHARACTER.findall(text)], np.uint64)


def weights(tokens: np.ndarray) -> np.ndarray:
    """1 to 3 by the token's own hash, so that windows of equal tokens weigh alike and ties are few."""
    return (tokens % np.uint64(3)).astype(np.int16) + 1


def window_size(tokens: int, shortest: int) -> int:
    """Size of the windows of an item of so many tokens: the largest of shortest * 1, 1.5, 2, 3, 4, 6, ...
    that is no more than its PARTS-th part; *shortest* at least."""
    size = step = shortest
    while size + step // 2 <= min(tokens // PARTS, LONGEST):
        size, step = (size + step // 2, step) if size == step else (2 * step, 2 * step)
    return size


def fingerprints(tokens: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, first window, SimHash of each window from there on) of all windows of *sizes* tokens.

    A fingerprint is the majority, by weight, of the tokens' hash bits.  Sums run along the
    text once, CHUNK windows at a time, and serve all sizes; they wrap around within 16
    bits, which their differences do not feel.
    """
    for at in range(0, len(tokens) - min(sizes) + 1, CHUNK):
        part = tokens[at : at + CHUNK + max(sizes) - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
        total = np.zeros((len(part) + 1, 64), np.int16)
        np.cumsum((bits * np.int8(2) - np.int8(1)) * weights(part)[:, None], axis=0, dtype=np.int16, out=total[1:])
        for size in sizes:
            n = min(CHUNK, len(part) - size + 1)
            if n > 0:
                yield size, at, np.packbits(total[size : size + n] - total[:n] > 0, axis=1).view(np.uint64).ravel()


class Index:
    """Windows of one size of the items of one block, with a lookup table per fingerprint block."""

    def __init__(self, size: int, tokens: dict[int, np.ndarray], radius: int):
        """*tokens*: of each item (by its row) that has windows of this size."""
        self.size, self.radius = size, radius
        held = {i: t for i, t in tokens.items() if len(t) >= size}
        counts = [len(t) - size + 1 for t in held.values()]
        self.items = np.repeat(np.array(list(held), np.int32), counts)
        self.places = np.concatenate([np.arange(n, dtype=np.int32) for n in counts] or [np.empty(0, np.int32)])
        prints = [p for t in held.values() for _, _, p in fingerprints(t, [size])]
        self.prints = np.concatenate(prints or [np.empty(0, np.uint64)])
        self.width = 64 // (radius + 1)
        self.tables = []
        for b in range(radius + 1):
            keys = self._block(self.prints, b)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            starts = np.searchsorted(keys[order], np.arange((1 << self.width) + 1, dtype=np.uint64)).astype(np.int32) if self.width <= 16 else None
            self.tables.append((keys[order] if starts is None else None, order, starts))

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) pairs within the radius, each at least once."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for b, (keys, order, starts) in enumerate(self.tables):
            wanted = self._block(prints, b)
            if starts is None:
                start, end = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            else:
                start, end = starts[wanted], starts[wanted + np.uint64(1)]
            count = end - start
            hit = np.flatnonzero(count)
            many = count[hit]
            doc = np.repeat(hit, many)
            step = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            item = order[np.repeat(start[hit], many) + step]
            near = np.bitwise_count(prints[doc] ^ self.prints[item]) <= self.radius
            left.append(doc[near])
            right.append(item[near])
        return np.concatenate(left), np.concatenate(right)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted similarity of two token sequences: the weight of the shingles both have over
    that of all shingles of either, repeated shingles counted as often as they stand."""
    size = min(SHINGLE, len(a), len(b))
    mine, yours = (Counter(map(tuple, _windows(t, size).tolist())) for t in (a, b))
    heavy = lambda c: sum(n * sum(t % 3 + 1 for t in s) for s, n in c.items())
    return heavy(mine & yours) / max(1, heavy(mine | yours))


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    if len(tokens) < size:
        return np.empty((0, size), np.uint64)
    return np.lib.stride_tricks.sliding_window_view(tokens, size)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _rolled(tokens: np.ndarray, run: int) -> np.ndarray:
    """A number per window of *run* tokens, equal for equal windows."""
    n = len(tokens) - run + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(run if n > 0 else 0):
        out = out * _FACTOR + tokens[k : k + n]
    return out


def covered(item: np.ndarray, text: np.ndarray, run: int) -> int:
    """How many tokens of *item* lie in runs of *run* or more that *text* has in the same order."""
    mine, yours = _rolled(item, run), _rolled(text, run)
    if not len(mine) or not len(yours):
        return 0
    order = np.argsort(yours, kind="stable")
    at = order[np.minimum(np.searchsorted(yours[order], mine), len(yours) - 1)]
    same = (_windows(item, run) == _windows(text, run)[at]).all(axis=1)
    marks = np.zeros(len(item) + 1, np.int32)
    np.add.at(marks, np.flatnonzero(same), 1)
    np.add.at(marks, np.flatnonzero(same) + run, -1)
    return int((np.cumsum(marks) > 0).sum())


@dataclass
class Side:
    """The items of one sort of tokens: words, or characters for scripts without word spaces."""

    run: int
    tokens: dict[int, np.ndarray]
    radius: int
    indexes: list[Index] = field(default_factory=list)

    def __post_init__(self) -> None:
        sized: dict[int, dict[int, np.ndarray]] = {}
        for i, t in self.tokens.items():
            if len(t) >= self.run:
                sized.setdefault(window_size(len(t), self.run), {})[i] = t
        self.indexes = [Index(size, held, self.radius) for size, held in sorted(sized.items())]

    def found(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(place in *texts*, item) pairs.  Texts are put end to end and searched in one go;
        windows across two texts do not count."""
        if not self.indexes:
            return set()
        joined = np.concatenate([*texts, np.empty(0, np.uint64)])
        text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        matched: set[tuple[int, int]] = set()
        by_size = {index.size: index for index in self.indexes}
        for size, at, prints in fingerprints(joined, list(by_size)):
            index = by_size[size]
            near, window = index.lookup(prints)
            near = near + at
            inside = text_of[near] == text_of[near + size - 1]
            for place, w in zip(near[inside].tolist(), window[inside].tolist()):
                pair = int(text_of[place]), int(index.items[w])
                if pair not in matched:
                    q = int(index.places[w])
                    mine, yours = self.tokens[pair[1]][q : q + size], joined[place : place + size]
                    if (mine == yours).all() or similarity(mine, yours) >= SIMILARITY:
                        matched.add(pair)
        return {
            (text, item) for text, item in matched
            if covered(self.tokens[item], texts[text], self.run) * SHARE[1] >= len(self.tokens[item]) * SHARE[0]
        }


@dataclass
class Matcher:
    """Finds, in any document, the items of one block."""

    ids: list[int]
    by_words: Side
    by_characters: Side

    @classmethod
    def of(cls, items: list[tuple[int, str]], radius: int = RADIUS) -> Matcher:
        texts = [plain(t or "") for _, t in items]
        # An item is written without word spaces if most of its tokens are single such characters.
        unspaced = [2 * len(_HAS_UNSPACED.findall(t)) > len(_TOKEN.findall(t)) for t in texts]
        w = {i: words(t) for i, (t, u) in enumerate(zip(texts, unspaced)) if not u}
        c = {i: characters(t) for i, (t, u) in enumerate(zip(texts, unspaced)) if u}
        return cls([i for i, _ in items], Side(WORDS, w, radius), Side(CHARACTERS, c, radius))

    def found(self, texts: list[str]) -> list[tuple[int, int]]:
        """(place in *texts*, row of the item) pairs; items of which a text holds the share."""
        texts = [plain(t) for t in texts]
        out = self.by_words.found([words(t) for t in texts])
        # Items in the character index are mostly such characters; a text without any cannot hold a window.
        if self.by_characters.indexes:
            none = np.empty(0, np.uint64)
            out |= self.by_characters.found([characters(t) if _HAS_UNSPACED.search(t) else none for t in texts])
        return sorted(out)


def leaked_items(documents: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id: documents carrying runs of an item that make up its share.

    A run is in the item's own order and at least WORDS words (CHARACTERS characters
    for items mostly in scripts without spaces) long; an item's tokens count once
    however often they are found.  Null and empty texts, items with fewer tokens than a
    run, and null item ids match nothing.  Repeated rows give their pairs once each
    per document row; of an item_id given twice each text counts, and a document row has the
    pair once: all texts of an item_id are in one block, so the result is the same whatever the blocks.
    """
    docs = pick(documents, "doc_id", "text").where("text IS NOT NULL AND text <> ''")
    asked = pick(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.b // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        matcher = Matcher.of(sorted((r.item_id, r.text) for r in part.collect()), radius)
        found = docs.mapInArrow(_search(documents.sparkSession.sparkContext.broadcast(matcher)), "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    return out


def _search(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Matcher = matcher.value
        for batch in batches:
            docs, found = [], []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for group in _groups(texts):
                pairs = m.found([t.as_py() for t in texts[group.start : group.stop]])
                for doc, item_id in {(group.start + place, m.ids[row]) for place, row in pairs}:
                    docs.append(ids[doc])
                    found.append(item_id)
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return run


def _groups(texts: pa.Array) -> Iterator[range]:
    """Neighbouring texts of about GROUP_BYTES together, or one longer text."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += text.as_buffer().size
        if total >= GROUP_BYTES:
            yield range(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))
