"""Sentence units across languages and scripts (problem 9).

Text is cut into blocks (paragraphs, headings, list items, fenced code).  Within a
paragraph or item every mark that may end a sentence, outside matched quotes and
brackets, is a candidate boundary.  Two maximum-entropy classifiers judge it:

* *ending*: from what stands before it (mark, token, its length, case, digits and
  script, the token before, the kind of quote or bracket just closed).  Its reliable
  examples are ends of blocks.  Boundaries inside blocks are not labelled, so the
  classifier learns ``P(end of block)``, which is ``P(boundary)`` times a constant,
  the share of sentence ends that end a block; dividing by it gives P(boundary).
* *starting*: from what stands after it (case, digits, kind and script of the next
  token).  Its reliable examples are first tokens of blocks, against tokens that
  follow a plain word.

The sum of both log odds decides.  No list of abbreviations is used: a token that
never ends a block has a low P(boundary).

Both are fitted on a bounded sample of documents (about SAMPLE rows, drawn by a threshold
on a hash, each with its whole text); examples are counted where the texts are, and only
the counts reach the driver.  All rows are cut, in one pass.  ``p9_found`` fits at call
time; ``save`` and ``load`` keep a fitted model, so that a document gets the same units
whatever the table it stands in.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.frames import pick

#: Rows the classifiers are fitted on, each with its whole text.
SAMPLE = 4_000

#: Tasks that count the examples of the sample.
FIT_TASKS = 8

#: Quantile of P(end of block) among ends of blocks that stands for a sure sentence end.
SHARE_QUANTILE = 0.15
#: Log odds by which undecided candidates count as boundaries: tokens that end sentences and
#: abbreviate too are found at ends of blocks less often than the share says.
LEANING = 0.4

PAIRS = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}", "《": "》", "〈": "〉", "【": "】", "‘": "’", "„": "“”", "‚": "‘’"}
CLOSERS = "”»›」』）)]}》〉】’\"'"
TRAILING = CLOSERS + "*_"
#: Marks after which scripts without word spaces need no space.
WIDE = "。！？｡"
TERMINAL = ".!?…‼⁇⁈⁉。！？｡।॥؟۔።፧"
#: Ends before white space or a closer (wide ones anywhere), quotes and brackets, and white space between Thai letters.
_MARK = re.compile(
    r"(?P<end>[.!?…‼⁇⁈⁉。！？｡।॥؟۔።፧]+(?=[\s”»›」』）)\]}》〉】’\"'*_]|\Z)|[.!?…‼⁇⁈⁉।॥؟۔።፧]*[。！？｡][.!?…‼⁇⁈⁉。！？｡।॥؟۔።፧]*)|(?P<quote>[“”«»‹›「」『』（）()\[\]{}《》〈〉【】‘’„‚\"'])|(?P<thai>(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎]))"
)
BULLETS = "-*+•‣◦·"
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"\s*#{1,6}(?:\s|$)")
_BULLET = re.compile(r"\s*[-*+•‣◦·](?:\s+)(?=\S)")
_ORDERED = re.compile(r"\s*\d{1,9}[.)](?:\s+)(?=\S)")
_NUMBER = re.compile(r"\d+")
_UNDERLINE = re.compile(r"\s*(?:=+|-{2,})\s*$")
_QUOTED = re.compile(r"(?:\s*>)+")
_LAST_TOKEN = re.compile(r"[^\s“”«»‹›「」『』（）()\[\]{}《》〈〉【】„‚\"]*$")
_NEXT = re.compile(r"\s*(?:>\s*)*([¡¿“«‹「『（(\[„‚\"'‘*_—–-]*)\s*(\S*)")
_SCRIPTS = regex.compile(
    r"(?P<latin>\p{Latin})|(?P<cyrillic>\p{Cyrillic})|(?P<han>[\p{Han}\p{Hiragana}\p{Katakana}])|(?P<hangul>\p{Hangul})|(?P<arabic>\p{Arabic})|(?P<indic>\p{Devanagari})|(?P<ethiopic>\p{Ethiopic})|(?P<thai>\p{Thai})|(?P<other>\p{L})"
)


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the blocks of *text*: 'code', 'heading', 'item' or 'para'."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    listed = _list_starts([line for _, _, line in lines])
    kind, start, end, i = "", 0, 0, 0
    while i < len(lines):
        a, b, line = lines[i]
        first = line.lstrip()[:1]
        fence = _FENCE.match(line) if first in ("`", "~") else None
        blank = not first
        new = ""
        if fence:
            new = "code"
        elif not blank:
            if first == "#" and _HEADING.match(line):
                new = "heading"
            elif first in BULLETS and _BULLET.match(line) or (first.isdigit() and (kind in ("", "item", "heading") or i in listed) and _ORDERED.match(line)):
                new = "item"
            elif not kind or kind == "heading":
                new = "para"
        if kind and (blank or new):
            yield start, end, kind
            kind = ""
        if new == "code":
            j, mark = i + 1, fence[1]
            while j < len(lines) and not (lines[j][2].strip().startswith(mark) and not lines[j][2].strip().strip(mark[0])):
                j += 1
            last = min(j, len(lines) - 1)
            yield a, lines[last][1], "code"
            i = last + 1
            continue
        if not blank:
            if new:
                kind, start = new, a
            elif kind == "para" and _UNDERLINE.match(line):
                yield start, b, "heading"
                kind, i = "", i + 1
                continue
            end = b
        i += 1
    if kind:
        yield start, end, kind


def _list_starts(lines: list[str]) -> set[int]:
    """Lines that start an ordered list even within a paragraph: the following number starts a later
    line before the next blank one, or the number is 1 and the line above ends in a colon (else a
    number at a line break may be a date or an amount)."""
    found: set[int] = set()
    later: set[int] = set()
    for i in range(len(lines) - 1, -1, -1):
        bare = lines[i].lstrip()
        if not bare:
            later.clear()
        elif bare[0].isdigit() and _ORDERED.match(lines[i]):
            number = int(_NUMBER.match(bare)[0])
            if number + 1 in later or (number == 1 and i and lines[i - 1].rstrip().endswith((":", "："))):
                found.add(i)
            later.add(number)
    return found


def _is_data(part: str) -> bool:
    """A paragraph without letters or digits, or one of JSON."""
    bare = part.strip()
    if bare[:1] in "{[" and bare[-1:] in "}]":
        try:
            json.loads(bare)
            return True
        except ValueError:
            pass
    return not any(c.isalnum() for c in bare)


def _pairs(part: str, marks: list) -> list[tuple[int, int]]:
    """Outermost matched quotes and brackets of a block, as (open, close) places.

    ``waiting`` counts the open marks each closer could close, so that a closer without
    one costs nothing and the work stays linear in any text.
    """
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()
    found: list[tuple[int, int]] = []
    n = len(part)

    def push(c: str, i: int) -> None:
        stack.append((c, i))
        for closer in PAIRS.get(c, c):
            waiting[closer] += 1

    for m in marks:
        if m.lastgroup != "quote":
            continue
        c, i = m[0], m.start()
        before, after = part[i - 1] if i else " ", part[i + 1] if i + 1 < n else " "
        if c in "\"'":
            opens = (before.isspace() or before in "([（「“«—–-") and not after.isspace()
            if c == '"' and before.isspace() and after.isspace():
                opens = not waiting[c]
            if c == "'" and not opens and (before.isspace() or after.isalnum()):
                continue
            if opens and not (c == '"' and waiting[c]):
                push(c, i)
                continue
        elif c == "’" and before.isalnum() and after.isalnum():
            continue
        elif c in PAIRS and not (c in "“‘" and waiting[c]):
            push(c, i)
            continue
        while waiting[c]:
            opener, place = stack.pop()
            closers = PAIRS.get(opener, opener)
            for closer in closers:
                waiting[closer] -= 1
            if c in closers:
                found.append((place, i))
                break
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


_HEX, _JOINED = re.compile(r"(?=.*[a-f])(?=.*[0-9])[0-9a-f]{7,}\Z"), re.compile(r".[./_\\@].")
_ASCII_END, _ASCII_START = re.compile(r"[A-Za-z0-9._/@\\+-]+\Z"), re.compile(r"[A-Za-z0-9._/@\\+-]+")

#: Scripts in which words of another script may stand without a space.
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@lru_cache(maxsize=100_000)
def _shape(token: str) -> str:
    if not token:
        return "none"
    if _HEX.match(token) or (len(token) >= 7 and token.isdigit()):
        return "id"
    if token[0].isdigit():
        return "digit"
    if _JOINED.search(token):
        return "id"
    if token[0].isupper():
        return "upper" if len(token) > 1 else "capital"
    if token[0].islower():
        return "lower"
    return "letter" if token[0].isalpha() else "other"


@lru_cache(maxsize=100_000)
def _script(token: str) -> str:
    m = _SCRIPTS.search(token)
    return m.lastgroup if m else "none"


def _last_script(text: str) -> str:
    """Script of the last letters of *text*."""
    last = text[-1:]
    if last.isascii() and last.isalpha():
        return "latin"
    return next((x for x in (_script(w[::-1]) for w in reversed(text[-60:].split())) if x != "none"), "none")


class Candidate(NamedTuple):
    """A place where a sentence may end, with the features of both classifiers."""

    end: int
    left: tuple[str, ...]
    right: tuple[str, ...]
    final: bool


def candidates(part: str) -> tuple[list[Candidate], list[int]]:
    """Candidate boundaries of a block, and the places after which a rule ends one (Thai spaces)."""
    marks = list(_MARK.finditer(part))
    pairs = _pairs(part, marks)
    closing = {b: a for a, b in pairs}
    out, fixed, p, begun = [], [], 0, 0
    bare_end = len(part.rstrip())
    for m in marks:
        i = m.start()
        while p < len(pairs) and pairs[p][1] < i:
            p += 1
        if p < len(pairs) and pairs[p][0] < i < pairs[p][1]:
            continue
        if m.lastgroup == "thai":
            fixed.append(i)
            continue
        if m.lastgroup == "end":
            end, kind, opened = m.end(), "mark", -1
            core = part[begun : m.start()]
            mark = m[0]
        elif i in closing:
            opened = closing[i]
            inner = part[opened + 1 : i].rstrip()
            tail = inner.rstrip(CLOSERS + " ")
            if not tail or tail[-1] not in TERMINAL:
                continue
            end, kind, core, mark = i + 1, "closed", tail[:-1], tail[-1]
        else:
            continue
        while end < bare_end and part[end] in TRAILING and end not in closing:
            end += 1
        after = part[end] if end < bare_end else ""
        if after and not after.isspace():
            # Only wide marks need no space; a mark that goes on, a comma or a closing pair follows otherwise.
            if mark[-1] not in WIDE or after in TERMINAL or end in closing or _follows(after):
                continue
        left = _left(part, begun, core, mark, kind, opened)
        nxt = _NEXT.match(part, end)
        out.append(Candidate(end, left, _right(nxt[1], nxt[2], left[-1]), end >= bare_end))
        begun = end
    return out, fixed


def _follows(c: str) -> bool:
    return c in ",;:、，；：،؛፣፤—–-" or c in CLOSERS


def _left(part: str, begun: int, core: str, mark: str, kind: str, opened: int) -> tuple[str, ...]:
    spaced = bool(core) and core[-1].isspace()
    tokens = core.rstrip()
    token = _LAST_TOKEN.search(tokens[-80:])[0].lstrip("¡¿'‘*_>")
    if token and token[-1].isascii() and _UNSPACED.search(token):
        token = _ASCII_END.search(token)[0] if _ASCII_END.search(token) else token
    dots = mark.count(".") > 1 or "…" in mark
    sort = "dots" if dots else mark[-1]
    script = _last_script(tokens)
    if kind == "closed":
        lead = part[begun:opened].rstrip()
        place = "first" if not lead.strip("*_>- ") else "colon" if lead[-1] in ":：" else "inside"
        pair = "bracket" if part[opened] in "([（{【" else "quote"
        word = lead[-80:].split()[-1] if place == "inside" else ""
        return _closed_features(pair, place, word, script)
    if dots:
        return ("dots", f"dots {script}", f"dots {'spaced' if spaced else 'tight'}", script)
    if sort != ".":
        return (f"mark {sort}", f"mark {sort} {script}", script)
    shape = _shape(token) if token else ("closer" if tokens and tokens[-1] in CLOSERS else "none")
    before = ""
    if shape == "digit" or len(token) <= 2:
        words = tokens[-200 - len(token) : len(tokens) - len(token)].split()
        before = words[-1] if words else ""
    return _dot_features(token, shape, before, script)


@lru_cache(maxsize=100_000)
def _closed_features(pair: str, place: str, word: str, script: str) -> tuple[str, ...]:
    return (
        f"closed {pair} {place}", f"closed {pair} {place} {script}", f"closed {pair} after {word.casefold()}"[:40], script
    )


@lru_cache(maxsize=200_000)
def _dot_features(token: str, shape: str, before: str, script: str) -> tuple[str, ...]:
    folded, before = token.casefold(), before.casefold()
    out = [f"dot {shape} {script}", f"dot length {min(len(token), 6)} {shape}"]
    if shape == "digit":
        out += [f"dot digit after {before}"[:40], "dot whole number" if token.isdigit() else "dot number with marks"]
    elif shape != "id" or len(token) <= 6:
        out.append(f"dot token {folded[-24:]}")
        if len(token) <= 2:
            out.append(f"dot short {folded} after {before}"[:40])
    return (*out, script)


@lru_cache(maxsize=200_000)
def _right(opener: str, token: str, around: str) -> tuple[str, ...]:
    if token[:1].isascii() and _UNSPACED.search(token):
        token = _ASCII_START.match(token)[0] if _ASCII_START.match(token) else token
    token = token.rstrip(".,;:!?…”»)’")
    shape, script = _shape(token), _script(token[:1] or "")
    if any(c in "—–-" for c in opener):
        shape = "dash"
    return (f"next {shape}", f"next {shape} {script}", f"next {shape} within {around}", f"next opener {bool(opener)}")


class MaxEnt:
    """Binary maximum-entropy classifier over sparse named features."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}

    def fit(self, counted: Counter, penalty: float = 3.0, rounds: int = 400) -> MaxEnt:
        """*counted*: number of examples of each (features, label)."""
        if not counted:
            return self
        names: dict[str, int] = {"": 0}
        rows, cols, label, weight = [], [], [], []
        for k, ((features, y), n) in enumerate(sorted(counted.items())):
            for f in ("", *features):
                rows.append(k)
                cols.append(names.setdefault(f, len(names)))
            label.append(y)
            weight.append(n)
        r, c, y, n = np.array(rows), np.array(cols), np.array(label, float), np.array(weight, float)
        w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for t in range(1, rounds + 1):
            z = np.bincount(r, w[c], len(y))
            error = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            g = np.bincount(c, error[r], len(names)) + penalty * w
            g /= n.sum() ** 0.5
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (1 - 0.9 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.weight = {f: float(w[i]) for f, i in names.items()}
        return self

    def score(self, features: tuple[str, ...]) -> float:
        get = self.weight.get
        return get("", 0.0) + sum(get(f, 0.0) for f in features)


@dataclass
class Splitter:
    """Both classifiers with what they need to be combined."""

    ending: MaxEnt
    starting: MaxEnt
    share: dict[str, float]
    prior: float
    known: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, texts: Iterable[str]) -> Splitter:
        return cls.of(*count_examples(texts))

    @classmethod
    def of(cls, ends: Counter, starts: Counter) -> Splitter:
        """Fitted to counted examples."""
        ending, starting = MaxEnt().fit(ends), MaxEnt().fit(starts)
        # Per script, since the share of sentence ends that end a block differs with its paragraphs.
        final: dict[str, list[float]] = {}
        for (f, y), n in ends.items():
            if y:
                final.setdefault(f[-1], []).extend([1 / (1 + np.exp(-ending.score(f)))] * n)
        share = {k: float(np.quantile(v, SHARE_QUANTILE)) for k, v in final.items() if len(v) >= 20}
        share[""] = float(np.quantile(sum(final.values(), []), SHARE_QUANTILE)) if final else 0.5
        yes, no = (sum(n for (_, y), n in starts.items() if y == k) for k in (1, 0))
        return cls(ending, starting, share, float(np.log((yes + 1) / (no + 1))))

    def dumps(self) -> str:
        """The fitted model as JSON; ``loads`` gives it back."""
        return json.dumps({"ending": self.ending.weight, "starting": self.starting.weight, "share": self.share, "prior": self.prior}, ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> Splitter:
        kept = json.loads(text)
        ending, starting = MaxEnt(), MaxEnt()
        ending.weight, starting.weight = kept["ending"], kept["starting"]
        return cls(ending, starting, kept["share"], kept["prior"])

    def ends(self, c: Candidate) -> bool:
        left = self.known.get(c.left)
        if left is None:
            share = self.share.get(c.left[-1], self.share[""])
            p = min(0.998, max(0.002, 1 / (1 + np.exp(-self.ending.score(c.left))) / share))
            left = self.known[c.left] = float(np.log(p / (1 - p)))
        right = self.known.get(c.right)
        if right is None:
            right = self.known[c.right] = max(-4.0, min(1.6, self.starting.score(c.right) - self.prior))
        if len(self.known) > 200_000:
            self.known.clear()
        return left + right > -LEANING

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentence units, in order."""
        out: list[tuple[int, int]] = []
        for a, b, kind in blocks(text):
            part = text[a:b]
            if kind in ("code", "heading") or _is_data(part):
                cuts = []
            else:
                lead = len(part) - len(_strip_marker(part, kind))
                found, fixed = candidates(part[lead:])
                cuts = sorted({*(c.end + lead for c in found if not c.final and self.ends(c)), *(f + lead for f in fixed)})
            at = 0
            for cut in [*cuts, len(part)]:
                piece = part[at:cut]
                bare = piece.strip()
                if bare:
                    start = a + at + (len(piece) - len(piece.lstrip()))
                    out.append((start, start + len(bare)))
                at = cut
        return out


def _strip_marker(part: str, kind: str) -> str:
    m = (_BULLET.match(part) or _ORDERED.match(part)) if kind == "item" else _QUOTED.match(part)
    return part[m.end() :] if m else part


def count_examples(texts: Iterable[str]) -> tuple[Counter, Counter]:
    """How often each (features, label) stands in the blocks of *texts*, for either classifier."""
    ends: Counter = Counter()
    starts: Counter = Counter()
    for text in texts:
        for a, b, kind in blocks(text):
            part = text[a:b]
            if kind not in ("para", "item") or _is_data(part):
                continue
            part = _strip_marker(part, kind)
            for c in candidates(part)[0]:
                ends[c.left, int(c.final)] += 1
            first = _NEXT.match(part)
            around = _last_script(part)
            starts[_right(first[1], first[2], around), 1] += 1
            before = ""
            for word in part.split():
                if before.isalpha():
                    starts[_right("", word, around), 0] += 1
                before = word
    return ends, starts


def fit_splitter(documents: DataFrame) -> Splitter:
    """The classifiers, fitted on about SAMPLE rows of *documents*, drawn by a threshold on a hash (a binomial
    number of distinct rows: twice as many do not occur); without any, boundaries rest on priors.  The row count is that
    of the table, which Parquet answers from its footers; null texts give no examples, repeated rows give theirs once."""
    docs = pick(documents, "doc_id", "text")
    share = SAMPLE / max(1, docs.count())
    drawn = docs if share >= 1 else docs.where(F.xxhash64("doc_id", "text") < int((2 * share - 1) * 2**63))
    # Repeated rows have one hash, so all or none of them are drawn.
    bounded = drawn.where("text IS NOT NULL").dropDuplicates(["doc_id", "text"]).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = count_examples(t.as_py() for t in batch.column("text"))
            rows = [(side, y, list(f), n) for side, counted in enumerate(both) for (f, y), n in counted.items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["side", "label", "features", "n"])

    counted = bounded.repartition(FIT_TASKS).mapInArrow(count, "side int, label int, features array<string>, n bigint")
    both: tuple[Counter, Counter] = Counter(), Counter()
    for r in counted.groupBy("side", "label", "features").agg(F.sum("n").alias("n")).collect():
        both[r.side][tuple(r.features), r.label] += r.n
    return Splitter.of(*both)


def save(spark: SparkSession, splitter: Splitter, folder: str) -> None:
    """Keep a fitted model in *folder*, which may be on any file system Spark can write."""
    spark.createDataFrame([(splitter.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def load(spark: SparkSession, folder: str) -> Splitter:
    return Splitter.loads(spark.read.text(folder, wholetext=True).where("value <> ''").first().value)


def sentence_units(documents: DataFrame, splitter: Splitter | None = None) -> DataFrame:
    """doc_id, unit_start, unit_end (BIGINT, 0-based code points, end exclusive) of every row.

    Null, empty and blank texts give no rows.  Repeated rows give their units each.
    Texts of any length are cut whole.  Nothing is shuffled.
    """
    splitter = splitter or fit_splitter(documents)
    shared = documents.sparkSession.sparkContext.broadcast(splitter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value.units
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            docs, starts, ends = [], [], []
            for doc_id, text in zip(ids, texts):
                for a, b in cut(text.as_py() or ""):
                    docs.append(doc_id)
                    starts.append(a)
                    ends.append(b)
            columns = [pa.array(x, pa.int64()) for x in (docs, starts, ends)]
            yield pa.record_batch(columns, names=["doc_id", "unit_start", "unit_end"])

    return pick(documents, "doc_id", "text").mapInArrow(run, "doc_id bigint, unit_start bigint, unit_end bigint")
