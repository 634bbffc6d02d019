import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.ByteBPE.load(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def peer():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def naive(ranks, piece):
    """Merge the least-ranked neighbours again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(
            ((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None
        )
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_same_as_naive_merging_and_as_peer(vocabulary, peer, text):
    ids = list(vocabulary.encode(text))
    expected = [i for p in vocabulary.cut(text) for i in naive(vocabulary.ranks, p.encode())]
    assert ids == expected == peer.encode_ordinary(text)
    assert vocabulary.decode(ids) == text


def test_special_token_strings_are_text(vocabulary, peer):
    text = "<|endoftext|> a <|im_start|>"
    assert list(vocabulary.encode(text)) == peer.encode_ordinary(text)


def test_very_long_piece(vocabulary, peer):
    for text in ("ab" * 20_000, "漢字かな" * 5_000, " " * 10_000, "x" * 30_000):
        assert list(vocabulary.encode(text)) == peer.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "Hello  world"), (2, ""), (3, None), (1, "Hello  world"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("text AS Text", "doc_id", "text")
    out = sorted(map(tuple, bpe.encode_documents(df).collect()), key=str)
    by = {r[0]: r[1] for r in out}
    assert len(out) == 5 and by[2] == [] == by[3] and by[1]
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back == {1: "Hello  world", 2: "", 3: "", None: "x"}
    assert bpe.encode_documents(df.limit(0)).count() == 0
