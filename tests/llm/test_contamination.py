import random

import numpy as np

from kelpline.llm import contamination as c

ITEM = "Suppose the younger clerk wants to prove seven hollow reeds while every night warden never signs the blue tiles near the gate"
ZH = "假设一位年轻的职员想证明七根空心芦苇而每个守夜人从不在城门旁边签收蓝色的瓷砖"


def leaks(spark, docs, items=((1, ITEM), (2, ZH))):
    d = spark.createDataFrame([(i, t) for i, t in docs], "doc_id bigint, text string")
    e = spark.createDataFrame(list(items), "item_id bigint, text string")
    return sorted(map(tuple, c.leaked_items(d, e).collect()))


def test_whole_part_and_disguise(spark):
    words = ITEM.split()
    docs = [
        (1, "before " + ITEM + " after"),
        (2, "x " + " ".join(words[5:13]).upper() + " y"),
        (3, "> " + "\n> ".join(words)),
        (4, ITEM.replace("younger clerk", "[younger **clerk**](https://a.example/x y)".replace(" y)", ")"))),
        (5, "".join(chr(ord(ch) + 0xFEE0) if ch.isalpha() else ch for ch in ITEM)),
        (6, ITEM.replace("hollow", "hol­low").replace("tiles", "ti​les")),
        (7, " ".join(words[5:12]) + " nothing else in common here"),
        (8, " ".join(reversed(words))),
        (9, None),
        (10, ""),
        (11, ZH[3:20]),
        (12, ZH[3:12]),
        (13, "，".join(ZH)),
    ]
    assert leaks(spark, docs) == [(i, 1) for i in (1, 2, 3, 4, 5, 6)] + [(11, 2), (13, 2)]


def test_empty_and_repeated(spark):
    assert leaks(spark, []) == []
    assert leaks(spark, [(1, ITEM)], []) == []
    assert leaks(spark, [(1, ITEM), (1, ITEM)], [(1, ITEM), (1, ITEM), (None, ITEM), (3, None), (4, "too short")]) == [(1, 1), (1, 1)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = [(1, ITEM), (2, ZH)]
    whole = leaks(spark, docs)
    monkeypatch.setattr(c, "BLOCK_ITEMS", 1)
    assert leaks(spark, docs) == whole == [(1, 1), (2, 2)]


def test_lookup_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(5)
    tokens = {k: rng.integers(0, 2**63, 40).astype(np.uint64) for k in range(30)}
    index = c.Index(8, tokens, 3)
    near = index.prints.copy()
    for k in range(len(near)):
        for bit in random.Random(k).sample(range(64), k % 6):
            near[k] ^= np.uint64(1 << bit)
    got = set(zip(*map(list, index.lookup(near))))
    brute = {(i, j) for i in range(len(near)) for j in range(len(index.prints)) if int(near[i] ^ index.prints[j]).bit_count() <= 3}
    assert got == brute


def test_long_text_is_searched_whole():
    m = c.Matcher.of([(1, ITEM)])
    rng = random.Random(3)
    noise = [str(rng.random()) for _ in range(60_000)]
    text = " ".join(noise[:50_000]) + " " + ITEM + " " + " ".join(noise[50_000:])
    assert m.found(["short", text]) == [(1, 0)]


def test_same_as_brute_force():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(20)]
    m = c.Matcher.of(items)
    for _ in range(200):
        k = rng.randrange(20)
        words = items[k][1].split()
        a, n = rng.randrange(30), rng.randrange(5, 20)
        doc = rng.choices(vocabulary, k=30) + words[a : a + n] + rng.choices(vocabulary, k=30)
        want = set()
        for i, text in items:
            w = text.split()
            covered = set()
            for p in range(len(w) - 7):
                if any(doc[q : q + 8] == w[p : p + 8] for q in range(len(doc) - 7)):
                    covered.update(range(p, p + 8))
            if len(covered) * 4 >= len(w):
                want.add(i)
        assert {r for _, r in m.found([" ".join(doc)])} == want


def test_repeated_item_ids_give_the_same_in_any_blocks(spark, monkeypatch):
    docs = [(1, ITEM + " " + ZH), (1, ITEM), (2, ZH)]
    items = [(1, ITEM), (1, ITEM + " more"), (1, ZH), (2, ITEM), (3, ZH)]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr(c, "BLOCK_ITEMS", 1)
    assert leaks(spark, docs, items) == whole == [(1, 1), (1, 1), (1, 2), (1, 2), (1, 3), (2, 1), (2, 3)]


def test_windows_go_with_the_item():
    assert [c.window_size(n, 8) for n in (8, 40, 95, 96, 128, 192, 256, 400, 10**6)] == [8, 8, 8, 12, 16, 24, 32, 48, 8192]


def test_fingerprints_are_weighted_majorities_whatever_the_chunks(monkeypatch):
    tokens = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)
    monkeypatch.setattr(c, "CHUNK", 64)
    got = {8: [], 24: []}
    for size, at, prints in c.fingerprints(tokens, [8, 24]):
        assert at == sum(map(len, got[size]))
        got[size].append(prints)
    for size, parts in got.items():
        bits = np.unpackbits(tokens.view(np.uint8).reshape(-1, 8), axis=1).astype(int) * 2 - 1
        signed = bits * c.weights(tokens)[:, None]
        brute = [np.packbits(signed[i : i + size].sum(axis=0) > 0) for i in range(300 - size + 1)]
        assert (np.concatenate(parts).view(np.uint8).reshape(-1, 8) == np.array(brute)).all()


def edited(words, every):
    """Every so many-th word replaced: runs are one word shorter."""
    return [f"other{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


def test_the_radius_finds_edited_passages_that_equal_fingerprints_do_not():
    rng = random.Random(8)
    items = [(k, " ".join(f"t{rng.randrange(10**6)}" for _ in range(200))) for k in range(40)]
    none, near = c.Matcher.of(items, 0), c.Matcher.of(items, 3)
    texts = [" ".join(edited(t.split(), 23)) for _, t in items]
    some, more = set(none.found(texts)), set(near.found(texts))
    assert some < more <= {(k, k) for k in range(40)} and len(some) < 10 and len(more) >= 36


def test_similarity_decides_candidates():
    a = np.arange(1, 41, dtype=np.uint64)
    assert c.similarity(a, a) == 1 and c.similarity(a, a[::-1]) == 0
    b = a.copy()
    b[0] = 99
    assert c.SIMILARITY < c.similarity(a, b) < 1
    b[20] = 98
    assert c.similarity(a, b) < c.SIMILARITY
    assert c.similarity(a[:3], a[:3]) == 1


def test_runs_are_counted_exactly():
    item = np.arange(100, 160, dtype=np.uint64)
    other = np.arange(7, dtype=np.uint64)
    text = np.concatenate([other, item[:9], other, item[20:27], other, item[30:45], item[30:45]])
    assert c.covered(item, text, 8) == 9 + 15
    assert c.covered(item, item[:7], 8) == c.covered(item[:7], item, 8) == 0
