import random

import pytest

from kelpline.llm import sentences as s

rng = random.Random(4)


def english():
    a, b, n = rng.choice(["old", "new", "cold"]), rng.choice(["stale", "clean", "local"]), rng.choice(["Ovanel", "Ismeru"])
    return rng.choice(
        [
            f"The {a} cache was {b} by noon.",
            f"One auditor checked the {a} cache.",
            f"Dr. {n} agreed with Prof. {n}.",
            f"See p. 4, cf. fig. 9, for the {a} one.",
            f"“Was it {b}? It was.” asked the auditor.",
            f"It took {rng.random():.2f} s, about 1,854.5 times.",
            f"Was the {a} cache {b}?",
        ]
    )


def german():
    b = rng.choice(["alt", "neu", "leer"])
    return rng.choice([f"Der Zweig ist z. B. dann {b}.", "Um 10:09 Uhr wurde er geprüft!", f"Am 1. Oktober war er {b}."])


def chinese():
    a = rng.choice(["快照", "目录", "摘要"])
    return rng.choice([f"为什么{a}又缺失了？", f"备注写道：“{a}完整。请不要删除。”", f"“{a}又可疑了！”审查员说。"])


def text_of(sentence, joint):
    return "\n\n".join(joint.join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(3))


CORPUS = [text_of(f, j) for f, j in ((english, " "), (german, " "), (chinese, "")) for _ in range(150)]
CORPUS += ["ผู้ดูแลได้ลบรายงาน มีไฟล์ทั้งหมด 841 ไฟล์ในระบบ"] * 3


@pytest.fixture(scope="module")
def splitter():
    return s.Splitter.fit(CORPUS)


def cut(splitter, text):
    return [text[a:b] for a, b in splitter.units(text)]


def test_abbreviations_and_numbers(splitter):
    text = "Dr. Ovanel agreed with Prof. Ismeru. The cold cache was stale. See p. 4, cf. fig. 9, for the old one."
    assert cut(splitter, text) == ["Dr. Ovanel agreed with Prof. Ismeru.", "The cold cache was stale.", "See p. 4, cf. fig. 9, for the old one."]
    assert cut(splitter, "It took 17.75 s on v4.5.7, about 1,854.5 times. One auditor checked it.")[0].endswith("times.")


def test_quotes_and_brackets_stay(splitter):
    assert len(cut(splitter, "“Was it stale? It was.” asked the auditor. One auditor checked it.")) == 2
    assert cut(splitter, "备注写道：“目录完整。请不要删除。”为什么快照又缺失了？“目录又可疑了！”审查员说。") == [
        "备注写道：“目录完整。请不要删除。”",
        "为什么快照又缺失了？",
        "“目录又可疑了！”审查员说。",
    ]


def test_blocks(splitter):
    text = "# Notes. Old ones\nOne auditor\nchecked it.\n* The first\n* The second\n\n```\na. B c.\n\nd\n```\n  \n{\"a\": \"b. C\"}\n\n====\n"
    assert cut(splitter, text) == ["# Notes. Old ones", "One auditor\nchecked it.", "* The first", "* The second", "```\na. B c.\n\nd\n```", '{"a": "b. C"}', "===="]


def test_thai_space_and_line_break(splitter):
    assert cut(splitter, "ผู้ดูแลได้ลบรายงาน มีไฟล์ทั้งหมด 841 ไฟล์ในระบบ แฟ้ม main.qml") == [
        "ผู้ดูแลได้ลบรายงาน",
        "มีไฟล์ทั้งหมด 841 ไฟล์ในระบบ",
        "แฟ้ม main.qml",
    ]


def test_units_hold_every_character_but_white_space(splitter):
    for text in [*CORPUS, "a\r\n\r\nb", "“((", "'''", "```\nnever closed", "x" * 50_000, ". " * 5_000, "([" * 40_000 + "}" * 40_000, "“" * 40_000 + "»" * 40_000, "'a " * 40_000]:
        units = splitter.units(text)
        assert "".join(text[a:b] for a, b in units).translate({32: None, 10: None, 13: None}) == "".join(text.split())
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in units)
        assert all(x[1] <= y[0] for x, y in zip(units, units[1:]))


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(CORPUS)] + [(900, None), (901, ""), (902, " \n\t "), (903, "One. Two.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("'x' AS TEXT", "*")
    out = s.sentence_units(df)
    assert out.columns == ["doc_id", "unit_start", "unit_end"]
    assert not {900, 901, 902} & {r.doc_id for r in out.collect()}
    assert s.sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("sentence, joint", [(english, " "), (german, " "), (chinese, "")])
def test_held_out_accuracy(splitter, sentence, joint):
    wrong = total = 0
    for _ in range(200):
        ones = [sentence() for _ in range(6)]
        got, want = cut(splitter, joint.join(ones)), ones
        total += len(want)
        wrong += len(set(want) - set(got))
    assert wrong <= 0.02 * total
