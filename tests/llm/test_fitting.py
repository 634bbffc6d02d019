"""The sentence classifiers see whole texts, and items of lists are found below paragraphs."""

import math

from kelpline.llm import sentences as s


def test_fitting_sees_whole_blocks():
    assert math.isclose(s.Splitter.fit(["a " * 1_000 + "a"]).prior, math.log(2 / 1_001))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_fitting_sees_whole_texts(spark):
    texts = ["word " * 6_000 + "end.", "short.", None, ""]
    table = docs(spark, texts)
    assert s.fit_splitter(table).dumps() == s.Splitter.fit([t or "" for t in texts]).dumps()
    assert s.fit_splitter(table.limit(0)).dumps() == s.Splitter.fit([]).dumps()


def test_repeated_rows_keep_the_bound(spark, monkeypatch):
    monkeypatch.setattr(s, "SAMPLE", 5)
    seen = []
    monkeypatch.setattr(s.Splitter, "of", staticmethod(lambda ends, starts: seen.append(sum(n for (_, y), n in starts.items() if y))))
    s.fit_splitter(spark.createDataFrame([(1, "One two. Three four.")] * 400, "doc_id bigint, text string"))
    assert seen[0] in (0, 1)


def test_a_kept_model_cuts_alike_in_any_table(spark, tmp_path):
    texts = ["Dr. Lee came at 5 p.m. and left. It rained.", "One line here. Another there! No?"] * 10
    fitted = s.fit_splitter(docs(spark, texts))
    s.save(spark, fitted, f"{tmp_path}/model")
    kept = s.load(spark, f"{tmp_path}/model")
    assert kept.dumps() == fitted.dumps()
    whole = sorted(map(tuple, s.sentence_units(docs(spark, texts), kept).where("doc_id = 0").collect()))
    assert whole == sorted(map(tuple, s.sentence_units(docs(spark, texts[:1]), kept).collect()))


def parts(text):
    return [(text[a:b], kind) for a, b, kind in s.blocks(text)]


def test_ordered_items_below_a_paragraph():
    assert parts("Steps:\n1. a\n2. b\nc\n3. d") == [("Steps:", "para"), ("1. a", "item"), ("2. b\nc", "item"), ("3. d", "item")]
    assert parts("Then\n4) a\nb\n5) c") == [("Then", "para"), ("4) a\nb", "item"), ("5) c", "item")]
    assert parts("Only:\n1. a") == [("Only:", "para"), ("1. a", "item")]
    for text in ("Er kam am\n1. Oktober an.", "It rose to\n7. That was\n9. high", "It was\n2. then\n\n3. x"):
        assert parts(text)[0] == (text.split("\n\n")[0], "para")
