"""Queries that must not leave out rows or values, against plain Python."""

import datetime as dt
import hashlib
import json
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from kelpline.functions import text
from tests.test_trust import folded

T0 = dt.datetime(2025, 1, 1)


def run(spark, directory, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{directory}/{table}.parquet")
    return entry.queries()[name](spark, str(directory)).collect()


# ------------------------------------------------------------------ p5_table


FILES = "file_id bigint, registry_id bigint, file_seq bigint, received_at timestamp_ntz, content string"


def test_table_keeps_every_value(spark, tmp_path):
    listed = [
        {"id": "a", "kind": 3, "stars": "12", "repoLayout": "suite", "new": [1, {"b": None}], "null": None},
        {"id": 5, "stars": True, "starCount": 7, "licence": "MIT", "upstream.checkStatus": {"value": "moved"}},
        {"stars": "1,016", "star_count": 9, "repositoryLayout": "root-plugin", "layout": "suite", "size_kb": 1.5},
    ]
    got = {r.pos: r for r in run(spark, tmp_path, "p5_table", catalog_files=([(1, 1, 1, T0, json.dumps(listed))], FILES))}
    rescued = {k: json.loads(r._rescued) if r._rescued else {} for k, r in got.items()}
    assert (got[0].id, got[0].kind, got[0].stars, got[0].repositoryLayout, rescued[0]) == ("a", "3", 12, "suite", {"new": [1, {"b": None}]})
    assert (got[1].id, got[1].stars, got[1].license, got[1].upstreamCheckStatus) == ("5", 1, "MIT", None)
    assert rescued[1] == {"stars": True, "starCount": 7, "upstream.checkStatus": {"value": "moved"}}
    assert (got[2].stars, got[2].repositoryLayout, rescued[2]) == (9, "root-plugin", {"stars": "1,016", "layout": "suite", "size_kb": 1.5})


# ------------------------------------------------------------------ t_changed_text


IDENTITY = "machine_id bigint, plugin_id string, revision bigint, file_digests map<string,string>"


def cut(line, limit):
    head = line.encode()
    while len(head) > limit or not whole(head):
        head = head[:-1] if len(head) <= limit else head[:limit]
    return head.decode(), len(line.encode()) > limit


def whole(data):
    try:
        return data.decode() is not None
    except UnicodeDecodeError:
        return False


def test_truncated_inside_characters(spark):
    texts = ["aé漢😀" * 3, "😀😀", "漢a\N{REPLACEMENT CHARACTER}\N{REPLACEMENT CHARACTER}b", "abc", "é", ""]
    for limit in range(13):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, v string")
        got = [(r.t.text, r.t.truncated) for r in df.select("k", text.truncated(F.col("v"), limit).alias("t")).orderBy("k").collect()]
        assert got == [cut(t, limit) for t in texts], limit


def test_changed_text_of_all_paths(spark, tmp_path):
    paths = {p: ["a" * n + w + "/" * 60 for n in range(70, 84)] for p, w in (("wide", "é漢😀"), ("plain", "abc"))}
    paths["short"] = ["é"]
    old = [(k, p, 1, {f: "0"}) for p, fs in paths.items() for k, f in enumerate(fs)]
    new = [(k, p, 1, {f: "1"}) for p, fs in paths.items() for k, f in enumerate(fs)]
    got = run(spark, tmp_path, "t_changed_text", identities_local=(old, IDENTITY), identities_mirror=(new, IDENTITY))
    want = {(k, p): cut(f"changed: {f}\n", 90) for p, fs in paths.items() for k, f in enumerate(fs)}
    assert {(r.machine_id, r.plugin_id): (r.text, r.truncated) for r in got} == want


# ------------------------------------------------------------------ t_budget_fold


DOCUMENTS = "doc_id bigint, plugin_id string, source string, n_chars bigint"


def test_budget_spans_a_whole_plugin(spark, tmp_path):
    rng = random.Random(3)
    size = lambda: rng.choice([None, 0, 0, 1, 7, 90, 399, 400, 401, 1_500, 1_999, 2_000, 2_001, 9_000])
    docs = [(k, rng.choice(["hot", "hot", *map(str, range(40)), None]), rng.choice(["s.a", "s.b", "s", "", None]), size()) for k in range(1, 3_000)]
    got = run(spark, tmp_path, "t_budget_fold", documents=(docs, DOCUMENTS))
    want = {}
    for plugin in {d[1] for d in docs}:
        own = [("/".join([*[s] * (s is not None), str(k)]), n or 0) for k, p, s, n in docs if p == plugin]
        for f in folded(sorted(own, key=lambda f: f[0].split("/")), 2_000, 6_000, 400):
            want[plugin, f[0]] = f[1:]
    assert len(got) == len(docs) == len(want)
    assert {(r.plugin_id, r.path): (r.outcome, r.charged) for r in got} == want
    assert {"read", "sampled", "skipped"} == {o for (p, _), (o, _) in want.items() if p is None}


# ------------------------------------------------------------------ t_content_digest


def test_every_latest_identity_has_a_digest(spark, tmp_path):
    known = hashlib.sha256(b"x").hexdigest()
    maps = {"none": None, "empty": {}, "one": {"a": known}, "null": {"a": known, "é": None}, "onlynull": {"é": None}, "text": {"é": "no hex"}, "blank": {"é": ""}}
    rows = [(1, p, 2, m) for p, m in maps.items()] + [(1, "none", 1, {"old": known}), (1, None, 1, None), (None, "one", 1, {"a": known})]
    got = {(r.machine_id, r.plugin_id): (r.content_digest, r.file_count) for r in run(spark, tmp_path, "t_content_digest", identities_local=(rows, IDENTITY))}

    def digest(files):
        h = hashlib.sha256()
        for path, kind, data in sorted((p.encode(), *coded(d)) for p, d in (files or {}).items()):
            h.update(len(path).to_bytes(8, "big") + path + kind + (0o100644).to_bytes(4, "big") + len(data).to_bytes(8, "big") + data)
        return h.hexdigest(), len(files or {})

    def coded(d):
        return (b"f", bytes.fromhex(d)) if d is not None and d != "no hex" else (b"?", (d or "").encode())

    assert got == {(1, p): digest(m) for p, m in maps.items()} | {(1, None): digest(None), (None, "one"): digest(maps["one"])}
    assert len({got[1, p] for p in ("null", "onlynull", "text", "blank", "one", "empty")}) == 6


# ------------------------------------------------------------------ p5_found


def test_every_pair_alike_is_a_rename(spark, tmp_path):
    one = [{"id": str(k), "a": 1, "b": 1, "c": k, "gone": -k - 1} for k in range(10)]
    two = [{"id": str(k), "x": 1, "y": 1 if k else 2, "z": k, "new": "n"} for k in range(10)]
    files = [(k, 1, k, T0, json.dumps(f)) for k, f in enumerate((one, two))]
    got = {(r.file_seq, r.field_name, r.change_kind, r.old_field_name) for r in run(spark, tmp_path, "p5_found", catalog_files=(files, FILES))}
    renamed = {("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("z", "c")}
    assert got == {(1, new, "renamed", old) for new, old in renamed} | {(1, "gone", "removed", ""), (1, "new", "added", "")}
