"""Sources, state documents and the streaming table."""

import json
import os
import threading

import pytest

from kelpline.sources import catalog, state, trees
from kelpline.streaming.latest import LatestTable, follow_latest


def test_catalog_shapes(spark):
    entry = {"id": "a", "repo": "r", "verificationStatus": "v", "odd": [1], "kind": "bar"}
    for document in ([entry], {"entries": [entry], "generation_time": "t"}, {"plugins": [entry], "generatedAt": "t"}, {"entries": None, "plugins": [entry]}):
        df, at = catalog.parse_catalog(spark, json.dumps(document))
        row = df.first()
        assert (row.pos, row.id, row.kind, json.loads(row.extra)) == (0, "a", "bar", {"odd": [1]})
        assert at == ("t" if isinstance(document, dict) and len(document) == 2 and document.get("entries", 1) else None)
    for text in ("{}", "3", "nonsense", '{"entries": 5}'):
        with pytest.raises(catalog.CatalogError):
            catalog.parse_catalog(spark, text)


def test_catalog_size_and_copies(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text("[]")
    assert catalog.read_catalog(spark, str(path))[0].count() == 0
    import hashlib

    digest = hashlib.sha256(b"[]").hexdigest()
    assert catalog.verified_copy(str(path), digest, b"[]", "o", "o")
    assert not catalog.verified_copy(str(path), digest, b"[ ]", "o", "o") and not catalog.verified_copy(str(path), digest, b"[]", "x", "o")
    monkeypatch.setattr(catalog, "MAX_CATALOG_BYTES", 1)
    with pytest.raises(catalog.CatalogError):
        catalog.read_catalog(spark, str(path))


def test_remote_head():
    commit = "a" * 40
    assert catalog.parse_remote_head(f"ref: refs/heads/main\tHEAD\n{commit}\tHEAD\n") == commit
    for bad in ("", commit, f"ref: refs/heads/main\tHEAD\n{commit[:39]}\tHEAD", f"ref: refs/heads/main\tHEAD\n{commit}\tmain"):
        with pytest.raises(ValueError):
            catalog.parse_remote_head(bad)


def test_component_files(spark, tmp_path):
    root = tmp_path / "root"
    one = root / "one"
    (one / "sub").mkdir(parents=True)
    (one / ".git" / "hooks").mkdir(parents=True)
    (one / ".git" / "HEAD").write_text("ref")
    (one / ".git" / "objects").mkdir()
    (one / ".git" / "hooks" / "pre").write_text("x")
    (one / "sub.txt").write_bytes(b"data")
    (one / "sub" / "big").write_bytes(b"0" * 100)
    (one / "_hidden").write_text("")
    os.symlink("sub.txt", one / "link")
    (root / "two").mkdir()
    (root / "two" / "f").write_text("2")
    trees.register(spark)
    df = spark.read.format("component_files").option("root", str(root)).option("fileBytes", "50").load()
    rows = {(r.component, r.path): r for r in df.collect()}
    assert set(rows) == {("one", p) for p in (".git/HEAD", ".git/hooks/pre", "_hidden", "link", "sub", "sub/big", "sub.txt")} | {("two", "f")}
    assert (rows["one", "link"].kind, bytes(rows["one", "link"].data)) == ("l", b"sub.txt")
    assert rows["one", "sub/big"].limitation == "oversize_file" and len(rows["one", "sub/big"].data) == 32
    assert rows["one", ".git/hooks/pre"].kind == "h" and rows["one", "sub.txt"].mode == os.lstat(one / "sub.txt").st_mode
    assert spark.read.format("component_files").option("root", str(root)).option("target", "two").load().count() == 1
    pushed = spark.read.format("component_files").option("root", str(root)).load().where("component = 'two'")
    assert [r.path for r in pushed.collect()] == ["f"]
    assert spark.read.format("component_files").option("root", str(tmp_path / "none")).load().count() == 0


def test_state_documents(tmp_path):
    path = str(tmp_path / "deep" / "s.json")
    empty = lambda: {"schema_version": 1, "alerts": {}}
    assert state.load(path, empty) == empty()
    state.save(path, {"schema_version": 1, "alerts": {"k": "t"}})
    assert state.load(path, empty)["alerts"] == {"k": "t"} and os.stat(path).st_mode & 0o777 == 0o600
    assert os.listdir(os.path.dirname(path)) == ["s.json"]
    for text in ('{"schema_version": 2}', "broken", "[]"):
        with open(path, "w") as f:
            f.write(text)
        with pytest.raises(state.StateError):
            state.load(path, empty)
    value, aside = state.load_or_quarantine(path, empty)
    assert value == empty() and os.path.exists(aside) and not os.path.exists(path)
    assert state.exit_code(1, 0) == 3 and state.exit_code(1, 0, only_new=True) == 0
    assert json.loads(state.report({"a": 1}, "t", "v"))["result"] == {"a": 1}


def test_lock_keeps_every_writer(tmp_path):
    path, lock = str(tmp_path / "s.json"), str(tmp_path / "lock")
    empty = lambda: {"schema_version": 1, "n": 0}

    def add():
        with state.lock(lock, tries=400):
            state.save(path, {"schema_version": 1, "n": state.load(path, empty)["n"] + 1})

    threads = [threading.Thread(target=add) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert state.load(path, empty)["n"] == 8
    with state.lock(lock), pytest.raises(state.LockBusy):
        with state.lock(lock, tries=2):
            pass


def test_commit_signals(spark, tmp_path):
    fresh = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    keep = spark.createDataFrame([("a", "t"), ("b", "t")], "key string, emitted_at string")
    told = []
    assert state.commit_signals(str(tmp_path / "s.json"), fresh, keep, told.append) == 3
    assert sorted(told) == ["a", "b"] and state.load(str(tmp_path / "s.json"), dict)["alerts"] == {"a": "t", "b": "t"}


def test_directories(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("one", "two.bak", "empty", "big"):
        (root / name).mkdir(parents=True)
    (root / "one" / "manifest.json").write_text('{"id": "x"}')
    (root / "two.bak" / "manifest.json").write_bytes(b"\xff")
    (root / "big" / "manifest.json").write_text(" " * (trees.METADATA_BYTES + 1))
    (root / "file").write_text("")
    (root / "one" / ".git").write_text("gitdir: x")
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "manifest.json").write_text('{"id": "outside"}')
    os.symlink(outside, root / "link")
    trees.register(spark)
    got = {r.name: tuple(r)[1:] for r in spark.read.format("component_directories").option("root", str(root)).load().collect()}
    assert got == {
        "one": (False, True, True, '{"id": "x"}', None), "two.bak": (False, True, False, None, "manifest_unavailable"), "empty": (False, True, False, None, "manifest_unavailable"),
        "big": (False, True, False, None, "manifest_too_large"), "file": (False, False, False, None, "manifest_unavailable"), "link": (True, False, False, None, None),
    }
    files = spark.read.format("component_files").option("root", str(root)).load()
    assert {r.component for r in files.collect()} == {"one", "two.bak", "big"}
    assert spark.read.format("component_directories").option("root", str(tmp_path / "none")).load().count() == 0


def walked(folder, **limits):
    return {r[0]: (r[1], r[4], r[5]) for r in trees.Walk(**limits).rows(str(folder), "") if r[0]}, [r[5] for r in trees.Walk(**limits).rows(str(folder), "") if not r[0]]


def test_budget_in_visit_order(tmp_path):
    import hashlib

    one = tmp_path / "one"
    (one / "a").mkdir(parents=True)
    (one / "a" / "b").write_bytes(b"1234567890")
    (one / "a.txt").write_bytes(b"x" * 30)
    (one / "b").write_bytes(b"y" * 8)
    (one / "c").write_bytes(b"")
    (one / ".git").write_text("gitdir: elsewhere")
    whole, _ = walked(one)
    assert {p: k for p, (k, _, _) in whole.items()} == {".git": "g", "a": "d", "a/b": "f", "a.txt": "f", "b": "f", "c": "f"}
    # An oversized file is sampled and charged, and later files are still read; then the budget is used up.
    rows, _ = walked(one, file=20, sample=4, total=24)
    sample = hashlib.sha256((30).to_bytes(8, "big") + b"xxxx" + b"xx").digest()
    assert rows["a/b"][0] == "f" and rows["a.txt"] == ("x", sample, "oversize_file") and rows["b"] == ("f", b"y" * 8, None)
    assert rows["c"] == ("x", (0).to_bytes(8, "big"), "aggregate_byte_limit")
    # The rest of the budget bounds the head; the tail goes beyond it.
    rows, _ = walked(one, total=12, sample=4)
    assert rows["a.txt"] == ("x", hashlib.sha256((30).to_bytes(8, "big") + b"xx" + b"x").digest(), "aggregate_byte_limit")
    assert rows["b"] == ("x", (8).to_bytes(8, "big"), "aggregate_byte_limit")
    # The limit of files counts rows as they are met: a folder's content comes before the names after it.
    rows, only = walked(one, files=3)
    assert set(rows) == {".git", "a", "a/b"} and only == ["file_limit"]
    os.chmod(one / "b", 0)
    if os.geteuid():
        assert walked(one)[0]["b"] == ("x", b"", "unreadable_file")


def test_scan_to_digest(spark, tmp_path):
    """From a tree to its identity, against the digest computed by hand."""
    import hashlib

    from kelpline.operators import identity

    one = tmp_path / "root" / "one"
    (one / "a").mkdir(parents=True)
    (one / "a" / "b").write_bytes(b"data")
    (one / "a.txt").write_bytes(b"")
    os.symlink("a/b", one / "l")
    (tmp_path / "root" / "two").mkdir()
    trees.register(spark)
    files = spark.read.format("component_files").option("root", str(tmp_path / "root")).load()
    got = {r.component: r for r in identity.content_identity(files, ["component"]).collect()}
    h = hashlib.sha256()
    for path, kind, data in (("a", b"d", b""), ("a.txt", b"f", b""), ("a/b", b"f", b"data"), ("l", b"l", b"a/b")):
        mode = os.lstat(one / path).st_mode
        h.update(len(path).to_bytes(8, "big") + path.encode() + kind + mode.to_bytes(4, "big") + len(data).to_bytes(8, "big") + data)
    assert set(got) == {"one"} and (got["one"].content_digest, got["one"].file_count, got["one"].file_limit) == (h.hexdigest(), 4, False)
    cut = identity.content_identity(files, ["component"], max_files=2).first()
    assert cut.file_limit and set(cut.file_digests) == {"a", "a/b"}


def test_inventory_of_a_folder(spark, tmp_path):
    from kelpline.plans.scan import component_inventory

    root = tmp_path / "root"
    good = '{"schemaVersion": 1, "id": "%s"}'
    for name, manifest in (("a", good % "a"), ("b", good % "other"), ("c", "["), ("d.bak", good % "a"), ("g", good % "g")):
        (root / name).mkdir(parents=True)
        (root / name / "manifest.json").write_text(manifest)
    (root / "g" / ".git").mkdir()
    (root / "g" / ".git" / "HEAD").write_text("ref")
    os.mkfifo(root / "b" / "pipe")
    os.symlink(root / "a", root / "z")
    listing = json.dumps([{"id": "a", "active": True}, {"id": "other", "clonedFrom": "u"}, {"id": "gone"}, {"id": "own", "firstParty": True}, {"id": "same", "clonedFrom": ""}])
    rows, limitations = component_inventory(spark, str(root), listing)
    got = {r.name: r for r in rows.collect()}
    assert [r.id for r in rows.collect()] == ["a", "c", "d.bak", "g", "other", "z"]
    assert {n: r.classification for n, r in got.items()} == {"a": "cloned/local", "b": "cloned/local", "c": "unscannable", "d.bak": "backup", "g": "Git-managed", "z": "unscannable"}
    assert got["b"].limitations == ["directory_id_mismatch", "special_file"] and got["b"].repository == "u" and got["a"].active
    assert got["a"].file_count == 1 and got["g"].file_count == 2 and got["c"].content_digest is None and set(got["b"].file_digests) == {"manifest.json", "pipe"}
    assert [tuple(r) for r in limitations.collect()] == [(str(root), "listed_without_directory:gone")]
    rows, limitations = component_inventory(spark, str(root), None, "other")
    assert [(r.name, r.content_digest) for r in rows.collect()] == [("b", got["b"].content_digest)]
    assert [r.limitation for r in limitations.collect()] == ["listing_absent"]
    assert component_inventory(spark, str(tmp_path / "none"), "[]", "x")[0].count() == 0


def test_null_data_and_double_paths_count(spark):
    from kelpline.operators import identity

    rows = [("one", "p", "f", 1, b"p"), ("two", "p", "f", 1, b"p"), ("two", "q", "x", 1, None), ("same", "p", "f", 1, b"p"), ("same", "p", "f", 1, b"q"), ("null", "p", None, None, None)]
    df = spark.createDataFrame(rows, "k string, path string, kind string, mode bigint, data binary")
    got = {r.k: r for r in identity.content_identity(df, ["k"]).collect()}
    assert got["one"].content_digest == got["same"].content_digest != got["two"].content_digest and got["two"].file_count == 2
    assert got["null"].file_count == 1


def test_cached_catalog(spark, tmp_path):
    import hashlib

    load = lambda original=None: catalog.load_cached(spark, str(tmp_path), "o", lambda commit: original)
    data = json.dumps({"plugins": [{"id": "a"}], "generatedAt": "g"}).encode()
    assert load() is None
    (tmp_path / "catalog.json").write_bytes(data)
    assert load() is None
    meta = {"repository_commit": "a" * 40, "repository_url": "o", "retrieved_at": "t", "file_digest": hashlib.sha256(data).hexdigest()}
    keep = lambda m: (tmp_path / "catalog.meta.json").write_text(json.dumps(m))
    keep(meta)
    got = load(data)
    assert got["verified"] and (got["generation_time"], got["retrieved_at"], got["repository"]) == ("g", "t", "o") and got["entries"].first().id == "a"
    assert not load(data + b" ")["verified"] and not load(None)["verified"]
    for change in ({"file_digest": "0"}, {"file_digest": None}, {"repository_url": "x"}, {"repository_url": None}, {"repository_commit": "short"}):
        keep(meta | change)
        assert not load(data)["verified"]
    keep({"repository_commit": "a" * 40})
    assert load(data)["retrieved_at"] == "unknown"
    catalog.keep_catalog(str(tmp_path / "new"), data, {"repository_commit": "b" * 40, "repository_url": "o"})
    assert catalog.load_cached(spark, str(tmp_path / "new"), "o", lambda commit: data)["verified"]
    assert sorted(os.listdir(tmp_path / "new")) == ["catalog.json", "catalog.meta.json"]
    with pytest.raises(catalog.CatalogError):
        catalog.keep_catalog(str(tmp_path / "new"), b" " * (catalog.MAX_CATALOG_BYTES + 1), {})


def test_package_index(spark, tmp_path):
    import gzip

    from pyspark.sql import functions as F

    from kelpline.operators import correlate

    rows = [{"NumVotes": 0, "LastModified": 90, "OutOfDate": None}, {"NumVotes": None, "LastModified": 10, "OutOfDate": 5}, {"NumVotes": 3, "OutOfDate": 0}, {"LastModified": 95}]
    path = tmp_path / "p.json.gz"
    path.write_bytes(gzip.compress(json.dumps(rows).encode()))
    df = catalog.read_packages(spark, str(path))
    got = correlate.package_stats(df, F.coalesce("votes", F.lit(0)) == 0, F.col("modified") >= 90, F.col("flagged"))
    assert tuple(got.first()) == (4, 3, 2, 1)


def test_paths_and_provenance(spark):
    assert state.folder_for("state", {}, "/h") == "/h/.local/state/kelpline"
    assert state.folder_for("cache", {"XDG_CACHE_HOME": "/c"}, "/h") == "/c/kelpline" and state.folder_for("cache", {"XDG_CACHE_HOME": "c"}, "/h") == "/h/.cache/kelpline"
    assert state.provenance(spark, "1", ["x"]).first().coverage_limitations == ["x"]


def test_streaming_latest(spark, tmp_path, monkeypatch):
    from kelpline.streaming import latest as module

    monkeypatch.setattr(module, "COMPACT", 2)
    source = str(tmp_path / "in")
    schema = "k string, seq bigint, v string"
    write = lambda data: spark.createDataFrame(data, schema).write.mode("append").parquet(source)
    table = LatestTable(spark, str(tmp_path / "table"), ["k"], ["seq"])
    rows = lambda: sorted(map(tuple, table.read().collect()))

    def run(checkpoint="checkpoint"):
        write_schema = spark.read.schema(schema).parquet(source).schema
        follow_latest(spark, source, write_schema, table, str(tmp_path / checkpoint)).awaitTermination()
        return rows()

    assert table.read() is None
    write([("a", 1, "x"), ("b", 5, "y")])
    assert run() == [("a", 1, "x"), ("b", 5, "y")]
    write([("a", 2, "z"), ("b", 4, "late")])
    assert run() == [("a", 2, "z"), ("b", 5, "y")]
    # A batch delivered again is in the table already; batch 0 of another checkpoint is not.
    stream = next(iter(table._current()["folded"]))
    table.apply(spark.createDataFrame([("a", 9, "again")], schema), 0, stream)
    assert rows() == [("a", 2, "z"), ("b", 5, "y")]
    write([("c", 1, "new"), ("a", 3, "newer")])
    assert run("other") == [("a", 3, "newer"), ("b", 5, "y"), ("c", 1, "new")]
    # Versions no reader can need are gone.
    kept = os.listdir(tmp_path / "table")
    assert sum(n.startswith("manifest-") and n.endswith(".json") for n in kept) == 2 and sum(n.startswith("part-") for n in kept) <= 3


def test_release_removes_written_tables(spark):
    from kelpline.operators import storage

    table = storage.cut_lineage(spark.range(3).toDF("n"))
    place = table.inputFiles()[0].replace("file://", "")
    assert table.count() == 3 and os.path.exists(place)
    assert storage.release(spark) >= 1 and not os.path.exists(place)
