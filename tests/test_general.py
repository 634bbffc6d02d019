"""The general problems: edge cases with defined results, and randomized comparisons with plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpline.functions import skew, times
from kelpline.operators import compare, history, references, schema_drift, snapshots, structural

T0 = dt.datetime(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------------ times


def test_times(spark):
    cases = {
        "2025-01-01T00:00:00Z": 1735689600,
        "2025-01-01 00:00:00": 1735689600,
        "2025-01-01T02:00:00.987654+02:00": 1735689600,
        "2024-12-31T19:00:00-0500": 1735689600,
        "2025-01-01T05:30:00+05:30": 1735689600,
        "1735689600": 1735689600,
        "-1": -1,
        "2025-13-01T00:00:00Z": None,
        "2025-02-30T00:00:00Z": None,
        "2025-01-01T24:00:00Z": None,
        "2025-01-01T00:60:00Z": None,
        "2025-01-01T05": None,
        "2025-01-01": None,
        " 1735689600": None,
        "1735689600\n": None,
        "pending": None,
        "": None,
        None: None,
        "9" * 40: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = {r.t: r.s for r in df.select("t", times.epoch_seconds(df.t).alias("s")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == cases


# ------------------------------------------------------------------ 1


REPORT = "report_id bigint, received_at timestamp_ntz, payload string, Payload string"


def flatten(spark, payloads):
    data = [(i, T0 + dt.timedelta(hours=h), p, "clash") for i, h, p in payloads]
    return rows(structural.flatten_reports(spark.createDataFrame(data, REPORT)))


def test_reports_of_every_shape(spark):
    plugins = [
        {"id": "a", "file_digests": {"x": "1", "y": None}, "limitations": ["l", "l", None, {"code": "c"}, {"detail": "no"}]},
        None,
        {"file_digests": [{"path": "p", "digest": "2"}, {"path": "p"}, None, {"digest": "3"}], "limitations": "one"},
        {"id": None, "file_digests": [], "limitations": None},
        "text",
    ]
    expected = [
        (0, "plugin", "a"), (0, "file_digest", "x"), (0, "file_digest", "y"), (0, "limitation", "l"), (0, "limitation", "c"),
        (2, "plugin", ""), (2, "file_digest", "p"), (2, "limitation", "one"), (3, "plugin", ""),
    ]
    for payload in ({"plugins": plugins}, {"result": {"plugins": plugins}}, {"result": json.dumps({"plugins": plugins})}):
        assert flatten(spark, [(1, 0, json.dumps(payload))]) == sorted([(1, *e) for e in expected], key=repr)
    assert flatten(spark, [(1, 0, json.dumps({"plugins": {"id": "alone"}}))]) == [(1, 0, "plugin", "alone")]


def test_reports_last_readable_counts(spark):
    a, b = (json.dumps({"plugins": [{"id": i}]}) for i in "ab")
    assert flatten(spark, [(1, 0, a), (1, 1, b), (1, 2, b[:-3]), (1, 3, None), (1, 4, "[]"), (1, 5, '{"result":null}')]) == [(1, 0, "plugin", "b")]
    assert flatten(spark, [(1, 0, a), (1, 1, '{"plugins":null}')]) == []
    assert flatten(spark, [(None, 0, a), (None, 1, b), (2, 0, a), (2, 0, a)]) == sorted([(None, 0, "plugin", "b"), (2, 0, "plugin", "a")], key=repr)
    assert flatten(spark, []) == []


def test_subtype_tables_hold_the_same_rows(spark):
    payload = json.dumps({"plugins": [{"id": "a", "file_digests": {"x": "1"}, "limitations": "l"}, {"id": "b", "file_digests": [{"path": "y"}], "limitations": ["m", {"code": "n"}]}]})
    tables = structural.subtype_tables(spark.createDataFrame([(1, T0, payload, "")], REPORT))
    assert {k: v.count() for k, v in tables.items()} == {"plugins": 2, "files_path_map": 1, "files_path_list": 1, "limits_single": 1, "limits_list": 2}
    assert [r.plugin_shape for r in tables["plugins"].collect()] == ["complete", "complete"]


def test_lists_of_mixed_elements_are_routed_by_their_states(spark):
    files = [{"path": "a", "digest": "1"}, {"path": "a", "digest": "2"}, {"path": 5}, {"path": ["no"]}, {"path": {"no": 1}}, {"path": None}, {"digest": "3"}, "text", 7, None, ["x"]]
    limits = ["t", {"code": "c"}, {"code": None}, {"code": ["no"]}, {}, None, 7, True, ["x"], "t", {"code": "t"}]
    payload = json.dumps({"plugins": [{"id": "p", "file_digests": files, "limitations": limits}, {"id": "q", "limitations": {"code": "one"}}, {"file_digests": 5, "limitations": False}]})
    data = spark.createDataFrame([(1, T0, payload, "")], REPORT)
    tables = structural.subtype_tables(data)
    assert rows(tables["files_path_list"].select("path", "digest")) == sorted([("a", "1"), ("a", "2"), ("5", None)], key=repr)
    assert rows(tables["limits_list"].select("plugin_pos", "plugin_id", "limitation")) == [(0, "p", "c"), (0, "p", "t"), (0, "p", "t"), (0, "p", "t")]
    assert rows(tables["limits_single"].select("plugin_id", "plugin_shape", "limitation")) == [("q", "limits_only", "one")]
    union = {(r.report_id, r.plugin_pos, structural.SUBTYPES[name], r[3 if name == "plugins" else 4] if name != "plugins" else r.plugin_id) for name, t in tables.items() for r in t.collect()}
    assert set(rows(structural.flatten_reports(data))) == union and len(rows(structural.flatten_reports(data))) == len(union)
    plan = structural.flatten_reports(data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


# ------------------------------------------------------------------ 2


def versions(observations):
    by = {}
    for e, m, p, s, at, seq, v in observations:
        if p is not None and at is not None:
            by.setdefault((e, m, p, s), {}).setdefault(at, []).append((seq, v))
    out = []
    for key, seen in by.items():
        runs = []
        for at in sorted(seen):
            v = max(seen[at])[1]
            if not runs or runs[-1][1] != v:
                runs.append((at, v))
        out += [(*key, at, runs[k + 1][0] if k + 1 < len(runs) else -1) for k, (at, _) in enumerate(runs)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_history_like_plain_python(spark, seed):
    rng = random.Random(seed)
    data = []
    for k in range(1500):
        machine = rng.choice([1, 1, 1, 2, None])
        plugin = rng.choice(["a", "a", "a", "b", None])
        at = rng.choice([None, rng.randrange(0, 400), rng.randrange(0, 10**8)])
        data.append(("review", machine, plugin, rng.choice(["s", None]), at, k, bytes([rng.choice([65, 65, 66])])))
    schema = "entity string, machine_id bigint, plugin_id string, scope string, at bigint, seq bigint, value binary"
    got = rows(history.validity_intervals(spark.createDataFrame(data, schema)))
    assert got == versions(data)
    assert rows(history.validity_intervals(spark.createDataFrame([], schema))) == []


def test_history_of_a_hot_entity(spark):
    """A million changes of one entity, a value that holds across whole ranges, and one that comes back at a range's start."""
    n, width = 1_000_000, skew.RANGE_SECONDS
    hot = spark.range(n).selectExpr("'e' AS entity", "1L AS machine_id", "'hot' AS plugin_id", "'s' AS scope", "id * 40 AS at", "id AS seq", "encode(CAST(id DIV 3 % 2 AS STRING), 'UTF-8') AS value")
    got = history.validity_intervals(hot)
    ends = F.lead("valid_from", 1, -1).over(Window.orderBy("valid_from"))
    checked = got.select("valid_from", "valid_to", ends.alias("next")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_to") == F.col("next")).alias("same"), F.count_if(F.col("valid_from") % 120 == 0).alias("thirds"))
    assert tuple(checked.first()) == (333_334, 333_334, 333_334)
    data = [("e", 1, "p", "s", at, k, v) for k, (at, v) in enumerate([(0, b"A"), (width + 5, b"A"), (2 * width + 1, b"A"), (3 * width, b"A"), (3 * width + 9, b"B"), (3 * width + 10, b"A"), (3 * width + 11, b"C"), (4 * width, b"C"), (9 * width, b"A")])]
    schema = "entity string, machine_id bigint, plugin_id string, scope string, at bigint, seq bigint, value binary"
    assert rows(history.validity_intervals(spark.createDataFrame(data, schema))) == versions(data)


TRUST = "record_id bigint, machine_id bigint, seq bigint, plugin_id string, accepted struct<plugin_id:string,repository:string,head:string,tree:string,content_digest:string,file_count:bigint,limitations:array<string>,file_digests:map<string,string>>, accepted_at string, ingested_at timestamp_ntz"
REVIEW = "decision_id bigint, machine_id bigint, seq bigint, plugin_id string, action string, scope string, created_at string, ingested_at timestamp_ntz"


def test_history_corrections_nulls_and_file_maps(spark):
    value = lambda head, files=None: ("p", None, head, None, None, 1, [], files)
    trust = [
        (1, 1, 0, "p", value("a"), "100", T0),
        (1, 1, 0, "p", value("b"), "100", T0 + dt.timedelta(1)),  # a correction
        (2, 1, 1, "p", value("b", {"x": "1"}), "200", T0),  # files are no part of the value
        (3, 1, 2, "p", value(None), "300", T0),
        (4, 1, 3, "p", value(None), "400", T0),
        (5, 1, 4, "p", None, "500", None),
        (6, 1, 5, None, value("z"), "600", T0),
        (7, 1, 6, "p", value("z"), "soon", T0),
    ]
    review = [(1, 1, 0, "p", "a", "s", "100", T0), (2, 1, 1, "p", "b", "s", "100", T0), (3, 1, 2, "p", None, "s", "150", T0)]
    got = rows(history.attribute_history(spark.createDataFrame(trust, TRUST), spark.createDataFrame(review, REVIEW)))
    assert got == [
        ("baseline", 1, "p", "", 100, 300), ("baseline", 1, "p", "", 300, 500), ("baseline", 1, "p", "", 500, -1),
        ("review", 1, "p", "s", 100, 150), ("review", 1, "p", "s", 150, -1),
    ]


# ------------------------------------------------------------------ 3


IDENTITY = "machine_id bigint, plugin_id string, repository string, head string, tree string, content_digest string, file_count bigint, limitations array<string>, file_digests map<string,string>, revision bigint, note string"


def test_copies(spark):
    def row(plugin, revision=1, machine=1, **fields):
        base = dict(repository="r", head="aB", tree=None, content_digest="D", file_count=1, limitations=[], file_digests={}) | fields
        return (machine, plugin, *base.values(), revision, "x")

    local = [row("same"), row("same"), row("old", 1, head="x"), row("old", 2), row("gone"), row("files", file_digests={"a": "F", "b": None, "c": "1"}), row("lists", limitations=["a", "b"]), row("nulls", repository=None), row(None)]
    mirror = [row("same", head="Ab", limitations=None, file_digests=None, content_digest="d"), row("old", 1), row("new"), row("files", file_digests={"a": "f", "c": "2", "d": None}), row("lists", limitations=["b", "a"]), row("nulls", repository=""), row(None, file_count=None)]
    got = rows(compare.identity_differences(spark.createDataFrame(local, IDENTITY), spark.createDataFrame(mirror, IDENTITY)))
    assert got == sorted(
        [(1, "gone", "only_local", ""), (1, "new", "only_mirror", ""), (1, "lists", "limitations", ""), (1, "nulls", "repository", ""), (1, None, "file_count", "")]
        + [(1, "files", "file_digests", p) for p in "bcd"],
        key=repr,
    )
    empty = spark.createDataFrame([], IDENTITY)
    assert rows(compare.identity_differences(empty, empty)) == []
    assert {r[2] for r in rows(compare.identity_differences(spark.createDataFrame(local, IDENTITY), empty))} == {"only_local"}


# ------------------------------------------------------------------ 4


def test_running_sums_like_plain_python(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", None]), rng.randrange(50), k, rng.randrange(-3, 4)) for k in range(600)]
    df = spark.createDataFrame(data, "k string, at bigint, n bigint, v bigint").selectExpr("*", "at div 7 AS part")
    from pyspark.sql import functions as F

    got = {(r.k, r.n): r.v for r in skew.running_sums(df, ["k"], "part", [F.col("at"), F.col("n")], ["v"]).collect()}
    for key, at, n, _ in data:
        assert got[key, n] == sum(v for k, a, m, v in data if k == key and (a, m) <= (at, n))


INSTALLED = "machine_id bigint, plugin_id string, installed_at timestamp_ntz, removed_at timestamp_ntz"
HISTORY = "history_id bigint, machine_id bigint, revoked_plugins array<string>, saved_at string, ingested_at timestamp_ntz"


def orphans(spark, trust=(), review=(), saved=(), installed=(), edges=()):
    frames = [spark.createDataFrame(list(d), s) for d, s in ((trust, TRUST), (review, REVIEW), (saved, HISTORY), (installed, INSTALLED))]
    return rows(references.orphan_references(*frames, edges))


def test_orphans_at_the_edges_of_time(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    base = 1735689600
    installed = [(1, "p", at(100), at(200)), (1, "p", at(100), at(200)), (1, "p", at(300), None), (1, "z", at(50), at(50)), (1, "n", None, None), (None, "p", at(0), None)]
    saved = [(k, 1, ["p", None, "P", "z", "n"], str(base + s), T0) for k, s in enumerate((99, 100, 199, 200, 300))] + [(9, None, ["p"], str(base), T0), (10, 1, None, str(base), T0), (11, 1, ["p"], "n/a", T0)]
    got = {(r[1], r[2]): r[3] for r in orphans(spark, saved=saved, installed=installed)}
    assert {k: v for k, v in got.items() if k[1] == 0} == {(0, 0): "late", (3, 0): "deleted"}
    assert all(got[k, 2] == "missing" and got[k, 3] == "deleted" and got[k, 4] == "late" or got[k, 4] == "deleted" for k in range(5))
    assert orphans(spark) == []


def test_orphans_like_plain_python(spark):
    rng = random.Random(7)
    time = lambda: rng.randrange(0, 3 * 10**7)
    installed, refs = [], []
    for _ in range(300):
        a = time()
        installed.append((rng.randrange(3), rng.choice("abc"), T0 + dt.timedelta(seconds=a), rng.choice([None, T0 + dt.timedelta(seconds=a + rng.randrange(10**5))])))
    installed = installed[:12]
    refs = [(k, rng.randrange(4), k, rng.choice("abcd"), None, str(1735689600 + time()), T0) for k in range(400)]
    want = set()
    for k, m, _, p, _, t, _ in refs:
        moment = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(t))
        own = [(a, b) for i, q, a, b in installed if (i, q) == (m, p)]
        if not any(a <= moment and (b is None or moment < b) for a, b in own):
            want.add((k, "missing" if not own else "late" if all(a > moment for a, _ in own) else "deleted"))
    assert {(r[1], r[3]) for r in orphans(spark, trust=refs, installed=installed)} == want


def test_orphans_of_a_hot_key(spark):
    """One plugin of one machine holds half the references, most of them at one instant."""
    base = 1735689600
    hot = spark.range(60_000).selectExpr("id AS record_id", "1L AS machine_id", "id AS seq", "'hot' AS plugin_id", f"CAST({base} + IF(id % 3 = 0, id * 60, 7) AS STRING) AS accepted_at", "TIMESTAMP_NTZ'2025-01-01' AS ingested_at")
    cold = spark.range(60_000).selectExpr("id + 60000 AS record_id", "id % 500 AS machine_id", "id AS seq", "concat('p', id % 7) AS plugin_id", f"CAST({base} + id AS STRING) AS accepted_at", "TIMESTAMP_NTZ'2025-01-01' AS ingested_at")
    installed = spark.createDataFrame([(1, "hot", T0 + dt.timedelta(seconds=60 * k), T0 + dt.timedelta(seconds=60 * k + 30)) for k in range(0, 60_000, 6)], INSTALLED)
    none = [spark.createDataFrame([], s) for s in (REVIEW, HISTORY)]
    found = references.orphan_references(hot.unionByName(cold), *none, installed)
    got = {(r.hot, r.orphan_reason): r.n for r in found.selectExpr("ref_id < 60000 AS hot", "orphan_reason").groupBy("hot", "orphan_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(True, "deleted"): 10_000, (False, "missing"): 60_000}


def test_cascade_reaches_its_fixpoint_even_in_cycles(spark):
    trust = [(1, 1, 0, "p", None, "100", T0), (2, 2, 0, "q", None, "1735689700", T0)]
    review = [(5, 1, 0, "p", "a", "s", "1735689700", T0), (6, 2, 0, "q", "a", "s", "1735689700", T0)]
    saved = [(7, 1, ["p"], "1735689700", T0)]
    installed = [(1, "p", T0, None), (2, "q", T0, None)]
    edges = [references.Edge(c, p, ("machine_id", "plugin_id")) for c, p in (("review_decisions", "trust_records"), ("trust_histories", "review_decisions"), ("trust_records", "trust_histories"))]
    got = [(r[0], r[1], r[3], r[5]) for r in orphans(spark, trust, review, saved, installed, edges)]
    assert got == [("review_decisions", 5, "inherited", 1), ("trust_histories", 7, "inherited", 2), ("trust_records", 1, "late", 0)]


# ------------------------------------------------------------------ 5


FILES = "file_id bigint, registry_id bigint, file_seq bigint, received_at timestamp_ntz, content string"


def changes(spark, contents, registry=1):
    data = [(k, registry, q, T0 + dt.timedelta(hours=k), c) for k, (q, c) in enumerate(contents)]
    return rows(schema_drift.schema_changes(spark.createDataFrame(data, FILES)))


def entries(n, **fields):
    return [{"id": f"e{k}", **{f: v(k) if callable(v) else v for f, v in fields.items()}} for k in range(n)]


def test_schema_changes(spark):
    one = entries(10, stars=lambda k: k, old=lambda k: f"v{k}", kind="x", gone=True, null=None)
    two = entries(10, stars=lambda k: str(k), **{"new.name": lambda k: f"v{k}" if k else "other"}, kind="x", fresh={"a": 1, "b": [1.0]})
    got = changes(spark, [(1, json.dumps(one)), (2, '{"broken'), (3, json.dumps({"entries": None, "plugins": two})), (3, json.dumps(two)), (5, "{}")])
    assert got == [
        (1, 3, "fresh", "added", ""), (1, 3, "gone", "removed", ""), (1, 3, "new.name", "renamed", "old"), (1, 3, "stars", "retyped", ""),
    ]


def test_schema_changes_at_the_edges(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, json.dumps(entries(3, a=1)))]) == []
    assert changes(spark, [(1, json.dumps(entries(2, a=1))), (2, "[]")]) == [(1, 2, "a", "removed", ""), (1, 2, "id", "removed", "")]
    # The first listed of an id counts, and ids in one file only do not.
    one = [{"id": "a", "x": 1}, {"id": "a", "x": 2}, {"x": 9}, {"id": "b", "x": 5}, "text", None]
    two = [{"id": "a", "y": 1.0}, {"id": "a", "y": 7}, {"id": "c", "y": 8}]
    assert changes(spark, [(1, json.dumps(one)), (2, json.dumps(two))]) == [(1, 2, "y", "renamed", "x")]
    # Key order within a value does not matter, letter case of a name does.
    one, two = entries(3, A={"p": 1, "q": 2}), entries(3, a={"q": 2, "p": 1})
    assert changes(spark, [(1, json.dumps(one)), (2, json.dumps(two))]) == [(1, 2, "a", "renamed", "A")]
    assert changes(spark, [(1, json.dumps(one)), (2, json.dumps(two))], registry=None) == []


def test_ingest_rescue_promote(spark):
    content = json.dumps([{"id": "a", "kind": 3, "stars": "12", "Kind": "k"}, {"id": 5, "stars": "many"}, 7, {"kind": "x", "stars": None}])
    df = spark.createDataFrame([(1, 1, 1, T0, content)], FILES)
    table = {r.pos: r for r in schema_drift.ingest(df).collect()}
    assert sorted(table) == [0, 1, 3]
    assert (table[0].id, table[0].kind, json.loads(table[0]._rescued)) == ("a", None, {"kind": 3, "stars": "12", "Kind": "k"})
    assert (table[1].id, json.loads(table[1]._rescued)) == (None, {"id": 5, "stars": "many"})
    assert (table[3].kind, table[3]._rescued) == ("x", None)
    promoted = {r.pos: r for r in schema_drift.promote(schema_drift.ingest(df), {"stars": "bigint"}).collect()}
    assert (promoted[0].stars, json.loads(promoted[0]._rescued)) == (12, {"kind": 3, "Kind": "k"})
    assert (promoted[1].stars, json.loads(promoted[1]._rescued)) == (None, {"id": 5, "stars": "many"})


def test_second_choices_of_renames(spark):
    one, two = entries(4, a=1, b=1), entries(4, x=1, y=1)
    got = changes(spark, [(1, json.dumps(one)), (2, json.dumps(two))])
    assert got == sorted([(1, 2, n, "renamed", o) for n in "xy" for o in "ab"], key=repr)
    one, two = entries(4, a=1, b=lambda k: k, c=0), entries(4, x=lambda k: k, y=lambda k: 1 if k else 2)
    assert changes(spark, [(1, json.dumps(one)), (2, json.dumps(two))]) == [(1, 2, "a", "removed", ""), (1, 2, "c", "removed", ""), (1, 2, "x", "renamed", "b"), (1, 2, "y", "added", "")]


def test_exact_promotion_keeps_types_apart(spark):
    listed = [{"stars": 5, "license": "MIT"}, {"stars": "5", "license": 5}, {"stars": 5.5, "license": None}, {"stars": 5.0}, {"stars": True}, {"stars": 10**30}]
    df = spark.createDataFrame([(1, 1, 1, T0, json.dumps(listed))], FILES)
    table = schema_drift.promote(schema_drift.ingest(df), schema_drift.PROMOTED, exact=True)
    got = {r.pos: (r.stars, r.license, json.loads(r._rescued or "{}")) for r in table.collect()}
    assert got[0] == (5, "MIT", {}) and got[1] == (None, None, {"stars": "5", "license": 5}) and got[2] == (None, None, {"stars": 5.5})
    assert got[4] == (None, None, {"stars": True}) and got[5] == (None, None, {"stars": 10**30})
    # A value is the same whether its column holds it or it is rescued, and types are told apart either way.
    one, two = [{"id": "a", "stars": 5}, {"id": "b", "stars": 7}], [{"id": "a", "n": 5.0}, {"id": "b", "n": 7}]
    assert changes(spark, [(1, json.dumps(one)), (2, json.dumps(two))]) == [(1, 2, "n", "renamed", "stars")]
    two = [{"id": "a", "stars": 5.5}, {"id": "b", "stars": 7}]
    assert changes(spark, [(1, json.dumps(one)), (2, json.dumps(two))]) == []


# ------------------------------------------------------------------ 6


SNAPSHOT = "snapshot_id bigint, registry_id bigint, retrieved_at timestamp_ntz, ingested_at timestamp_ntz"
ENTRY = "snapshot_id bigint, pos bigint, entry_id string, repo string, verification_status string, listing_validated_commit string, upstream_observed_commit string, upstream_check_status string, repository_layout string, kind string, extra string"


def diff(spark, snaps, listed, depth=None):
    s = spark.createDataFrame([(i, r, T0 + dt.timedelta(hours=h), T0) for i, r, h in snaps], SNAPSHOT)
    e = spark.createDataFrame([(i, p, n, repo, None, None, None, None, None, None, extra) for i, p, n, repo, extra in listed], ENTRY)
    return rows(snapshots.snapshot_changes(s, e, depth))


def test_snapshots(spark):
    snaps = [(1, 7, 0), (2, 7, 5), (2, 7, 5), (3, 7, 3), (4, 7, 9), (9, 8, 0)]
    listed = [
        (1, 0, "a", "r", '{"x": 1, "y": [1, 2]}'), (1, 1, "b", None, None), (1, 2, "c", "r", None), (1, 3, "c", "dup", None), (1, 4, None, "r", None),
        (3, 0, "a", "r", '{"y":[1,2],"x":1.0}'), (3, 0, "a", "r", '{"y":[1,2],"x":1.0}'), (3, 1, "b", "", None), (3, 5, "c", "r", "null"), (3, 6, "A", "r", None),
        (2, 0, "a", "r", '{"x":"1","y":[1,2]}'), (2, 1, "b", "", None), (2, 5, "c", "r", "null"), (2, 6, "A", "r", None),
        (9, 0, "a", None, None),
    ]
    want = [(7, 2, "a", "changed"), (7, 3, "A", "added"), (7, 3, "b", "changed"), (7, 3, "c", "changed"), *[(7, 4, n, "removed") for n in "Aabc"]]
    for depth in (None, 1, 3):
        assert diff(spark, snaps, listed, depth) == sorted(want, key=repr)
    assert diff(spark, [], []) == []
    assert diff(spark, snaps, []) == []


def test_snapshots_like_plain_python(spark):
    rng = random.Random(5)
    snaps = [(i, i % 2, i) for i in range(8)]
    tables, listed = {}, []
    for i, _, _ in snaps:
        before = tables.get(i - 2, {})
        now = {k: (rng.choice("xyz") if rng.random() < 0.1 else v) for k, v in before.items() if rng.random() > 0.05}
        now |= {f"k{rng.randrange(10**6)}": rng.choice("xyz") for _ in range(60 if i < 2 else 3)}
        tables[i] = now
        listed += [(i, p, k, v, None) for p, (k, v) in enumerate(now.items())]
    want = []
    for i, r, _ in snaps[2:]:
        a, b = tables[i - 2], tables[i]
        want += [(r, i, k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)]
    for depth in (None, 1, 2):
        assert diff(spark, snaps, listed, depth) == sorted(want, key=repr)
