"""Text functions, identities, baselines, correlation and signals against plain Python."""

import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kelpline.functions import text
from kelpline.operators import baseline, correlate, identity, inventory, signals


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, v {kind}")
    return [r.x for r in df.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def normalized(url):
    s = url.strip()
    s = "".join(c.lower() if c.isascii() else c for c in s)
    for scheme in ("https://", "http://", "ssh://git@"):
        if s.startswith(scheme):
            s = s[len(scheme) :]
            break
    else:
        if s.startswith("git@"):
            s = s[4:].replace(":", "/", 1)
    s = s.removeprefix("www.").rstrip("/")
    while s.endswith(".git"):
        s = s[:-4]
    return s


def test_normalize_repository(spark):
    rng = random.Random(1)
    parts = ["https://", "http://", "ssh://git@", "git@", "www.", "Host.example", ":", "/", "a/B", ".git", "É", " ", " ", "//", "x"]
    urls = ["".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(1500)] + ["", "git@h:a/b.git", "HTTPS://WWW.H/A.git/"]
    assert values(spark, text.normalize_repository, [*urls, None]) == [*map(normalized, urls), None]


def test_safe_text(spark):
    inputs = ["a\tb\nc", "\x00\x1b[0m", "\x7f\x85é漢", "", None, "x" * 10_000 + "\x01"]
    want = [None if s is None else "".join(c if c in "\n\t" or unicodedata.category(c) != "Cc" else f"\\u{{{ord(c):x}}}" for c in s) for s in inputs]
    assert values(spark, text.safe_text, inputs) == want
    assert values(spark, lambda c: text.shown_line(c, F.lit(1), c), ["a\tb\nc", "\x01", None]) == ["a\\tb\\nc\t1\ta\\tb\\nc", "\\u{1}\t1\t\\u{1}", "\t1\t"]


def test_validation(spark):
    assert values(spark, text.valid_commit, ["a" * 40, "A0" * 32, "a" * 41, "g" * 40, "a" * 40 + "\n", None]) == [True, True, False, False, False, False]
    assert values(spark, text.valid_ref, ["main", "-x", "a~1^2", "", "a b", "x" * 257, None]) == [True, False, True, False, False, False, False]
    assert values(spark, text.is_backup, ["a.bak", "a.bak.1", "a~", "a.backup", "bak", "a.bakery"]) == [True, True, True, True, False, False]
    assert [tuple(r) for r in values(spark, text.split_range, ["a..b", "a", "..b", "a..b..c"])] == [("a", "b"), ("a", None), ("", "b"), ("a", "b..c")]
    assert [tuple(r) for r in values(spark, lambda c: text.truncated(c, 4), ["abc", "abcde", "ééé", None])] == [("abc", False), ("abcd", True), ("éé", True), (None, None)]
    assert values(spark, text.format_timestamp, [0, 1735689599, -1, None], "bigint") == ["1970-01-01T00:00:00Z", "2024-12-31T23:59:59Z", "1969-12-31T23:59:59Z", None]
    assert values(spark, lambda c: text.is_stale(c, 10_000_000), [10_000_000 - 2_592_000, 0, 20_000_000, None], "bigint") == [False, True, False, False]


def test_content_identity(spark):
    files = [("c", "b", "f", 0o100644, b"data"), ("c", "a/b", "f", 0o100755, b""), ("c", "a", "d", 0o40755, b""), ("c", "é", "l", 0o120777, b"to"), ("e", "x", "f", 1, b"1"), ("e", "x", "f", 1, b"1")]
    df = spark.createDataFrame(files, "k string, path string, kind string, mode bigint, data binary")
    got = {r.k: r for r in identity.content_identity(df, ["k"]).collect()}
    for key in "ce":
        h = hashlib.sha256()
        own = sorted({f[1:] for f in files if f[0] == key}, key=lambda f: f[0].encode())
        for path, kind, mode, data in own:
            p = path.encode()
            h.update(len(p).to_bytes(8, "big") + p + kind.encode() + mode.to_bytes(4, "big") + len(data).to_bytes(8, "big") + data)
        assert got[key].content_digest == h.hexdigest() and got[key].file_count == len(own)
        assert got[key].file_digests == {p: hashlib.sha256(k.encode() + m.to_bytes(4, "big") + d).hexdigest() for p, k, m, d in own}
    assert not got["c"].file_limit
    assert identity.content_identity(df.limit(0), ["k"]).count() == 0


def folded(files, file_limit, total, sample):
    """The budget's rule, file by file: nothing is opened once it is used up, and a sample's tail is charged beyond it."""
    used, out = 0, []
    for path, size in files:
        if used >= total:
            out.append((path, "skipped", 0))
            continue
        if size > file_limit or used + size > total:
            bound = min(sample, total - used)
            charged = min(size, bound) + (bound // 2 if size > bound and bound > 1 else 0)
            out.append((path, "sampled", charged))
        else:
            charged = size
            out.append((path, "read", size))
        used += charged
    return out


def test_budget_fold(spark):
    rng = random.Random(9)
    lists = [[(f"f{k}", rng.choice([0, 5, 50, 500])) for k in range(rng.randrange(12))] for _ in range(150)] + [[(f"f{k}", 0) for k in range(1_000)] + [("last", 301)] * 2]
    got = values(spark, lambda c: identity.budget_fold(c, 60, 300, 40), lists, "array<struct<path:string,size:bigint>>")
    assert [[tuple(r) for r in g] for g in got] == [folded(f, 60, 300, 40) for f in lists]


LOG = "k string, seq bigint, action string"


def test_log_operators(spark):
    log = spark.createDataFrame([("a", 1, "on"), ("a", 2, "off"), ("b", 1, "off"), ("b", 3, "on"), ("b", 2, "note"), ("c", 1, "note"), (None, 1, "on")], LOG)
    assert sorted(map(tuple, baseline.latest(log, ["k"], ["seq"]).collect()), key=str) == [("a", 2, "off"), ("b", 3, "on"), ("c", 1, "note"), (None, 1, "on")]
    assert sorted(map(tuple, baseline.nth_record(log, ["k"], ["seq"], 1).collect())) == [("a", 2, "off"), ("b", 2, "note")]
    assert {r.k for r in baseline.in_force(log, ["k"], ["seq"], ["on"], ["off"], "action").collect()} == {"b", None}
    assert [r.seq for r in baseline.record_by_digest(log, ["k"], ["seq"], F.col("action") == "off").where("k = 'a'").collect()] == [2]
    assert baseline.latest(log.limit(0), ["k"], ["seq"]).count() == 0
    present = spark.createDataFrame([("b", 0, "")], LOG)
    assert sorted(str(r.k) for r in baseline.absent(log, present, ["k"], present).collect()) == ["None", "a", "c"]


IDS = "machine_id bigint, plugin_id string, repository string, head string, tree string, content_digest string, file_count bigint, limitations array<string>, file_digests map<string,string>"


def test_comparison_ignores_file_maps_and_is_null_safe(spark):
    row = lambda p, head=None, lims=(), files=None: (1, p, None, head, None, "d", 1, list(lims), files)
    current = spark.createDataFrame([row("new"), row("same", files={"a": "1"}), row("part", lims=["x"]), row("drift", "h")], IDS)
    base = spark.createDataFrame([row("same"), row("part", lims=["x"]), row("drift")], IDS)
    got = {r.plugin_id: r.state for r in baseline.compare_with_baseline(current, base, ["machine_id", "plugin_id"]).collect()}
    assert got == {"new": "untrusted", "same": "unchanged", "part": "partial", "drift": "changed"}
    files = spark.createDataFrame([row("same", files={"a": "2", "b": None})], IDS)
    assert [r.path for r in baseline.changed_keys(current, files, ["plugin_id"], "file_digests").collect()] == ["a", "b"]


def test_correlation(spark):
    installed = spark.createDataFrame([(1, "a", "git@h:x/a.git", "c1"), (2, "a", "https://other/x", "c1"), (3, "n", None, "c2"), (4, "zz", "r", None), (5, "two", "r", "c"), (6, "a", "https://h/x/a", "c9")], "k int, plugin_id string, repository string, head string")
    catalog = spark.createDataFrame([("a", "https://h/x/a", "c1", "c2", "suite", "v"), ("n", None, "c2", None, "odd", "v"), ("two", "r", "c", "c", None, "v"), ("two", "r/", "c", "c", None, "v"), (None, "r", "c", "c", None, "v")], "entry_id string, repo string, listing_validated_commit string, upstream_observed_commit string, repository_layout string, verification_status string")
    got = {r.k: (r.status, r.installed_matches_listing, r.upstream_moved) for r in correlate.correlate(installed, catalog).collect()}
    assert got == {1: ("listed", True, True), 2: ("conflict", None, None), 3: ("incomplete", True, None), 4: ("unlisted", None, None), 5: ("conflict", None, None), 6: ("installed-differs", False, True)}


def test_listing_rows_are_claimed_once(spark):
    dirs = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (1, "q", "none")], "root int, name string, manifest_id string")
    listing = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "b", 3), (1, "z", 4)], "root int, id string, ord bigint")
    got = {(r.name, r.id, r.ord) for r in correlate.claim_listing_rows(dirs, listing).collect()}
    assert got == {("a", "x", 2), ("b", "b", 3), ("c", None, None), ("q", None, None), (None, "z", 4)}


def test_inventory(spark):
    good = '{"schemaVersion": 1, "id": "%s", "kinds": ["bar"]}'
    dirs = [("a", False, good % "x"), ("b.bak", False, good % "y"), ("c", True, good % "y"), ("d", False, "broken"), ("e", None, '{"schemaVersion": 2, "id": "q"}'), ("f", False, '{"schemaVersion": 1, "id": "z"}'), ("g", False, None)]
    directories = spark.createDataFrame([(1, *d) for d in dirs], "root int, name string, is_link boolean, manifest string")
    text = '[{"id":"x","clonedFrom":"","active":true},{"id":"z","clonedFrom":"u","kinds":["k"]},{"id":"y"},{"no":"id"},null]'
    rows, bad = inventory.parse_listing(spark.createDataFrame([(1, text), (2, None), (3, "{}"), (4, "nope")], "root int, text string"))
    assert {(r.root, r.limitation) for r in bad.collect()} == {(2, "listing_absent"), (3, "listing_malformed"), (4, "listing_malformed")}
    got = {r.name: r for r in inventory.inspect(directories, rows).collect()}
    assert {k: r.classification for k, r in got.items()} == {"a": "built-in", "b.bak": "backup", "c": "unscannable", "d": "unscannable", "e": "unscannable", "f": "cloned/local", "g": "unscannable"}
    assert (got["a"].kinds, got["f"].kinds, got["f"].repository, got["a"].repository, got["a"].active) == (["bar"], ["k"], "u", None, True)
    assert [r.name for r in inventory.inspect(directories, rows, "z").collect()] == ["f"]
    assert tuple(inventory.counts(inventory.inspect(directories, rows)).first()) == (6, 1, 4)


def test_inspection_tells_why_and_what_else(spark):
    good = '{"schemaVersion": 1, "id": "%s"}'
    dirs = [("a", False, good % "a", True, ["x"]), ("b", False, good % "other", False, None), ("c", None, "[", False, None), ("d.bak", False, good % "a", False, None), ("e", True, good % "e", False, None), ("f", False, None, False, None), ("g", False, "{}", False, ["z", "y", "z"])]
    directories = spark.createDataFrame([(1, *d) for d in dirs], "root int, name string, is_link boolean, manifest string, has_git boolean, limitations array<string>")
    rows, _ = inventory.parse_listing(spark.createDataFrame([(1, '[{"id":"a"},{"id":"e","enabled":true},{"id":"d.bak"},{"id":"c","kinds":["k"]}]')], "root int, text string"))
    got = {r.name: (r.id, r.classification, r.reason, r.limitations, r.enabled, r.kinds) for r in inventory.inspect(directories, rows).collect()}
    assert got == {
        "a": ("a", "Git-managed", None, ["x"], None, []), "b": ("other", "cloned/local", None, ["directory_id_mismatch"], None, []),
        "c": ("c", "unscannable", "manifest_malformed", [], None, ["k"]), "d.bak": ("d.bak", "backup", None, [], None, []),
        "e": ("e", "unscannable", "link", [], True, []), "f": ("f", "unscannable", "manifest_unavailable", [], None, []), "g": ("g", "unscannable", "manifest_invalid", ["y", "z"], None, []),
    }
    shown = inventory.in_order(inventory.inspect(directories, rows)).collect()
    assert [r.id for r in shown] == sorted(r.id for r in shown)


def test_report_rows_have_a_claim_only_if_it_is_known(spark):
    import json

    rows = spark.createDataFrame([("a", "x", None), ("b", None, True)], "id string, repository string, active boolean")
    claims = spark.createDataFrame([("a", "listed", None)], "id string, status string, upstream_moved boolean")
    got = {r.id: json.loads(r.json) for r in inventory.report_rows(rows, claims, ["id"]).collect()}
    assert got == {"a": {"id": "a", "repository": "x", "marketplace_status": "listed"}, "b": {"id": "b", "active": True}}


def test_appending_numbers_on(spark):
    log = spark.createDataFrame([("a", 7, "x"), ("a", 7, "x"), (None, 0, "y")], "k string, seq bigint, v string")
    fresh = spark.createDataFrame([("a", "p", 5), ("a", "p", 5), ("a", "o", 1), ("b", "q", None), (None, "r", 2)], "k string, v string, at bigint")
    whole = log.withColumn("at", F.lit(None).cast("bigint"))
    got = baseline.appended(whole, fresh, ["k"], ["at", "v"], F.coalesce(F.floor(F.col("at") / 2), F.lit(-1)))
    assert sorted([(r.k, r.seq, r.v) for r in got.collect()], key=str) == sorted([("a", 7, "x"), ("a", 7, "x"), (None, 0, "y"), ("a", 8, "o"), ("a", 9, "p"), ("a", 10, "p"), ("b", 0, "q"), (None, 1, "r")], key=str)


SIGNAL = "ord bigint, plugin_id string, kind string, severity string, key string"


def test_signal_state_forgets_recovered_keys(spark):
    live = spark.createDataFrame([(1, "p", "k", "warning", "a"), (1, "p", "k", "warning", "b"), (2, "p", "k", "critical", "b")], SIGNAL)
    state = spark.createDataFrame([("a", "t1"), ("gone", "t1")], "key string, emitted_at string")
    assert sorted(map(tuple, signals.next_state(live, state, "t2").collect())) == [("a", "t1"), ("b", "t2")]
    assert signals.new_signals(live, state).count() == 2
    assert tuple(signals.summary(live, state).first()) == (2, 2, False, "critical")
    assert tuple(signals.summary(live.limit(0), state).first()) == (0, 0, True, "none")
    assert signals.union_signals(live, live).count() == 6


@pytest.mark.parametrize("swap", ["head", "limitations", "file_count", "repository"])
def test_drift_key_covers_the_fields_of_equality(spark, swap):
    one = {"plugin_id": "p", "repository": None, "head": "h", "tree": None, "content_digest": "d", "file_count": 1, "limitations": ["x"]}
    other = one | {swap: {"head": "H", "limitations": ["x", "y"], "file_count": 2, "repository": ""}[swap]}
    schema = "plugin_id string, repository string, head string, tree string, content_digest string, file_count bigint, limitations array<string>"
    df = spark.createDataFrame([(one, one), (one, other)], f"a struct<{schema.replace(' ', ':').replace(',:', ',')}>, b struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    keys = [r.k for r in df.select(identity.drift_key(F.lit("p"), F.col("a"), F.col("b")).alias("k")).collect()]
    equal = [r.e for r in df.select(identity.same_identity(F.col("a"), F.col("b")).alias("e")).collect()]
    assert keys[0] != keys[1] and equal == [True, False] and all(k.startswith("drift:p:") for k in keys)
