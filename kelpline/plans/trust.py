"""Queries of the trust, drift and catalog operators, each with its SQL oracle (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text, times
from kelpline.operators import baseline, correlate, identity, inventory, schema_drift, signals, structural
from kelpline.operators.history import last_delivered
from kelpline.plans.general_sql import P1_PLUGINS, P5_ENTRIES, latest, seconds
from kelpline.sources import catalog
from kelpline.sources.tables import reader

#: Fixed clock of the queries about age.
NOW = 1_780_000_000
KEYS = ["machine_id", "plugin_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def repository_sql(c: str) -> str:
    bare = rf"translate(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '{text.UPPER}', '{text.LOWER}')"
    path = rf"""CASE WHEN regexp_matches({bare}, '^(https://|http://|ssh://git@)') THEN regexp_replace({bare}, '^(https://|http://|ssh://git@)', '')
      WHEN starts_with({bare}, 'git@') THEN regexp_replace(regexp_replace({bare}, '^git@', ''), '^([^:]*):', '\1/') ELSE {bare} END"""
    return rf"regexp_replace(regexp_replace(regexp_replace({path}, '^www\.', ''), '/+$', ''), '(\.git)+$', '')"


# ------------------------------------------------------------------ scalar functions


@query(f"SELECT DISTINCT repository, {repository_sql('repository')} AS normalized FROM installed_plugins")
def t_normalize_repository(spark, directory):
    rows = reader(spark, directory)("installed_plugins").select("repository").distinct()
    return rows.select("repository", text.normalize_repository(F.col("repository")).alias("normalized"))


@query("""SELECT snapshot_id, entry_id, pos, coalesce(regexp_full_match(upstream_observed_commit, '[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}'), FALSE) AS commit_ok,
  coalesce(regexp_full_match(entry_id, '[A-Za-z0-9_/.^~-]+') AND entry_id NOT LIKE '-%' AND strlen(entry_id) <= 256, FALSE) AS ref_ok,
  coalesce(starts_with(repo, 'https://'), FALSE) AS https, repository_layout IS NULL OR repository_layout IN ('root-plugin', 'monorepo', 'suite') AS layout_ok,
  sha256(repo) AS repo_digest FROM catalog_entries""")
def t_validate_listing(spark, directory):
    rows = reader(spark, directory)("catalog_entries")
    return rows.select(
        "snapshot_id", "entry_id", "pos",
        text.valid_commit(F.col("upstream_observed_commit")).alias("commit_ok"),
        text.valid_ref(F.col("entry_id")).alias("ref_ok"),
        text.is_https(F.col("repo")).alias("https"),
        text.known_layout(F.col("repository_layout")).alias("layout_ok"),
        text.sha256_hex(F.col("repo")).alias("repo_digest"),
    )


@query(f"""SELECT decision_id, s AS at, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS shown, CASE WHEN s IS NOT NULL THEN greatest({NOW} - s, 0) END AS age,
  coalesce({NOW} - s > 2592000, FALSE) AS stale FROM (SELECT decision_id, {seconds('created_at')} AS s FROM review_decisions)""")
def t_time_text(spark, directory):
    rows = reader(spark, directory)("review_decisions").select("decision_id", times.epoch_seconds(F.col("created_at")).alias("at"))
    at = F.col("at")
    return rows.select(
        "decision_id", "at", text.format_timestamp(at).alias("shown"), text.age_seconds(at, NOW).alias("age"), text.is_stale(at, NOW).alias("stale")
    )


@query(r"""SELECT doc_id, sha256(safe) AS digest, length(safe)::BIGINT AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]')
  THEN array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN unicode(c) NOT IN (9, 10) AND (unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 159)
    THEN '\u{' || printf('%x', unicode(c)) || '}' ELSE c END), '') ELSE text END AS safe FROM documents)""")
def t_safe_text(spark, directory):
    """Control characters of whole document texts, escaped."""
    rows = reader(spark, directory)("documents").select("doc_id", text.safe_text(F.col("text")).alias("safe"))
    return rows.select("doc_id", F.sha2("safe", 256).alias("digest"), F.length("safe").cast("long").alias("n"))


@query("""SELECT install_id, machine_id, path, coalesce(path LIKE '%.bak' OR contains(path, '.bak.') OR path LIKE '%.backup' OR path LIKE '%~', FALSE) AS backup,
  array_to_string(list_sort(kinds), ', ') AS kinds_text, enabled IS NOT DISTINCT FROM active AS same_state FROM installed_plugins""")
def t_describe_installation(spark, directory):
    rows = reader(spark, directory)("installed_plugins")
    return rows.select(
        "install_id", "machine_id", "path",
        F.coalesce(text.is_backup(F.col("path")), F.lit(False)).alias("backup"),
        F.array_join(F.array_sort("kinds"), ", ").alias("kinds_text"),
        F.col("enabled").eqNullSafe(F.col("active")).alias("same_state"),
    )


RANGE = "concat_ws(CASE decision_id % 3 WHEN 0 THEN '..' WHEN 1 THEN '...' ELSE '-' END, plugin_id, scope, action)"


@query(f"""SELECT decision_id, r AS range, CASE WHEN contains(r, '..') THEN left(r, strpos(r, '..') - 1) ELSE r END AS range_start, CASE WHEN contains(r, '..') THEN substr(r, strpos(r, '..') + 2) END AS range_end
FROM (SELECT decision_id, {RANGE} AS r FROM review_decisions)""")
def t_split_range(spark, directory):
    sep = F.expr("CASE decision_id % 3 WHEN 0 THEN '..' WHEN 1 THEN '...' ELSE '-' END")
    rows = reader(spark, directory)("review_decisions").select("decision_id", F.concat_ws("\u0001", "plugin_id", "scope", "action").alias("parts"), sep.alias("sep"))
    ranges = rows.select("decision_id", F.replace("parts", F.lit("\u0001"), F.col("sep")).alias("range"))
    halves = ranges.withColumn("halves", text.split_range(F.col("range")))
    return halves.select("decision_id", "range", F.col("halves.start").alias("range_start"), F.col("halves.end").alias("range_end"))


@query("""SELECT install_id, machine_id, removed_at IS NULL AS here, coalesce(path = '/opt/x' OR path IS NULL AND classification IS NULL, FALSE) AS expected, path IS NOT DISTINCT FROM classification AS same, length(classification) > 0 AS dirty FROM installed_plugins""")
def t_expected(spark, directory):
    rows = reader(spark, directory)("installed_plugins")
    both = F.coalesce((F.col("path") == "/opt/x") | (F.col("path").isNull() & F.col("classification").isNull()), F.lit(False))
    return rows.select(
        "install_id", "machine_id", F.col("removed_at").isNull().alias("here"), both.alias("expected"),
        text.as_expected(F.col("path"), F.col("classification")).alias("same"), text.is_dirty(F.col("classification")).alias("dirty"),
    )


# ------------------------------------------------------------------ manifests, listings, catalogs


# Manifests as text, of every sort: broken, of another version, without an id, without kinds.
MANIFEST = """SELECT DISTINCT machine_id AS root, regexp_extract(path, '[^/]*$') AS name, plugin_id, kinds, install_id % 7 AS sort FROM installed_plugins WHERE path IS NOT NULL"""


def _manifests(spark, directory) -> DataFrame:
    """root, name, plugin_id, sort and the manifest's text of each installation."""
    rows = reader(spark, directory)("installed_plugins").where("path IS NOT NULL").select(
        F.col("machine_id").alias("root"), F.regexp_extract("path", r"[^/]*\z", 0).alias("name"), "plugin_id", "kinds", (F.col("install_id") % 7).alias("sort")
    ).distinct()
    whole = F.to_json(F.struct(F.when(F.col("sort") == 1, 2).otherwise(1).alias("schemaVersion"), F.when(F.col("sort") != 2, F.col("plugin_id")).alias("id"), F.when(F.col("sort") != 3, F.col("kinds")).alias("kinds")))
    return rows.withColumn("manifest", F.when(F.col("sort") == 4, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(F.col("sort") != 5, whole))


@query(f"""SELECT root, name, sort, sort NOT IN (1, 2, 4, 5) AND plugin_id IS NOT NULL AS valid, CASE WHEN sort NOT IN (2, 4, 5) THEN plugin_id END AS id,
  coalesce(array_to_string(CASE WHEN sort NOT IN (3, 4, 5) THEN kinds END, ','), '') AS kinds FROM ({MANIFEST})""")
def t_manifest(spark, directory):
    read = _manifests(spark, directory).select("root", "name", "sort", inventory.manifest(F.col("manifest")).alias("m"))
    return read.select("root", "name", "sort", F.col("m.valid").alias("valid"), F.col("m.id").alias("id"), F.array_join("m.kinds", ",").alias("kinds"))


def _listings(spark, directory) -> DataFrame:
    """root (a report) and the text of its ``plugins``, as a runtime listing; null where there is none."""
    rows = reader(spark, directory)("inventory_reports").select("report_id", "received_at", "payload")
    last = structural.last_readable(rows, "report_id", "received_at", "payload")
    node = F.try_variant_get("record", "$.plugins", "variant")
    return last.select(F.col("report_id").alias("root"), F.to_json(node).alias("text"))


@query(P1_PLUGINS + """
SELECT report_id AS root, p ->> '$.id' AS id, plugin_pos AS ord, CASE WHEN json_type(p, '$.enabled') = 'BOOLEAN' THEN (p ->> '$.enabled')::BOOLEAN END AS enabled,
  CASE WHEN json_type(p, '$.active') = 'BOOLEAN' THEN (p ->> '$.active')::BOOLEAN END AS active, CASE WHEN json_type(p, '$.kinds') = 'ARRAY' THEN array_to_string(p ->> '$.kinds[*]', ',') ELSE '' END AS kinds
FROM plugins WHERE p ->> '$.id' IS NOT NULL AND report_id IN (SELECT report_id FROM last WHERE json_type(r, '$.plugins') = 'ARRAY')""")
def t_parse_listing(spark, directory):
    rows, _ = inventory.parse_listing(_listings(spark, directory))
    return rows.select("root", "id", "ord", "enabled", "active", F.array_join("kinds", ",").alias("kinds"))


@query(P1_PLUGINS + """
SELECT report_id AS root, CASE WHEN json_exists(r, '$.plugins') THEN 'listing_malformed' ELSE 'listing_absent' END AS limitation FROM last WHERE coalesce(json_type(r, '$.plugins'), '') <> 'ARRAY'""")
def t_listing_limitations(spark, directory):
    _, limitations = inventory.parse_listing(_listings(spark, directory))
    return limitations


# A directory's manifest is the first by its sort and id; the listing has the newest installation of each id.
INSPECTED = f"""WITH all_dirs AS (SELECT root, name, min(struct_pack(s := sort, p := plugin_id)) AS m, bool_or(sort = 6) AS is_link FROM ({MANIFEST} AND plugin_id IS NOT NULL) GROUP BY ALL),
dirs AS (SELECT root, name, is_link, m.s AS sort, CASE WHEN NOT is_link AND m.s NOT IN (2, 4, 5) THEN m.p END AS mid, name LIKE '%.bak' OR contains(name, '.bak.') OR name LIKE '%.backup' OR name LIKE '%~' AS backup FROM all_dirs),
listing AS (SELECT machine_id AS root, plugin_id AS id, max(install_id) AS ord, arg_max(struct_pack(e := enabled, a := active, f := first_party, c := coalesce(repository, '')), install_id) AS v
  FROM installed_plugins WHERE plugin_id IS NOT NULL GROUP BY ALL),
one AS (SELECT d.*, CASE WHEN r.id IS NOT NULL AND row_number() OVER (PARTITION BY d.root, d.mid ORDER BY d.name) = 1 THEN d.mid END AS claimed
  FROM (SELECT * FROM dirs WHERE NOT backup) d LEFT JOIN listing r ON d.root = r.root AND d.mid = r.id),
two AS (SELECT o.*, coalesce(claimed, f.id) AS rid FROM one o LEFT JOIN (SELECT root, id FROM listing ANTI JOIN (SELECT root, claimed AS id FROM one WHERE claimed IS NOT NULL) USING (root, id)) f ON o.root = f.root AND o.name = f.id),
told AS (SELECT d.*, t.rid, l.v, CASE WHEN d.is_link THEN 'unscannable' WHEN d.backup THEN 'backup' WHEN d.mid IS NULL OR d.sort = 1 THEN 'unscannable'
    WHEN coalesce(l.v.f, FALSE) OR l.v.c IS NOT DISTINCT FROM '' THEN 'built-in' ELSE 'cloned/local' END AS classification
  FROM dirs d LEFT JOIN two t USING (root, name) LEFT JOIN listing l ON l.root = d.root AND l.id = t.rid)
SELECT root, name, classification, CASE WHEN classification IN ('unscannable', 'backup') THEN coalesce(rid, name) ELSE mid END AS id,
  CASE WHEN classification = 'unscannable' THEN CASE WHEN is_link THEN 'link' WHEN sort = 5 THEN 'manifest_unavailable' WHEN sort = 4 THEN 'manifest_malformed' ELSE 'manifest_invalid' END END AS reason,
  nullif(v.c, '') AS repository, v.e AS enabled, v.a AS active, v.f AS first_party,
  CASE WHEN classification IN ('built-in', 'cloned/local') AND mid <> name THEN 'directory_id_mismatch' ELSE '' END AS limitations FROM told"""


@query(INSPECTED)
def t_inspect(spark, directory):
    dirs = _manifests(spark, directory).where("plugin_id IS NOT NULL").groupBy("root", "name").agg(
        F.min(F.struct("sort", "plugin_id", "manifest")).alias("m"), F.bool_or(F.col("sort") == 6).alias("is_link")
    ).select("root", "name", "is_link", "m.manifest")
    rows = reader(spark, directory)("installed_plugins").where("plugin_id IS NOT NULL").groupBy("machine_id", "plugin_id").agg(
        F.max("install_id").alias("ord"), F.max_by(F.struct("enabled", "active", "first_party", F.coalesce("repository", F.lit("")).alias("cloned_from")), "install_id").alias("v")
    )
    listing = rows.select(F.col("machine_id").alias("root"), F.col("plugin_id").alias("id"), "ord", "v.*", F.array().cast("array<string>").alias("kinds"))
    found = inventory.inspect(dirs, listing)
    return found.select("root", "name", "classification", "id", "reason", "repository", "enabled", "active", "first_party", F.array_join("limitations", ",").alias("limitations"))


_FIELD = "CASE WHEN json_type(l[i], '$.{0}') NOT IN ('NULL', 'ARRAY', 'OBJECT') THEN l[i] ->> '$.{0}' END AS {1}"


@query(P5_ENTRIES + """
SELECT registry_id, file_seq, i - 1 AS pos, """ + ", ".join(_FIELD.format(k, n) for k, n in catalog.FIELDS.items()) + """,
  CASE WHEN json_type(l[i]) = 'OBJECT' THEN len(list_filter(list_distinct(json_keys(l[i])), lambda k: k NOT IN """ + str(tuple(catalog.FIELDS)) + """)) END::BIGINT AS n_extra
FROM (SELECT registry_id, file_seq, l, unnest(range(1, len(l) + 1)) AS i FROM files)""")
def t_catalog_parse(spark, directory):
    """Every entry of every catalog file, parsed where it lies."""
    files = schema_drift.readable_files(reader(spark, directory)("catalog_files"))
    entries = catalog.parsed_entries(files, ["registry_id", "file_seq"], F.col("list"))
    return entries.withColumn("n_extra", F.size(F.map_keys(F.try_variant_get(F.try_parse_json("extra"), "$", "map<string,variant>"))).cast("long")).drop("extra")


# ------------------------------------------------------------------ identities


@query("""WITH once AS (SELECT DISTINCT machine_id, plugin_id, revision, file_digests FROM identities_local)
SELECT machine_id, plugin_id, revision,
  sha256(coalesce((SELECT string_agg(e.key || chr(9) || coalesce(e.value, '') || chr(10), '' ORDER BY e.key) FROM unnest(map_entries(file_digests)) AS u(e)), '')) AS content_digest,
  coalesce(cardinality(file_digests), 0)::BIGINT AS file_count FROM identities_local""")
def t_map_digest(spark, directory):
    rows = reader(spark, directory)("identities_local")
    return identity.map_identity(rows, [*KEYS, "revision"], "file_digests")


def _latest_files(spark, directory) -> DataFrame:
    """Files of each installation's latest identity: path and digest; one row without a path where there are none."""
    newest = baseline.latest(reader(spark, directory)("identities_local").select(*KEYS, "revision", "file_digests"), KEYS, ["revision"])
    return newest.select(*KEYS, F.explode_outer("file_digests").alias("path", "digest"))


def _file_entries(files: DataFrame) -> DataFrame:
    """path, kind, mode and (here) the digest's bytes as data.  A file whose digest is not known (null,
    or no hexadecimal text) is of kind '?' and its data is the text there is."""
    known = F.unhex("digest")
    kind = F.when(known.isNotNull(), "f").otherwise("?")
    data = F.coalesce(known, F.encode("digest", "UTF-8"), F.lit(b""))
    return files.select(*KEYS, "path", kind.alias("kind"), F.lit(0o100644).cast("long").alias("mode"), data.alias("data"))


FILES = f"""newest AS {latest('identities_local', 'machine_id, plugin_id', 'revision')},
files AS (SELECT machine_id, plugin_id, e.key AS path, e.value AS digest, coalesce(regexp_full_match(e.value, '([0-9A-Fa-f]{{2}})*'), FALSE) AS known
  FROM newest LEFT JOIN unnest(map_entries(file_digests)) AS u(e) ON TRUE),
data AS (SELECT machine_id, plugin_id, path, CASE WHEN known THEN '66' ELSE '3F' END || '000081A4' AS head, CASE WHEN known THEN upper(digest) ELSE coalesce(hex(encode(digest)), '') END AS bytes FROM files)"""


@query(f"""WITH {FILES},
coded AS (SELECT machine_id, plugin_id, path, lpad(to_hex(octet_length(encode(path))), 16, '0') || hex(encode(path)) || head || lpad(to_hex(length(bytes) // 2), 16, '0') || bytes AS code FROM data)
SELECT machine_id, plugin_id, sha256(unhex(coalesce(string_agg(code, '' ORDER BY path), ''))) AS content_digest, count(path) AS file_count, count(path) > 10000 AS file_limit FROM coded GROUP BY ALL""")
def t_content_digest(spark, directory):
    out = identity.content_identity(_file_entries(_latest_files(spark, directory)), KEYS)
    return out.select(*KEYS, "content_digest", "file_count", F.coalesce("file_limit", F.lit(False)).alias("file_limit"))


@query(f"""WITH {FILES} SELECT machine_id, plugin_id, path, sha256(unhex(head || bytes)) AS digest FROM data WHERE path IS NOT NULL""")
def t_file_digest(spark, directory):
    files = _file_entries(_latest_files(spark, directory)).where("path IS NOT NULL")
    return files.select(*KEYS, "path", identity.file_digest(F.col("kind"), F.col("mode"), F.col("data")).alias("digest"))


@query("""SELECT machine_id, plugin_id, revision, array_to_string(list_sort(list_distinct(list_filter(coalesce(limitations, []), lambda x: x IS NOT NULL))), ',') AS limitations FROM identities_mirror""")
def t_limitation_set(spark, directory):
    rows = reader(spark, directory)("identities_mirror")
    return rows.select(*KEYS, "revision", F.array_join(identity.limitation_set(F.col("limitations")), ",").alias("limitations"))


# Of a plugin the fold goes file by file until its budget is used up; whatever comes later is skipped.
@query("""WITH RECURSIVE files AS (SELECT plugin_id, path, size, row_number() OVER (PARTITION BY plugin_id ORDER BY string_split(path, '/')) AS n
  FROM (SELECT plugin_id, concat_ws('/', source, doc_id::VARCHAR) AS path, coalesce(n_chars, 0)::BIGINT AS size FROM documents)),
fold AS (
  SELECT plugin_id, 0::BIGINT AS n, NULL::VARCHAR AS path, NULL::VARCHAR AS outcome, 0::BIGINT AS charge, 0::BIGINT AS used FROM (SELECT DISTINCT plugin_id FROM files)
  UNION ALL
  SELECT f.plugin_id, f.n, f.path, CASE WHEN fits THEN 'read' ELSE 'sampled' END,
    CASE WHEN fits THEN size ELSE least(size, bound) + CASE WHEN size > bound AND bound > 1 THEN bound // 2 ELSE 0 END END,
    used + CASE WHEN fits THEN size ELSE least(size, bound) + CASE WHEN size > bound AND bound > 1 THEN bound // 2 ELSE 0 END END
  FROM (SELECT g.*, a.used, least(400, 6000 - a.used) AS bound, size <= 2000 AND size <= 6000 - a.used AS fits
        FROM fold a JOIN files g ON a.plugin_id IS NOT DISTINCT FROM g.plugin_id AND g.n = a.n + 1 WHERE a.used < 6000) f)
SELECT f.plugin_id, f.path, coalesce(a.outcome, 'skipped') AS outcome, coalesce(a.charge, 0) AS charged
FROM files f LEFT JOIN fold a ON a.plugin_id IS NOT DISTINCT FROM f.plugin_id AND a.n = f.n""")
def t_budget_fold(spark, directory):
    """Files in visit order under a byte budget: documents stand in, a plugin's texts being its
    files (those of no plugin are one group, and without a source a file is at the root)."""
    docs = reader(spark, directory)("documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    files = docs.select(
        "plugin_id",
        # Ranges of a plugin's order, so no task sorts an unbounded number of files of a hot one.
        identity.visit_order(F.concat_ws("/", "source", F.col("doc_id").cast("string").substr(1, 3))).alias("range"),
        identity.visit_order(path).alias("place"),
        path.alias("path"),
        F.coalesce(F.col("n_chars"), F.lit(0).cast("long")).alias("size"),
    )
    return identity.budget_folds(files, ["plugin_id"], "range", 2_000, 6_000, 400)


@query("""SELECT machine_id, plugin_id, revision, json_array(plugin_id, repository, head, tree, content_digest, coalesce(file_count, 0), limitations)::VARCHAR AS material FROM identities_mirror""")
def t_identity_material(spark, directory):
    rows = reader(spark, directory)("identities_mirror").select(*KEYS, "revision", F.struct(*identity.FIELDS).alias("record"))
    return rows.select(*KEYS, "revision", identity.identity_material(identity.identity_of(F.col("record"))).alias("material"))


# ------------------------------------------------------------------ baselines and drift


def _records(spark, directory) -> DataFrame:
    rows = reader(spark, directory)("trust_records")
    slim = rows.select("record_id", *KEYS, "seq", F.col("accepted").alias("accepted"), "ingested_at")
    flat = slim.select("record_id", *KEYS, "seq", *[F.col(f"accepted.{f}").alias(f) for f in identity.FIELDS[1:]], "ingested_at")
    return last_delivered(flat, "record_id", [*KEYS, "seq", *identity.FIELDS[1:]], "ingested_at").where("plugin_id IS NOT NULL")


RECORDS = f"""records AS (SELECT record_id, machine_id, plugin_id, seq, accepted.repository AS repository, accepted.head AS head, accepted.tree AS tree,
  accepted.content_digest AS content_digest, accepted.file_count AS file_count, accepted.limitations AS limitations
  FROM {latest('trust_records', 'record_id')} WHERE plugin_id IS NOT NULL),
base AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY machine_id, plugin_id ORDER BY seq DESC) = 1)"""


@query(f"WITH {RECORDS} SELECT machine_id, plugin_id, record_id, seq, head, content_digest FROM base")
def t_latest_baseline(spark, directory):
    return baseline.latest(_records(spark, directory), KEYS, ["seq"]).select(*KEYS, "record_id", "seq", "head", "content_digest")


@query(f"WITH {RECORDS} SELECT machine_id, plugin_id, record_id FROM records QUALIFY row_number() OVER (PARTITION BY machine_id, plugin_id ORDER BY seq) = 2")
def t_second_record(spark, directory):
    return baseline.nth_record(_records(spark, directory).select(*KEYS, "record_id", "seq"), KEYS, ["seq"], 1).select(*KEYS, "record_id")


@query(f"""WITH {RECORDS}, asked AS (SELECT machine_id, plugin_id, content_digest AS wanted FROM {latest('identities_local', 'machine_id, plugin_id', 'revision')} WHERE content_digest IS NOT NULL)
SELECT machine_id, plugin_id, record_id, seq FROM records JOIN asked USING (machine_id, plugin_id) WHERE content_digest = wanted
QUALIFY row_number() OVER (PARTITION BY machine_id, plugin_id ORDER BY seq DESC) = 1""")
def t_record_by_digest(spark, directory):
    """Of each installed component the newest record that accepted what it holds now."""
    asked = baseline.latest(reader(spark, directory)("identities_local").select(*KEYS, "content_digest", "revision"), KEYS, ["revision"])
    log = _records(spark, directory).select(*KEYS, "record_id", "seq", "content_digest").join(asked.select(*KEYS, F.col("content_digest").alias("wanted")), KEYS)
    return baseline.record_by_digest(log, KEYS, ["seq"], F.col("content_digest") == F.col("wanted")).select(*KEYS, "record_id", "seq")


@query("""WITH log AS (SELECT machine_id, seq, record_id AS id, 'record' AS kind FROM trust_records),
ends AS (SELECT machine_id, max(seq) AS e FROM log GROUP BY ALL)
SELECT * FROM log UNION ALL SELECT d.machine_id, coalesce(e, -1) + row_number() OVER (PARTITION BY d.machine_id ORDER BY d.seq, d.decision_id, d.ingested_at), decision_id, 'decision'
FROM review_decisions d LEFT JOIN ends ON d.machine_id IS NOT DISTINCT FROM ends.machine_id""")
def t_appended(spark, directory):
    """Decisions appended to the log of records of their machine."""
    t = reader(spark, directory)
    log = t("trust_records").select("machine_id", "seq", F.col("record_id").alias("id"), F.lit("record").alias("kind"))
    fresh = t("review_decisions").select("machine_id", F.col("decision_id").alias("id"), F.lit("decision").alias("kind"), F.col("seq").alias("at"), "ingested_at")
    numbered = baseline.appended(log.withColumns({"at": F.lit(None).cast("long"), "ingested_at": F.lit(None).cast("timestamp_ntz")}), fresh, ["machine_id"], ["at", "id", "ingested_at"], F.coalesce(F.floor(F.col("at") / 65_536), F.lit(-1 << 62)))
    return numbered.select("machine_id", "seq", "id", "kind")


DECISIONS = f"decisions AS {latest('review_decisions', 'decision_id')}"


def _decisions(spark, directory) -> DataFrame:
    rows = reader(spark, directory)("review_decisions").select("decision_id", *KEYS, "seq", "action", "scope", "ingested_at")
    return last_delivered(rows, "decision_id", [*KEYS, "seq", "action", "scope"], "ingested_at")


REVOKED = """revoked AS (SELECT machine_id, plugin_id FROM (SELECT * FROM decisions WHERE action IN ('untrust', 'rebaseline', 'restore') AND plugin_id IS NOT NULL)
  GROUP BY ALL HAVING arg_max(action, seq) = 'untrust')"""


@query(f"WITH {DECISIONS}, {REVOKED} SELECT * FROM revoked")
def t_revoked(spark, directory):
    rows = _decisions(spark, directory).where("plugin_id IS NOT NULL")
    return baseline.in_force(rows, KEYS, ["seq"], ["untrust"], ["rebaseline", "restore"], "action")


CURRENT = f"current AS {latest('identities_local', 'machine_id, plugin_id', 'revision')}"
DIFFERS = " OR ".join(f"c.{f} IS DISTINCT FROM b.{f}" for f in identity.FIELDS[1:])


def _current(spark, directory) -> DataFrame:
    rows = reader(spark, directory)("identities_local").select(*KEYS, *identity.FIELDS[1:], "file_digests", "revision")
    return baseline.latest(rows, KEYS, ["revision"])


@query(f"""WITH {RECORDS}, {CURRENT}
SELECT machine_id, plugin_id, CASE WHEN b.record_id IS NULL THEN 'untrusted' WHEN {DIFFERS} THEN 'changed' WHEN len(c.limitations) > 0 THEN 'partial' ELSE 'unchanged' END AS state
FROM current c LEFT JOIN base b USING (machine_id, plugin_id)""")
def t_compare_baseline(spark, directory):
    base = baseline.latest(_records(spark, directory), KEYS, ["seq"])
    return baseline.compare_with_baseline(_current(spark, directory), base, KEYS)


@query(f"""WITH a AS {latest('identities_local', 'machine_id, plugin_id', 'revision')}, b AS {latest('identities_mirror', 'machine_id, plugin_id', 'revision')},
x AS (SELECT machine_id, plugin_id, e.key AS path, e.value AS v, TRUE AS h FROM (SELECT machine_id, plugin_id, unnest(map_entries(file_digests)) AS e FROM a) SEMI JOIN b USING (machine_id, plugin_id)),
y AS (SELECT machine_id, plugin_id, e.key AS path, e.value AS v, TRUE AS h FROM (SELECT machine_id, plugin_id, unnest(map_entries(file_digests)) AS e FROM b) SEMI JOIN a USING (machine_id, plugin_id))
SELECT machine_id, plugin_id, path FROM x FULL JOIN y USING (machine_id, plugin_id, path) WHERE x.v IS DISTINCT FROM y.v OR x.h IS DISTINCT FROM y.h""")
def t_changed_files(spark, directory):
    t = reader(spark, directory)
    old, new = (baseline.latest(t(n).select(*KEYS, "file_digests", "revision"), KEYS, ["revision"]) for n in ("identities_local", "identities_mirror"))
    return baseline.changed_keys(old, new, KEYS, "file_digests")


# The cut is in bytes: as many characters as fit whole.
ORACLES["t_changed_text"] = f"""SELECT machine_id, plugin_id, left(t, list_max(list_filter(range(0, 91), lambda k: strlen(left(t, k)) <= 90))) AS text, strlen(t) > 90 AS truncated
  FROM (SELECT machine_id, plugin_id, string_agg('changed: ' || path || chr(10), '' ORDER BY path) AS t FROM ({ORACLES["t_changed_files"]}) GROUP BY ALL)"""


@query()
def t_changed_text(spark, directory):
    return baseline.changed_text(t_changed_files(spark, directory), KEYS, 90)


MISSING = f"""{RECORDS}, {DECISIONS}, {REVOKED},
missing AS (SELECT DISTINCT machine_id, plugin_id FROM records ANTI JOIN (SELECT machine_id, plugin_id FROM installed_plugins WHERE removed_at IS NULL) i USING (machine_id, plugin_id)
  ANTI JOIN revoked USING (machine_id, plugin_id) ANTI JOIN (SELECT machine_id, plugin_id FROM decisions WHERE action = 'exclude' AND scope = 'missing-plugin') e USING (machine_id, plugin_id))"""


def _missing(spark, directory) -> DataFrame:
    here = reader(spark, directory)("installed_plugins").where("removed_at IS NULL")
    decisions = _decisions(spark, directory)
    revoked = baseline.in_force(decisions.where("plugin_id IS NOT NULL"), KEYS, ["seq"], ["untrust"], ["rebaseline", "restore"], "action")
    excluded = decisions.where("action = 'exclude' AND scope = 'missing-plugin'")
    return baseline.absent(_records(spark, directory), here, KEYS, revoked, excluded)


@query(f"WITH {MISSING} SELECT * FROM missing")
def t_missing(spark, directory):
    return _missing(spark, directory)


@query("""SELECT machine_id, plugin_id, plugin_id IS NOT NULL AND EXISTS (SELECT 1 FROM review_decisions d WHERE d.machine_id = i.machine_id AND d.plugin_id = i.plugin_id AND action = 'acknowledge') AS acknowledged
FROM (SELECT DISTINCT machine_id, plugin_id FROM installed_plugins) i""")
def t_acknowledged(spark, directory):
    t = reader(spark, directory)
    done = t("review_decisions").where("action = 'acknowledge'").select(*KEYS, F.lit(True).alias("done")).distinct()
    rows = t("installed_plugins").select(*KEYS).distinct().join(done, KEYS, "left")
    return rows.select(*KEYS, F.coalesce("done", F.lit(False)).alias("acknowledged"))


# ------------------------------------------------------------------ catalog


NEWEST = """newest AS (SELECT s.registry_id, arg_max(s.snapshot_id, s.retrieved_at) AS snapshot_id FROM catalog_snapshots s GROUP BY ALL),
listed AS (SELECT DISTINCT entry_id, repo, listing_validated_commit, upstream_observed_commit, repository_layout, verification_status FROM catalog_entries SEMI JOIN newest USING (snapshot_id))"""


def _listed(spark, directory) -> DataFrame:
    t = reader(spark, directory)
    newest = t("catalog_snapshots").groupBy("registry_id").agg(F.max_by("snapshot_id", "retrieved_at").alias("snapshot_id"))
    entries = t("catalog_entries").join(newest, "snapshot_id", "left_semi")
    return entries.select(
        "entry_id", "repo", "listing_validated_commit", "upstream_observed_commit", "repository_layout", "verification_status"
    ).distinct()


@query(f"""WITH {CURRENT}, {NEWEST},
own AS (SELECT machine_id, plugin_id, head, {repository_sql('repository')} AS r FROM current),
cat AS (SELECT entry_id, {repository_sql('repo')} AS r, listing_validated_commit AS v, upstream_observed_commit AS o, repository_layout AS l, verification_status AS s FROM listed WHERE entry_id IS NOT NULL),
counted AS (SELECT machine_id, plugin_id, any_value(head) AS head, count(c.entry_id) AS n_id, count_if(c.entry_id IS NOT NULL AND c.r IS NOT DISTINCT FROM own.r) AS n_match,
  min(struct_pack(v := v, o := o, l := l, s := s)) FILTER (c.entry_id IS NOT NULL AND c.r IS NOT DISTINCT FROM own.r) AS k
  FROM own LEFT JOIN cat c ON own.plugin_id = c.entry_id GROUP BY ALL)
SELECT machine_id, plugin_id,
  CASE WHEN n_id = 0 THEN 'unlisted' WHEN n_match <> 1 THEN 'conflict' WHEN NOT (k.l IS NULL OR k.l IN ('root-plugin', 'monorepo', 'suite')) THEN 'incomplete'
    WHEN head <> k.v THEN 'installed-differs' ELSE 'listed' END AS status,
  CASE WHEN n_match = 1 THEN head = k.v END AS installed_matches_listing, CASE WHEN n_match = 1 THEN k.o <> k.v END AS upstream_moved, CASE WHEN n_match = 1 THEN k.s END AS verification_status
FROM counted""")
def t_correlate(spark, directory):
    mine = _current(spark, directory).select(*KEYS, "repository", "head")
    return correlate.correlate(mine, _listed(spark, directory)).drop("repository", "head")


@query(f"""WITH {CURRENT}, newest AS (SELECT unnest(x) FROM (SELECT registry_id, arg_max(struct_pack(snapshot_id := snapshot_id, repository := repository, repository_commit := repository_commit, retrieved_at := retrieved_at, generation_time := generation_time), retrieved_at) AS x FROM catalog_snapshots GROUP BY registry_id)),
listed AS (SELECT DISTINCT n.repository AS rr, n.repository_commit AS rc, n.retrieved_at AS ra, n.generation_time AS gt, e.entry_id, e.repo, e.listing_validated_commit AS v, e.upstream_observed_commit AS o, e.repository_layout AS l, e.verification_status AS s
  FROM catalog_entries e JOIN newest n USING (snapshot_id) WHERE entry_id IS NOT NULL),
cat AS (SELECT *, {repository_sql('repo')} AS r FROM listed),
own AS (SELECT machine_id, plugin_id, head, {repository_sql('repository')} AS r FROM current),
counted AS (SELECT own.machine_id, own.plugin_id, any_value(own.head) AS head, count(c.entry_id) AS n_id, count_if(c.entry_id IS NOT NULL AND c.r IS NOT DISTINCT FROM own.r) AS n,
  any_value(struct_pack(rr := c.rr, rc := c.rc, ra := c.ra, gt := c.gt, repo := c.repo, v := c.v, o := c.o, l := c.l, s := c.s)) FILTER (c.entry_id IS NOT NULL AND c.r IS NOT DISTINCT FROM own.r) AS k
  FROM own LEFT JOIN cat c ON own.plugin_id = c.entry_id GROUP BY ALL),
one AS (SELECT machine_id, plugin_id, head, n_id, n, CASE WHEN n = 1 THEN k END AS k FROM counted)
SELECT machine_id, plugin_id, CASE WHEN n_id = 0 THEN 'unlisted' WHEN n <> 1 THEN 'conflict' WHEN NOT (k.l IS NULL OR k.l IN ('root-plugin', 'monorepo', 'suite')) THEN 'incomplete' WHEN head <> k.v THEN 'installed-differs' ELSE 'listed' END AS status,
  k.rr AS registry_repository, k.rc AS registry_commit, k.ra AS retrieved_at, k.gt AS generation_time, k.repo AS repository, k.s AS verification_status, k.v AS listing_validated_commit, k.o AS upstream_observed_commit,
  k.o <> k.v AS upstream_moved, head = k.v AS installed_matches_listing, k.l AS repository_layout FROM one""")
def t_claim(spark, directory):
    t = reader(spark, directory)
    newest = t("catalog_snapshots").groupBy("registry_id").agg(
        F.max_by(F.struct("snapshot_id", F.col("repository").alias("registry_repository"), F.col("repository_commit").alias("registry_commit"), "retrieved_at", "generation_time"), "retrieved_at").alias("s")
    ).select("s.*")
    listed = t("catalog_entries").join(newest, "snapshot_id").select(
        *correlate.SNAPSHOT, "entry_id", "repo", "listing_validated_commit", "upstream_observed_commit", "repository_layout", "verification_status"
    ).distinct()
    return correlate.registry_claims(_current(spark, directory), listed, ["machine_id"])


@query(f"""WITH {NEWEST} SELECT count(*) AS total, count_if(NOT b) AS community, count_if(b) AS built_in, count_if(NOT b AND u) AS unverified, count_if(NOT b AND d) AS drifted
FROM (SELECT coalesce(contains(repo, '/suite/'), FALSE) AS b, coalesce(verification_status = 'unverified', FALSE) AS u,
  coalesce(listing_validated_commit <> upstream_observed_commit, FALSE) AS d FROM listed)""")
def t_catalog_stats(spark, directory):
    return correlate.catalog_stats(
        _listed(spark, directory),
        F.coalesce(F.col("verification_status") == "unverified", F.lit(False)),
        F.coalesce(F.col("listing_validated_commit") != F.col("upstream_observed_commit"), F.lit(False)),
        F.coalesce(F.col("repo").contains("/suite/"), F.lit(False)),
    )


@query(f"""SELECT count(*) AS total, count_if(coalesce(len(kinds), 0) = 0) AS without_kind, count_if(epoch(installed_at) >= {NOW} - 2592000) AS recent, count_if(coalesce(enabled, FALSE)) AS enabled
FROM (SELECT DISTINCT ON (install_id) * FROM installed_plugins)""")
def t_recency_stats(spark, directory):
    rows = reader(spark, directory)("installed_plugins").select("install_id", "kinds", "installed_at", "enabled").dropDuplicates(["install_id"])
    recent = times.ntz_seconds(F.col("installed_at")) >= NOW - 2_592_000
    stats = correlate.package_stats(rows, F.coalesce(F.size("kinds"), F.lit(0)) <= 0, recent, F.col("enabled"))
    return stats.withColumnsRenamed({"unrated": "without_kind", "flagged": "enabled"})


@query("""SELECT machine_id, string_agg(DISTINCT plugin_id, ', ' ORDER BY plugin_id) AS active_bars, count(DISTINCT plugin_id) > 1 AS conflict, bool_or(NOT coalesce(first_party, FALSE)) AS replaced
FROM installed_plugins WHERE active AND removed_at IS NULL AND list_contains(kinds, 'bar') AND plugin_id IS NOT NULL GROUP BY machine_id""")
def t_active_bars(spark, directory):
    rows = reader(spark, directory)("installed_plugins").where("active AND removed_at IS NULL AND array_contains(kinds, 'bar') AND plugin_id IS NOT NULL")
    return rows.groupBy("machine_id").agg(
        F.array_join(F.array_sort(F.collect_set("plugin_id")), ", ").alias("active_bars"),
        (F.count_distinct("plugin_id") > 1).alias("conflict"),
        F.bool_or(~F.coalesce("first_party", F.lit(False))).alias("replaced"),
    )


@query("""WITH dirs AS (SELECT DISTINCT machine_id AS root, regexp_extract(path, '[^/]*$') AS name, plugin_id AS manifest_id FROM installed_plugins WHERE path IS NOT NULL AND plugin_id IS NOT NULL),
rows AS (SELECT machine_id AS root, plugin_id AS id, max(revision) AS ord FROM identities_local GROUP BY ALL),
one AS (SELECT d.*, CASE WHEN r.id IS NOT NULL AND row_number() OVER (PARTITION BY d.root, d.manifest_id ORDER BY name) = 1 THEN d.manifest_id END AS claimed
  FROM dirs d LEFT JOIN rows r ON d.root = r.root AND d.manifest_id = r.id),
free AS (SELECT root, id FROM rows ANTI JOIN (SELECT root, claimed AS id FROM one WHERE claimed IS NOT NULL) USING (root, id)),
two AS (SELECT o.root, name, manifest_id, coalesce(claimed, CASE WHEN row_number() OVER (PARTITION BY o.root, name, claimed IS NULL ORDER BY manifest_id) = 1 THEN f.id END) AS id
  FROM one o LEFT JOIN free f ON o.root = f.root AND o.name = f.id)
SELECT coalesce(t.root, r.root) AS root, name, manifest_id, coalesce(t.id, r.id) AS id, ord FROM two t FULL JOIN rows r ON t.root = r.root AND t.id = r.id""")
def t_listing_join(spark, directory):
    rows = reader(spark, directory)("identities_local").select(
        F.col("machine_id").alias("root"), F.col("plugin_id").alias("id"), F.col("revision").alias("ord")
    )
    return correlate.claim_listing_rows(_directories(spark, directory), rows)


def _directories(spark, directory) -> DataFrame:
    rows = reader(spark, directory)("installed_plugins").where("path IS NOT NULL AND plugin_id IS NOT NULL")
    return rows.select(
        F.col("machine_id").alias("root"), F.regexp_extract("path", r"[^/]*\z", 0).alias("name"), F.col("plugin_id").alias("manifest_id")
    )


@query("SELECT count_if(NOT b) AS installed, count_if(b) AS backups, count_if(u) AS unscannable FROM (SELECT coalesce(classification = 'backup', FALSE) AS b, coalesce(classification = 'unscannable', FALSE) AS u FROM installed_plugins)")
def t_inventory_counts(spark, directory):
    return inventory.counts(reader(spark, directory)("installed_plugins"))


@query("""WITH rows AS (SELECT machine_id AS root, plugin_id AS id, max(seq) AS ord FROM trust_records WHERE plugin_id IS NOT NULL GROUP BY ALL)
SELECT root, id, ord FROM rows ANTI JOIN (SELECT machine_id AS root, plugin_id AS id FROM installed_plugins WHERE path IS NOT NULL AND plugin_id IS NOT NULL) USING (root, id)
ANTI JOIN (SELECT DISTINCT machine_id AS root, regexp_extract(path, '[^/]*$') AS id FROM installed_plugins WHERE path IS NOT NULL AND plugin_id IS NOT NULL) USING (root, id)""")
def t_unclaimed(spark, directory):
    t = reader(spark, directory)
    rows = t("trust_records").where("plugin_id IS NOT NULL").select(F.col("machine_id").alias("root"), F.col("plugin_id").alias("id"), F.col("seq").alias("ord"))
    return inventory.unclaimed(correlate.claim_listing_rows(_directories(spark, directory), rows))


# ------------------------------------------------------------------ signals


MATERIAL = "json_array(plugin_id, {0}.repository, {0}.head, {0}.tree, {0}.content_digest, coalesce({0}.file_count, 0), {0}.limitations)::VARCHAR"
SIGNALS = f"""{MISSING}, {CURRENT},
signals AS (
  SELECT 1::BIGINT AS ord, plugin_id, 'partial' AS kind, 'warning' AS severity, 'partial:' || machine_id || ':' || plugin_id AS key FROM current WHERE len(limitations) > 0
  UNION ALL SELECT 2, plugin_id, 'drift', 'critical', 'drift:' || plugin_id || ':' || sha256({MATERIAL.format('b')} || {MATERIAL.format('c')}) FROM current c JOIN base b USING (machine_id, plugin_id) WHERE {DIFFERS}
  UNION ALL SELECT 3, plugin_id, 'missing', 'warning', 'missing:' || machine_id || ':' || plugin_id FROM missing),
state AS (SELECT DISTINCT key FROM signals JOIN (SELECT DISTINCT plugin_id FROM trust_histories, unnest(revoked_plugins) AS u(plugin_id)) USING (plugin_id) WHERE kind = 'drift'
  UNION ALL SELECT DISTINCT 'drift:' || plugin_id || ':gone' FROM trust_histories, unnest(revoked_plugins) AS u(plugin_id) WHERE plugin_id IS NOT NULL)"""


def _signals(spark, directory) -> DataFrame:
    current = _current(spark, directory)
    base = baseline.latest(_records(spark, directory), KEYS, ["seq"])

    def rows(df, order, kind, severity, key):
        return df.select(F.lit(order).cast("long").alias("ord"), "plugin_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), key.alias("key"))

    def own(kind):
        return F.concat_ws(":", F.lit(kind), F.col("machine_id").cast("string"), "plugin_id")

    drifts = baseline.drifted(current, base, KEYS)
    return signals.union_signals(
        rows(current.where("size(limitations) > 0"), 1, "partial", "warning", own("partial")),
        rows(drifts, 2, "drift", "critical", F.col("drift_key")),
        rows(_missing(spark, directory), 3, "missing", "warning", own("missing")),
    )


def _state(spark, directory) -> DataFrame:
    """Keys known from before: the drifts of revoked components, and for each an older one that is over."""
    revoked = reader(spark, directory)("trust_histories").select(F.explode("revoked_plugins").alias("plugin_id")).where("plugin_id IS NOT NULL").distinct()
    base = baseline.latest(_records(spark, directory), KEYS, ["seq"])
    drifts = baseline.drifted(_current(spark, directory), base, KEYS)
    live = drifts.join(revoked, "plugin_id", "left_semi").select(F.col("drift_key").alias("key")).distinct()
    over = revoked.select(F.concat(F.lit("drift:"), "plugin_id", F.lit(":gone")).alias("key"))
    return live.unionByName(over).withColumn("emitted_at", F.lit("earlier"))


@query(f"""WITH {RECORDS}, {CURRENT} SELECT machine_id, plugin_id, 'drift:' || plugin_id || ':' || sha256({MATERIAL.format('b')} || {MATERIAL.format('c')}) AS drift_key
FROM current c JOIN base b USING (machine_id, plugin_id) WHERE {DIFFERS}""")
def t_drift_signals(spark, directory):
    return baseline.drifted(_current(spark, directory), baseline.latest(_records(spark, directory), KEYS, ["seq"]), KEYS)


@query(f"WITH {SIGNALS} SELECT * FROM signals")
def t_signals(spark, directory):
    return _signals(spark, directory)


@query(f"WITH {SIGNALS} SELECT * FROM signals ANTI JOIN state USING (key)")
def t_new_signals(spark, directory):
    return signals.new_signals(_signals(spark, directory), _state(spark, directory))


@query(f"""WITH {SIGNALS} SELECT key, 'earlier' AS emitted_at FROM state SEMI JOIN signals USING (key)
UNION ALL SELECT DISTINCT key, 'now' FROM signals ANTI JOIN state USING (key)""")
def t_next_state(spark, directory):
    return signals.next_state(_signals(spark, directory), _state(spark, directory), "now")


@query(f"""WITH {SIGNALS} SELECT count(DISTINCT key) AS outstanding, count_if(key NOT IN (SELECT key FROM state)) AS new, count(*) = 0 AS quiet,
  CASE WHEN count_if(severity = 'critical') > 0 THEN 'critical' WHEN count_if(severity = 'warning') > 0 THEN 'warning' ELSE 'none' END AS highest_severity FROM signals""")
def t_signal_summary(spark, directory):
    return signals.summary(_signals(spark, directory), _state(spark, directory))
