"""SQL oracles of the general problems, in DuckDB's dialect."""

from __future__ import annotations


def seconds(column: str) -> str:
    """Epoch seconds of a time kept as text, NULL if unreadable."""
    return f"""CASE
      WHEN regexp_full_match({column}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?(Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)?')
      THEN epoch(try_strptime(replace(left({column}, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S'))::BIGINT
        - CASE WHEN regexp_extract({column}, '([+-])([0-9]{{2}}):?([0-9]{{2}})?$', 1) = '' OR length({column}) < 20 THEN 0
          ELSE (CASE regexp_extract(substr({column}, 20), '([+-])([0-9]{{2}}):?([0-9]{{2}})?$', 1) WHEN '-' THEN -1 ELSE 1 END)
            * (coalesce(try_cast(regexp_extract(substr({column}, 20), '([+-])([0-9]{{2}}):?([0-9]{{2}})?$', 2) AS BIGINT), 0) * 3600
             + coalesce(try_cast(regexp_extract(substr({column}, 20), '([+-])([0-9]{{2}}):?([0-9]{{2}})?$', 3) AS BIGINT), 0) * 60) END
      WHEN regexp_full_match({column}, '-?[0-9]{{1,18}}') THEN try_cast({column} AS BIGINT) END"""


def latest(table: str, key: str, order: str = "ingested_at") -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) = 1)"


P1_PLUGINS = """
WITH parsed AS (
  SELECT report_id, received_at, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM inventory_reports),
unwrapped AS (
  SELECT report_id, received_at,
    CASE WHEN json_type(j) <> 'OBJECT' THEN NULL
         WHEN NOT json_exists(j, '$.result') THEN j
         WHEN json_type(j, '$.result') = 'OBJECT' THEN json_extract(j, '$.result')
         WHEN json_type(j, '$.result') = 'VARCHAR' AND json_valid(j ->> '$.result') THEN (j ->> '$.result')::JSON END AS r
  FROM parsed),
last AS (SELECT report_id, arg_max(r, received_at) AS r FROM unwrapped WHERE json_type(r) = 'OBJECT' GROUP BY report_id),
listed AS (
  SELECT report_id, CASE json_type(r, '$.plugins') WHEN 'ARRAY' THEN json_extract(r, '$.plugins[*]')
    WHEN 'OBJECT' THEN [json_extract(r, '$.plugins')] ELSE [] END AS l FROM last),
plugins AS (
  SELECT report_id, i - 1 AS plugin_pos, l[i] AS p
  FROM (SELECT report_id, l, unnest(range(1, len(l) + 1)) AS i FROM listed) WHERE json_type(l[i]) = 'OBJECT')"""

P1_FOUND = P1_PLUGINS + """,
files AS (
  SELECT report_id, plugin_pos, unnest(json_keys(p, '$.file_digests')) AS k FROM plugins WHERE json_type(p, '$.file_digests') = 'OBJECT'
  UNION ALL
  SELECT report_id, plugin_pos, unnest(json_extract(p, '$.file_digests[*]')) ->> '$.path' FROM plugins WHERE json_type(p, '$.file_digests') = 'ARRAY'),
limits AS (
  SELECT report_id, plugin_pos, p ->> '$.limitations' AS k FROM plugins WHERE json_type(p, '$.limitations') = 'VARCHAR'
  UNION ALL
  SELECT report_id, plugin_pos, CASE json_type(v) WHEN 'OBJECT' THEN v ->> '$.code' WHEN 'VARCHAR' THEN v ->> '$' END
  FROM (SELECT report_id, plugin_pos, unnest(json_extract(p, '$.limitations[*]')) AS v FROM plugins WHERE json_type(p, '$.limitations') = 'ARRAY'))
SELECT report_id, plugin_pos, 'plugin' AS child_kind, coalesce(p ->> '$.id', '') AS child_key FROM plugins
UNION ALL SELECT DISTINCT report_id, plugin_pos, 'file_digest', k FROM files WHERE k IS NOT NULL
UNION ALL SELECT DISTINCT report_id, plugin_pos, 'limitation', k FROM limits WHERE k IS NOT NULL"""

P1_SHAPES = P1_PLUGINS + """,
shaped AS (SELECT
  CASE json_type(p, '$.file_digests') WHEN 'OBJECT' THEN 'path_map' WHEN 'ARRAY' THEN 'path_list' WHEN 'NULL' THEN 'none' ELSE
    CASE WHEN json_exists(p, '$.file_digests') THEN 'other' ELSE 'none' END END AS files_shape,
  CASE json_type(p, '$.limitations') WHEN 'OBJECT' THEN 'single_code' WHEN 'VARCHAR' THEN 'single_text' WHEN 'ARRAY' THEN 'code_list' WHEN 'NULL' THEN 'none' ELSE
    CASE WHEN json_exists(p, '$.limitations') THEN 'other' ELSE 'none' END END AS limits_shape
  FROM plugins)
SELECT CASE WHEN files_shape LIKE 'path%' AND limits_shape NOT IN ('none', 'other') THEN 'complete'
            WHEN files_shape LIKE 'path%' THEN 'files_only'
            WHEN limits_shape NOT IN ('none', 'other') THEN 'limits_only' ELSE 'bare' END AS plugin_shape,
  files_shape, limits_shape, count(*) AS n
FROM shaped GROUP BY ALL"""

P2_FOUND = f"""
WITH seen AS (
  SELECT 'baseline' AS entity, machine_id, plugin_id, '' AS scope, {seconds('accepted_at')} AS moment, seq,
    to_json(struct_pack(p := accepted.plugin_id, r := accepted.repository, h := accepted.head, t := accepted.tree,
      c := accepted.content_digest, n := accepted.file_count, l := accepted.limitations))::VARCHAR AS v
  FROM {latest('trust_records', 'record_id')}
  UNION ALL
  SELECT 'review', machine_id, plugin_id, scope, {seconds('created_at')}, seq, action FROM {latest('review_decisions', 'decision_id')}),
held AS (
  SELECT entity, machine_id, plugin_id, scope, moment, arg_max(coalesce(v, '(null)'), seq) AS v FROM seen
  WHERE plugin_id IS NOT NULL AND moment IS NOT NULL GROUP BY ALL),
turned AS (
  SELECT *, lag(v) OVER (PARTITION BY entity, machine_id, plugin_id, scope ORDER BY moment) AS before FROM held)
SELECT entity, machine_id, plugin_id, scope, moment AS valid_from,
  coalesce(lead(moment) OVER (PARTITION BY entity, machine_id, plugin_id, scope ORDER BY moment), -1) AS valid_to
FROM turned WHERE v IS DISTINCT FROM before"""


def _side(table: str) -> str:
    return f"""(SELECT machine_id, plugin_id, repository, lower(head) AS head, lower(tree) AS tree, lower(content_digest) AS content_digest,
      file_count, coalesce(limitations, []) AS limitations, file_digests FROM {latest(table, 'machine_id, plugin_id', 'revision')})"""


def _paths(side: str) -> str:
    return f"""(SELECT machine_id, plugin_id, e.key AS path, lower(e.value) AS digest, TRUE AS here
      FROM (SELECT machine_id, plugin_id, unnest(map_entries(file_digests)) AS e FROM {side})
      SEMI JOIN (SELECT machine_id, plugin_id FROM a JOIN b USING (machine_id, plugin_id)) USING (machine_id, plugin_id))"""


P3_FOUND = f"""
WITH a AS {_side('identities_local')}, b AS {_side('identities_mirror')}
SELECT machine_id, plugin_id, 'only_local' AS field_name, '' AS file_path FROM a ANTI JOIN b USING (machine_id, plugin_id)
UNION ALL SELECT machine_id, plugin_id, 'only_mirror', '' FROM b ANTI JOIN a USING (machine_id, plugin_id)
""" + "".join(
    f"UNION ALL SELECT a.machine_id, a.plugin_id, '{f}', '' FROM a JOIN b USING (machine_id, plugin_id) WHERE a.{f} IS DISTINCT FROM b.{f}\n"
    for f in ("repository", "head", "tree", "content_digest", "file_count", "limitations")
) + f"""UNION ALL SELECT machine_id, plugin_id, 'file_digests', path FROM {_paths('a')} x FULL JOIN {_paths('b')} y USING (machine_id, plugin_id, path)
WHERE x.digest IS DISTINCT FROM y.digest OR x.here IS DISTINCT FROM y.here"""

P4_REFS = f"""
WITH refs AS (
  SELECT * FROM (
    SELECT 'trust_records' AS ref_table, record_id AS ref_id, 0::BIGINT AS ref_pos, machine_id, plugin_id, {seconds('accepted_at')} AS moment
    FROM {latest('trust_records', 'record_id')}
    UNION ALL
    SELECT 'review_decisions', decision_id, 0, machine_id, plugin_id, {seconds('created_at')} FROM {latest('review_decisions', 'decision_id')}
    UNION ALL
    SELECT 'trust_histories', history_id, i - 1, machine_id, revoked_plugins[i], moment
    FROM (SELECT history_id, machine_id, revoked_plugins, {seconds('saved_at')} AS moment, unnest(range(1, len(revoked_plugins) + 1)) AS i
          FROM {latest('trust_histories', 'history_id')}))
  WHERE plugin_id IS NOT NULL AND moment IS NOT NULL),
judged AS (
  SELECT ref_table, ref_id, ref_pos, r.machine_id, r.plugin_id, moment, count(i.install_id) AS n, min(epoch(installed_at)) AS first,
    coalesce(bool_or(epoch(installed_at) <= moment AND (removed_at IS NULL OR moment < epoch(removed_at))), FALSE) AS there
  FROM refs r LEFT JOIN installed_plugins i ON r.machine_id = i.machine_id AND r.plugin_id = i.plugin_id
  GROUP BY ALL),
direct AS (
  SELECT ref_table, ref_id, ref_pos, machine_id, plugin_id, moment,
    CASE WHEN n = 0 THEN 'missing' WHEN first > moment THEN 'late' ELSE 'deleted' END AS orphan_reason
  FROM judged WHERE NOT there)"""

P4_FOUND = P4_REFS + """
SELECT ref_table, ref_id, ref_pos, orphan_reason, strftime(make_timestamp(moment * 1000000), '%Y-%m') AS ref_month FROM direct"""

# The graph of CASCADE has two edges in a row, so its fixpoint is reached after two rounds.
P4_CASCADE = P4_REFS + """,
one AS (
  SELECT r.* FROM refs r ANTI JOIN direct d USING (ref_table, ref_id, ref_pos)
  WHERE (r.ref_table = 'review_decisions' AND (machine_id, plugin_id) IN (SELECT (machine_id, plugin_id) FROM direct WHERE ref_table = 'trust_records'))
     OR (r.ref_table = 'trust_histories' AND (machine_id, plugin_id) IN (SELECT (machine_id, plugin_id) FROM direct WHERE ref_table = 'review_decisions'))),
two AS (
  SELECT r.* FROM refs r ANTI JOIN direct d USING (ref_table, ref_id, ref_pos) ANTI JOIN one USING (ref_table, ref_id, ref_pos)
  WHERE r.ref_table = 'trust_histories' AND (machine_id, plugin_id) IN (SELECT (machine_id, plugin_id) FROM one WHERE ref_table = 'review_decisions'))
SELECT ref_table, orphan_reason, strftime(make_timestamp(moment * 1000000), '%Y-%m') AS ref_month, depth, count(*) AS n FROM (
  SELECT ref_table, orphan_reason, moment, 0::BIGINT AS depth FROM direct
  UNION ALL SELECT ref_table, 'inherited', moment, 1 FROM one UNION ALL SELECT ref_table, 'inherited', moment, 2 FROM two)
GROUP BY ALL"""

P5_ENTRIES = """
WITH parsed AS (
  SELECT file_id, registry_id, file_seq, CASE WHEN json_valid(content) THEN content::JSON END AS j FROM catalog_files),
lists AS (
  SELECT file_id, registry_id, file_seq,
    CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
         WHEN json_type(j) <> 'OBJECT' THEN NULL
         WHEN json_type(j, '$.entries') = 'ARRAY' THEN json_extract(j, '$.entries[*]')
         WHEN coalesce(json_type(j, '$.entries'), 'NULL') = 'NULL' AND json_type(j, '$.plugins') = 'ARRAY' THEN json_extract(j, '$.plugins[*]') END AS l
  FROM parsed),
files AS (
  SELECT registry_id, file_seq, arg_min(l, file_id) AS l FROM lists WHERE l IS NOT NULL GROUP BY ALL),
ordered AS (
  SELECT registry_id, file_seq, lag(file_seq) OVER (PARTITION BY registry_id ORDER BY file_seq) AS prior FROM files),
entries AS (
  SELECT registry_id, file_seq, i - 1 AS pos, l[i] AS e
  FROM (SELECT registry_id, file_seq, l, unnest(range(1, len(l) + 1)) AS i FROM files) WHERE json_type(l[i]) = 'OBJECT')"""

P5_FOUND = P5_ENTRIES + """,
keyed AS (SELECT registry_id, file_seq, pos, e ->> '$.id' AS id, e, unnest(json_keys(e)) AS k FROM entries),
valued AS (SELECT registry_id, file_seq, pos, id, k, json_extract(e, '$."' || k || '"') AS v FROM keyed),
typed AS (
  SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS t,
    CASE json_type(v) WHEN 'OBJECT' THEN list_sort(list_transform(json_keys(v), lambda x: x || '=' || json_extract(v, '$."' || x || '"')::VARCHAR))::VARCHAR ELSE v::VARCHAR END AS c
  FROM valued WHERE json_type(v) <> 'NULL'),
types AS (SELECT registry_id, file_seq, k, list_sort(list(DISTINCT t)) AS ts FROM typed GROUP BY ALL),
pairs AS (SELECT registry_id, file_seq, prior FROM ordered WHERE prior IS NOT NULL),
news AS (SELECT p.registry_id, p.file_seq, t.k, t.ts FROM pairs p JOIN types t ON t.registry_id = p.registry_id AND t.file_seq = p.file_seq),
olds AS (SELECT p.registry_id, p.file_seq, t.k, t.ts FROM pairs p JOIN types t ON t.registry_id = p.registry_id AND t.file_seq = p.prior),
changed AS (
  SELECT registry_id, file_seq, k, o.ts AS ots, n.ts AS nts FROM olds o FULL JOIN news n USING (registry_id, file_seq, k)
  WHERE o.ts IS DISTINCT FROM n.ts),
firsts AS (SELECT registry_id, file_seq, id, min(pos) AS pos FROM keyed WHERE id IS NOT NULL GROUP BY ALL),
held AS (
  SELECT c.registry_id, c.file_seq, c.k AS gone, t.id, t.c, b.pos AS new_pos
  FROM changed c JOIN pairs p USING (registry_id, file_seq)
  JOIN firsts a ON a.registry_id = c.registry_id AND a.file_seq = p.prior
  JOIN firsts b ON b.registry_id = c.registry_id AND b.file_seq = c.file_seq AND b.id = a.id
  JOIN typed t ON t.registry_id = c.registry_id AND t.file_seq = p.prior AND t.pos = a.pos AND t.k = c.k
  WHERE c.nts IS NULL),
totals AS (SELECT registry_id, file_seq, gone, count(*) AS total FROM held GROUP BY ALL),
votes AS (
  SELECT h.registry_id, h.file_seq, h.gone, t.k AS fresh, count(*) AS n
  FROM held h JOIN typed t ON t.registry_id = h.registry_id AND t.file_seq = h.file_seq AND t.pos = h.new_pos AND t.c = h.c
  JOIN changed c ON c.registry_id = h.registry_id AND c.file_seq = h.file_seq AND c.k = t.k AND c.ots IS NULL
  GROUP BY ALL),
best AS (
  SELECT registry_id, file_seq, gone, fresh, n, total FROM votes JOIN totals USING (registry_id, file_seq, gone) WHERE n * 10 >= total * 9
  QUALIFY row_number() OVER (PARTITION BY registry_id, file_seq, gone ORDER BY n / total DESC, n DESC, gone, fresh) = 1),
renames AS (
  SELECT registry_id, file_seq, gone, fresh FROM best
  QUALIFY row_number() OVER (PARTITION BY registry_id, file_seq, fresh ORDER BY n / total DESC, n DESC, gone, fresh) = 1)
SELECT registry_id, file_seq, fresh AS field_name, 'renamed' AS change_kind, gone AS old_field_name FROM renames
UNION ALL
SELECT registry_id, file_seq, k, CASE WHEN nts IS NULL THEN 'removed' WHEN ots IS NULL THEN 'added' ELSE 'retyped' END, ''
FROM changed
WHERE (registry_id, file_seq, k) NOT IN (SELECT (registry_id, file_seq, gone) FROM renames)
  AND (registry_id, file_seq, k) NOT IN (SELECT (registry_id, file_seq, fresh) FROM renames)"""

# Every non-null field of every entry, and where it goes: its column if it is a string of the target schema, else rescued.
P5_FIELDS = P5_ENTRIES + """,
fields AS (
  SELECT registry_id, file_seq, pos, k, json_type(e, '$."' || k || '"') AS t, json_extract(e, '$."' || k || '"') AS v, e ->> ('$."' || k || '"') AS s
  FROM (SELECT registry_id, file_seq, pos, e, unnest(list_distinct(json_keys(e))) AS k FROM entries)),
placed AS (
  SELECT *, t = 'VARCHAR' AND k IN ('id', 'repo', 'verificationStatus', 'listingValidatedCommit', 'upstreamObservedCommit', 'upstreamCheckStatus', 'repositoryLayout', 'kind') AS own
  FROM fields WHERE t <> 'NULL')"""

# JSON of a value with the keys of an object in order and numbers without trailing zeros, down to the elements of an object or list.
_PLAIN = "CASE json_type({0}) WHEN 'DOUBLE' THEN rtrim(rtrim({0}::VARCHAR, '0'), '.') ELSE {0}::VARCHAR END"
_MEMBERS = "list_transform(list_sort(json_keys({0})), lambda x: to_json(x)::VARCHAR || ':' || " + _PLAIN.format("json_extract({0}, '$.\"' || x || '\"')") + ")"
_ORDERED = "CASE json_type({0}) WHEN 'OBJECT' THEN '{{' || array_to_string(" + _MEMBERS + ", ',') || '}}' WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract({0}, '$[*]'), lambda x: " + _PLAIN.format("x") + "), ',') || ']' ELSE " + _PLAIN + " END"

P5_RESCUED = P5_FIELDS + f"""
SELECT registry_id, file_seq, pos, k AS field_name, {_ORDERED.format('v')} AS rescued FROM placed WHERE NOT own"""

#: Columns of the one table: type, and the other names that are replayed into them (as approved).
P5_COLUMNS = {
    **{c: ("VARCHAR", ()) for c in ("id", "repo", "listingValidatedCommit", "upstreamObservedCommit", "kind")},
    "verificationStatus": ("VARCHAR", ("verification_status", "verficationStatus", "verification")),
    "upstreamCheckStatus": ("VARCHAR", ("upstream_check_status", "upstream.checkStatus", "upstreamCheck", "checkStatus", "upstreamcheckstatus", "UpstreamCheckStatus")),
    "repositoryLayout": ("VARCHAR", ("repository_layout", "repository layout", "repoLayout", "layout", "repositorylayout", "Layout")),
    "stars": ("BIGINT", ("starCount", "star_count")),
    "license": ("VARCHAR", ("licence", "License", "spdx")),
}
_NAMES = ", ".join(f"('{c}', '{n}', {k}, {t == 'BIGINT'})" for c, (t, others) in P5_COLUMNS.items() for k, n in enumerate((c, *others)))

P5_TABLE = P5_FIELDS + f""",
names(c, k, nth, whole) AS (VALUES {_NAMES}),
cast_to AS (
  SELECT p.*, c, nth, CASE WHEN NOT whole THEN s WHEN t = 'BOOLEAN' THEN CASE s WHEN 'true' THEN '1' ELSE '0' END
    WHEN t = 'VARCHAR' AND NOT regexp_full_match(trim(s), '[+-]?[0-9]+') THEN NULL ELSE try_cast(s AS BIGINT)::VARCHAR END AS x
  FROM placed p JOIN names USING (k) WHERE t NOT IN ('ARRAY', 'OBJECT')),
chosen AS (SELECT * FROM cast_to WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY registry_id, file_seq, pos, c ORDER BY NOT own, nth) = 1),
gone AS (SELECT DISTINCT registry_id, file_seq, pos, k FROM chosen WHERE own OR x = s UNION SELECT registry_id, file_seq, pos, k FROM placed WHERE own),
kept AS (
  SELECT registry_id, file_seq, pos, '{{' || string_agg(to_json(k)::VARCHAR || ':' || {_ORDERED.format('v')}, ',' ORDER BY k) || '}}' AS _rescued
  FROM placed ANTI JOIN gone USING (registry_id, file_seq, pos, k) GROUP BY ALL),
wide AS (SELECT registry_id, file_seq, pos, """ + ", ".join(f"max(x) FILTER (c = '{c}')::{t} AS \"{c}\"" for c, (t, _) in P5_COLUMNS.items()) + """ FROM chosen GROUP BY ALL)
SELECT registry_id, file_seq, pos, """ + ", ".join(f'"{c}"' for c in P5_COLUMNS) + """, _rescued
FROM (SELECT registry_id, file_seq, pos FROM entries) LEFT JOIN wide USING (registry_id, file_seq, pos) LEFT JOIN kept USING (registry_id, file_seq, pos)"""

P6_FOUND = """
WITH snaps AS (SELECT snapshot_id, any_value(registry_id) AS registry_id, max(retrieved_at) AS moment FROM catalog_snapshots GROUP BY snapshot_id),
pairs AS (SELECT registry_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY registry_id ORDER BY moment, snapshot_id) AS prior FROM snaps),
leaves AS (
  SELECT extra, string_agg(fullkey || '=' || type || coalesce(atom::VARCHAR, ''), ',' ORDER BY fullkey) AS x
  FROM (SELECT DISTINCT extra FROM catalog_entries WHERE extra IS NOT NULL) d, json_tree(d.extra::JSON) GROUP BY extra),
rows AS (
  SELECT snapshot_id, entry_id, struct_pack(a := repo, b := verification_status, c := listing_validated_commit, d := upstream_observed_commit,
    e := upstream_check_status, f := repository_layout, g := kind, h := x) AS v
  FROM catalog_entries LEFT JOIN leaves USING (extra) WHERE entry_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, entry_id ORDER BY pos) = 1),
old AS (SELECT p.registry_id, p.snapshot_id, r.entry_id, r.v FROM pairs p JOIN rows r ON r.snapshot_id = p.prior),
new AS (SELECT p.registry_id, p.snapshot_id, r.entry_id, r.v FROM pairs p JOIN rows r ON r.snapshot_id = p.snapshot_id WHERE p.prior IS NOT NULL)
SELECT registry_id, snapshot_id, entry_id,
  CASE WHEN old.v IS NULL THEN 'added' WHEN new.v IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM old FULL JOIN new USING (registry_id, snapshot_id, entry_id) WHERE old.v IS DISTINCT FROM new.v"""

ORACLES = {
    "p1_found": P1_FOUND,
    "p1_shapes": P1_SHAPES,
    "p2_found": P2_FOUND,
    "p3_found": P3_FOUND,
    "p4_found": P4_FOUND,
    "p4_cascade": P4_CASCADE,
    "p5_found": P5_FOUND,
    "p5_rescued": P5_RESCUED,
    "p5_table": P5_TABLE,
    "p6_found": P6_FOUND,
}
