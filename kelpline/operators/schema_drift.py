"""Schemas that drift between files (problem 5).

Rescue-column ingestion.  Every entry of every file is forced into one target
schema; a field that is unknown, or whose JSON type does not fit its column, is
kept in the ``_rescued`` column as JSON.  ``promote`` replays rescued values of
approved fields into typed columns.  Changes between files are read off the ingested and
promoted table: a file's fields and types are its non-null typed columns plus
its rescued keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.frames import pick
from kelpline.operators.storage import cut_lineage
from kelpline.operators.structural import as_list, symbol

FILE = ["registry_id", "file_seq"]
RESCUED = "_rescued"
#: Columns of the target schema; all are text.
TARGET = (
    "id",
    "repo",
    "verificationStatus",
    "listingValidatedCommit",
    "upstreamObservedCommit",
    "upstreamCheckStatus",
    "repositoryLayout",
    "kind",
)
#: Other names fields have had: the renames that ``schema_changes`` finds.
RENAMED = {
    "verificationStatus": ("verification_status", "verficationStatus", "verification"),
    "upstreamCheckStatus": (
        "upstream_check_status", "upstream.checkStatus", "upstreamCheck", "checkStatus", "upstreamcheckstatus", "UpstreamCheckStatus",
    ),
    "repositoryLayout": ("repository_layout", "repository layout", "repoLayout", "layout", "repositorylayout", "Layout"),
    "stars": ("starCount", "star_count"),
    "license": ("licence", "License", "spdx"),
}
#: A renamed field keeps its value in at least this share of the entries compared.
RENAME_SHARE = (9, 10)


def readable_files(files: DataFrame) -> DataFrame:
    """FILE, entries (ARRAY<VARIANT>): one readable delivery of each file_seq.

    Readable: an array, or an object with a list under ``entries`` or else, where
    that is absent or null, under ``plugins``.  Of several readable deliveries the
    earliest received counts (they are said to be alike; ties: lowest file_id).
    Rows with a null registry_id or file_seq belong to no sequence and are left out.
    """
    df = pick(files, "file_id", *FILE, "received_at", "content").where(
        "registry_id IS NOT NULL AND file_seq IS NOT NULL"
    )
    parsed = df.select("file_id", *FILE, "received_at", F.try_parse_json(F.col("content")).alias("root"))
    child = parsed.select(
        "*",
        F.try_variant_get("root", "$.entries", "variant").alias("entries"),
        F.try_variant_get("root", "$.plugins", "variant").alias("plugins"),
    )
    shaped = child.select(
        "*",
        symbol(F.col("root")).alias("root_sym"),
        symbol(F.col("entries")).alias("entries_sym"),
        symbol(F.col("plugins")).alias("plugins_sym"),
    )
    wrapped = F.when(F.col("entries_sym") == "array", F.col("entries")).when(
        F.col("entries_sym").isin("absent", "null") & (F.col("plugins_sym") == "array"), F.col("plugins")
    )
    listed = shaped.select(
        "file_id",
        *FILE,
        "received_at",
        F.when(F.col("root_sym") == "array", F.col("root")).when(F.col("root_sym") == "object", wrapped).alias("list"),
    )
    first = Window.partitionBy(*FILE).orderBy(
        F.col("list").isNotNull().desc(), F.col("received_at").asc_nulls_last(), F.col("file_id").asc_nulls_last()
    )
    one = listed.withColumn("nth", F.row_number().over(first)).where("nth = 1 AND list IS NOT NULL")
    return one.select(*FILE, "list")


def _routed(files: DataFrame, target: tuple[str, ...]) -> DataFrame:
    """FILE, pos, the target columns, rest (map of what did not fit).  Elements that are
    no objects have no row; a file without objects has one row without pos and values."""
    placed = F.transform(as_list(F.col("list")), lambda v, i: F.struct(i.alias("pos"), v.alias("entry")))
    entries = readable_files(files).select(
        *FILE, F.inline_outer(F.filter(placed, lambda e: symbol(e["entry"]) == "object"))
    )
    objects = entries.select(*FILE, "pos", F.try_variant_get("entry", "$", "map<string,variant>").alias("fields"))
    texts = objects.select(
        "*", *[F.element_at("fields", F.lit(t)).alias(f"{t}_v") for t in target]
    ).select(
        *FILE,
        "pos",
        "fields",
        *[F.when(symbol(F.col(f"{t}_v")) == "text", F.try_variant_get(f"{t}_v", "$", "string")).alias(t) for t in target],
    )
    fits = F.filter(
        F.array(*[F.when(F.col(t).isNotNull(), F.lit(t)) for t in target]), lambda n: n.isNotNull()
    )
    fitted = texts.select("*", fits.alias("fits"))
    rest = F.map_filter("fields", lambda k, v: ~F.array_contains("fits", k) & ~F.is_variant_null(v))
    return fitted.select(*FILE, F.col("pos").cast("long").alias("pos"), *target, rest.alias("rest"))


def ingest(files: DataFrame, target: tuple[str, ...] = TARGET, empty_files: bool = False) -> DataFrame:
    """FILE, pos, one text column per *target* field, ``_rescued`` (JSON object or null).

    A target field holds the value if it is a JSON string; a non-null value of
    another type is rescued, as is every non-null unknown field.  Field names are
    exact: one that differs in case is unknown.  List elements that are no objects
    give no rows.  With *empty_files* a file without objects has one row without pos and values.
    """
    routed = _routed(files, target)
    rows = routed if empty_files else routed.where("pos IS NOT NULL")
    return rows.select(*FILE, "pos", *target, F.when(F.size("rest") > 0, F.to_json("rest")).alias(RESCUED))


def promote(
    ingested: DataFrame, approved: Mapping[str, str], renamed: Mapping[str, tuple[str, ...]] | None = None, exact: bool = False
) -> DataFrame:
    """Replay rescued values of *approved* fields (name -> SQL type) into typed columns.

    A field's value is looked for in its own column (if *ingested* has one), then among
    the rescued values under its name, then under the names of *renamed* (name -> other
    names, in order); the first scalar that casts counts.  It leaves ``_rescued`` if the cast
    keeps its text; all else stays rescued, and what the cast changes (true as 1) too.  With
    *exact* a text counts for text columns only, a number for the others, and only if the cast
    keeps its text, so that a column tells the JSON type of what it holds.
    """
    as_map = F.try_variant_get(F.try_parse_json(F.col(RESCUED)), "$", "map<string,variant>")
    opened = ingested.withColumn("rescued_map", as_map)

    def chosen(n: str, t: str) -> Column:
        own = [F.when(F.col(n).isNotNull(), F.struct(F.lit(None).cast("string").alias("key"), F.col(n).alias("value")))] if n in ingested.columns else []
        names = (n, *(renamed or {}).get(n, ()))
        found = [(k, F.element_at("rescued_map", F.lit(k))) for k in names]
        if exact:
            fits = lambda v: (symbol(v) == ("text" if t == "string" else "number")) & (
                F.try_variant_get(v, "$", "string") == F.try_variant_get(v, "$", t).cast("string")
            )
        else:
            fits = lambda v: ~symbol(v).isin("array", "object")
        replayed = [(k, F.when(fits(v), F.try_variant_get(v, "$", t))) for k, v in found]
        return F.coalesce(*own, *[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in replayed])

    picked = opened.select("*", *[chosen(n, t).alias(f"{n}_from") for n, t in approved.items()])

    def stays(key: Column, value: Column) -> Column:
        gone = F.lit(False)
        for n in approved:
            same = F.try_variant_get(value, "$", "string").eqNullSafe(F.col(f"{n}_from.value").cast("string"))
            gone = gone | (key.eqNullSafe(F.col(f"{n}_from.key")) & same)
        return ~gone

    rest = F.map_filter("rescued_map", stays)
    columns = [*[c for c in ingested.columns if c != RESCUED], *[n for n in approved if n not in ingested.columns]]
    typed = [F.col(f"{n}_from.value").alias(n) if n in approved else F.col(n) for n in columns]
    return picked.select(*typed, F.when(F.size(rest) > 0, F.to_json(rest)).alias(RESCUED))


def rescued_fields(ingested: DataFrame) -> DataFrame:
    """FILE, pos, field_name, rescued (canonical JSON): the fields in ``_rescued``, one row each."""
    fields = F.try_variant_get(F.try_parse_json(RESCUED), "$", "map<string,variant>")
    rows = ingested.select(*FILE, "pos", F.explode(fields).alias("field_name", "value"))
    return rows.select(*FILE, "pos", "field_name", F.to_json("value").alias("rescued"))


#: JSON types, each a bit of the set of types that a field has in a file.
TYPES = ("string", "number", "boolean", "array", "object")


def observed_fields(table: DataFrame) -> DataFrame:
    """FILE, pos, id, fields: of each row of an ingested table its non-null fields, from typed columns
    and rescued values, as (field, bit of its JSON type, 64-bit digest of the canonical JSON text:
    object keys in order, numbers without trailing zeros).  Digests are only compared
    within one entry of a pair of files."""
    columns = {n: t for n, t in table.dtypes if n not in (*FILE, "pos", RESCUED)}

    def typed(name: str, kind: str) -> Column:
        text = F.to_json(F.array(name)) if kind == "string" else F.concat(F.lit("["), F.col(name).cast("string"), F.lit("]"))
        return F.when(F.col(name).isNotNull(), _observed(F.lit(name), "string" if kind == "string" else "number", text))

    own = F.filter(F.array(*[typed(n, t) for n, t in columns.items()]), lambda s: s.isNotNull())
    opened = table.select(*FILE, "pos", "id", own.alias("own"), F.try_variant_get(F.try_parse_json(RESCUED), "$", "map<string,variant>").alias("rest"))
    rescued = F.transform(
        F.transform(
            F.map_entries("rest"),
            lambda e: F.struct(e["key"].alias("field"), symbol(e["value"]).alias("type"), F.concat(F.lit("["), F.to_json(e["value"]), F.lit("]")).alias("json")),
        ),
        lambda e: _observed(e["field"], F.when(e["type"] == "text", "string").otherwise(e["type"]), e["json"]),
    )
    return opened.select(*FILE, "pos", "id", F.concat("own", F.coalesce(rescued, F.array().cast(OBSERVED))).alias("fields"))


OBSERVED = "array<struct<field:string,type:int,value:bigint>>"


def _observed(field: Column, kind: Column | str, value: Column) -> Column:
    bits = {t: 1 << i for i, t in enumerate(TYPES)}
    if isinstance(kind, str):
        bit = F.lit(bits[kind])
    else:
        bit = F.element_at(F.create_map(*[F.lit(x) for pair in bits.items() for x in pair]), kind)
    return F.struct(field.alias("field"), bit.alias("type"), F.xxhash64(value).alias("value"))


#: Fields promoted out of ``_rescued`` before changes are read off.
PROMOTED = {"stars": "bigint", "license": "string"}
PAIR = ["registry_id", "pair"]


def schema_changes(files: DataFrame) -> DataFrame:
    """registry_id, file_seq, field_name, change_kind, old_field_name: each readable file
    against the registry's readable file before it (the first has no rows).

    'renamed': a field is gone and a new one has the same JSON value in at least nine
    tenths of the entries (by id, first listed; entries without an id do not take
    part) that are in both files and held the old one, of which there must be one.  Every
    such pair is a row, also if a field is in several.  Other gone or new fields: 'removed',
    'added'; 'retyped': the set of types differs.  Field names are exact.

    What the ingested table shows is written once (names, types and digests, no values), the changed
    fields of each pair of files too.
    """
    table = promote(ingest(files, empty_files=True), PROMOTED, exact=True)
    seen = cut_lineage(observed_fields(table))
    pairs = cut_lineage(changed_fields(seen))

    # What each file must show for its pairs, so that the entries are joined once and narrowed at once.
    names = lambda test: F.transform(F.filter("changes", test), lambda c: c["field"])
    gone, fresh = names(lambda c: c["new_types"].isNull()), names(lambda c: c["old_types"].isNull())
    asked = pairs.select(*PAIR, "prior", gone.alias("gone"), fresh.alias("fresh")).where("size(gone) > 0 AND size(fresh) > 0")
    wanted = asked.select(
        *PAIR,
        F.inline(
            F.array(
                F.struct(F.col("prior").alias("file_seq"), F.lit("old").alias("side"), F.col("gone").alias("wanted")),
                F.struct(F.col("pair").alias("file_seq"), F.lit("new").alias("side"), F.col("fresh").alias("wanted")),
            )
        ),
    )
    values = F.transform(
        F.filter("fields", lambda f: F.array_contains("wanted", f["field"])),
        lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value")),
    )
    entries = seen.where("id IS NOT NULL").join(wanted, FILE).select(*PAIR, "id", "side", "pos", values.alias("values"))
    first = lambda side: F.min(F.when(F.col("side") == side, F.struct("pos", "values")))
    both = entries.groupBy(*PAIR, "id").agg(first("old").alias("old"), first("new").alias("new")).where("old IS NOT NULL AND new IS NOT NULL")

    # One vote per entry for each new field that has the value of a gone one, and one without a name for the total.
    held = both.select(*PAIR, F.explode("old.values").alias("o"), F.col("new.values").alias("news"))
    equal = F.filter("news", lambda n: n["value"] == F.col("o.value"))
    votes = held.select(
        *PAIR,
        F.col("o.field").alias("gone"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.transform(equal, lambda n: n["field"]))).alias("fresh"),
    )
    counted = votes.groupBy(*PAIR, "gone", "fresh").agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy(*PAIR).agg(F.collect_list(F.struct("gone", "fresh", "n")).alias("votes"))

    def total(gone: Column) -> Column:
        return F.get(F.filter("votes", lambda v: v["fresh"].isNull() & (v["gone"] == gone)), F.lit(0))["n"]

    enough = lambda v: v["fresh"].isNotNull() & (v["n"] * RENAME_SHARE[1] >= total(v["gone"]) * RENAME_SHARE[0])
    renames = listed.select(*PAIR, F.filter("votes", enough).alias("renames")).where("size(renames) > 0")

    change = lambda name, kind, old: F.struct(name.alias("field_name"), kind.alias("change_kind"), old.alias("old_field_name"))
    renamed = F.transform("renames", lambda r: change(r["fresh"], F.lit("renamed"), r["gone"]))
    used = F.concat(F.transform("renames", lambda r: r["gone"]), F.transform("renames", lambda r: r["fresh"]))
    kind = lambda c: F.when(c["new_types"].isNull(), "removed").when(c["old_types"].isNull(), "added").otherwise("retyped")
    rest = F.filter("changes", lambda c: ~F.coalesce(F.array_contains("used", c["field"]), F.lit(False)))
    joined = pairs.join(renames, PAIR, "left").select(*PAIR, "changes", "renames", used.alias("used"))
    none = F.array().cast("array<struct<field_name:string,change_kind:string,old_field_name:string>>")
    rows = F.concat(F.coalesce(renamed, none), F.transform(rest, lambda c: change(c["field"], kind(c), F.lit(""))))
    return joined.select("registry_id", F.col("pair").alias("file_seq"), F.inline(rows))


def changed_fields(seen: DataFrame) -> DataFrame:
    """PAIR (pair: file_seq of the newer file), prior, changes: per readable file and the one before it
    the fields whose set of types differs, as (field, old_types, new_types), null where a file has none."""
    types = seen.select(*FILE, F.explode("fields").alias("f")).groupBy(*FILE, F.col("f.field").alias("field")).agg(F.bit_or("f.type").alias("types"))
    along = Window.partitionBy("registry_id").orderBy("file_seq")
    known = seen.select(*FILE).distinct().select(
        *FILE, F.lead("file_seq").over(along).alias("next_seq"), F.lag("file_seq").over(along).alias("prior_seq")
    )
    # A file is the new one of its pair and the old one of the next.
    side = lambda pair, prior, old, new: F.when(
        F.col(pair).isNotNull() & F.col(prior).isNotNull(),
        F.struct(F.col(pair).alias("pair"), F.col(prior).alias("prior"), old.alias("old_types"), new.alias("new_types")),
    )
    here, none = F.col("types"), F.lit(None).cast("int")
    roles = F.filter(F.array(side("file_seq", "prior_seq", none, here), side("next_seq", "file_seq", here, none)), lambda r: r.isNotNull())
    sided = types.join(known, FILE).select("registry_id", "field", F.inline(roles))
    compared = sided.repartition(*PAIR).groupBy(*PAIR, "prior", "field").agg(F.max("old_types").alias("old_types"), F.max("new_types").alias("new_types"))
    changed = compared.where("NOT old_types <=> new_types")
    return changed.groupBy(*PAIR, "prior").agg(F.collect_list(F.struct("field", "old_types", "new_types")).alias("changes"))
