"""Inventory rows: manifests, runtime listings and the shape of each component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import is_backup
from kelpline.operators.correlate import claim_listing_rows
from kelpline.operators.structural import as_list, symbol


def manifest(text: Column) -> Column:
    """(valid, id, kinds) of a manifest's JSON text; valid with schemaVersion 1 and an id."""
    root = F.try_parse_json(text)
    version = F.try_variant_get(root, "$.schemaVersion", "bigint")
    name = F.try_variant_get(root, "$.id", "string")
    kinds = F.coalesce(F.try_variant_get(root, "$.kinds", "array<string>"), F.array().cast("array<string>"))
    return F.struct(F.coalesce((version == 1) & name.isNotNull(), F.lit(False)).alias("valid"), name.alias("id"), kinds.alias("kinds"))


def parse_listing(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, limitations) of runtime listings (root, text).

    Rows: root, id, ord (place), enabled, active, first_party, cloned_from, kinds; elements
    without an id give none.  An absent listing, and one that is no JSON array, give a
    limitation and no rows.
    """
    parsed = listings.select("root", "text", F.try_parse_json("text").alias("v"))
    parsed = parsed.select("root", "text", "v", symbol(F.col("v")).alias("sym"))
    get = lambda k, t: F.try_variant_get("e", f"$.{k}", t)
    rows = (
        parsed.where("sym = 'array'")
        .select("root", F.posexplode(as_list(F.col("v"))).alias("ord", "e"))
        .select(
            "root",
            get("id", "string").alias("id"),
            F.col("ord").cast("long").alias("ord"),
            get("enabled", "boolean").alias("enabled"),
            get("active", "boolean").alias("active"),
            get("firstParty", "boolean").alias("first_party"),
            get("clonedFrom", "string").alias("cloned_from"),
            F.coalesce(get("kinds", "array<string>"), F.array().cast("array<string>")).alias("kinds"),
        )
        .where("id IS NOT NULL")
    )
    code = F.when(F.col("text").isNull(), "listing_absent").when(F.col("sym") != "array", "listing_malformed")
    return rows, parsed.select("root", code.alias("limitation")).where("limitation IS NOT NULL")


def inspect(directories: DataFrame, listing: DataFrame, target: str | None = None) -> DataFrame:
    """One row per directory (root, name, is_link, manifest text, and if known has_git and the
    limitations of its content) with what the listing adds.

    classification, first test that holds: a link ('unscannable'), a backup by name, a
    manifest that is missing, broken or invalid ('unscannable'), a repository ('Git-managed'), a first-party row or
    one cloned from nothing ('built-in'), else 'cloned/local'; ``reason`` says why one is unscannable.
    The id and kinds come from the manifest where it counts (kinds: unless it has none), else from the listing,
    else the id is the name.  An id other than the name is a limitation ('directory_id_mismatch').
    Backups claim no row; links are not followed and claim the row of their name.
    *target* keeps rows whose manifest id, name or claimed row is it.
    """
    given = lambda name, other: F.coalesce(name, other) if name in directories.columns else other
    none = F.array().cast("array<string>")
    link, backup = F.coalesce("is_link", F.lit(False)), is_backup(F.col("name"))
    read = directories.select(
        "root",
        "name",
        link.alias("is_link"),
        manifest(F.when(~link, F.col("manifest"))).alias("m"),
        F.col("manifest").isNull().alias("unavailable"),
        F.try_parse_json("manifest").isNull().alias("malformed"),
        given("has_git", F.lit(False)).alias("has_git"),
        given("limitations", none).alias("found"),
    )
    claims = claim_listing_rows(read.where(~backup).select("root", "name", F.col("m.id").alias("manifest_id")), listing.select("root", "id", "ord"))
    claimed = claims.where("name IS NOT NULL").select("root", "name", F.col("id").alias("row_id"), "ord")
    rows = listing.select("root", F.col("id").alias("row_id"), "ord", "enabled", "active", "first_party", "cloned_from", F.col("kinds").alias("row_kinds"))
    joined = read.join(claimed, ["root", "name"], "left").join(rows, ["root", "row_id", "ord"], "left")
    if target is not None:
        joined = joined.where((F.col("m.id") == target) | (F.col("name") == target) | (F.col("row_id") == target))
    built_in = F.coalesce("first_party", F.lit(False)) | F.col("cloned_from").eqNullSafe("")
    kind = (
        F.when(F.col("is_link"), "unscannable")
        .when(backup, "backup")
        .when(~F.col("m.valid"), "unscannable")
        .when(F.col("has_git"), "Git-managed")
        .when(built_in, "built-in")
        .otherwise("cloned/local")
    )
    reason = (
        F.when(F.col("is_link"), "link")
        .when(F.col("unavailable"), "manifest_unavailable")
        .when(F.col("malformed"), "manifest_malformed")
        .otherwise("manifest_invalid")
    )
    counts_here = ~F.col("classification").isin("unscannable", "backup")
    row_kinds = F.coalesce("row_kinds", none)
    told = joined.withColumn("classification", kind).select(
        "root",
        "name",
        F.when(counts_here, F.col("m.id")).otherwise(F.coalesce("row_id", "name")).alias("id"),
        "classification",
        F.when(F.col("classification") == "unscannable", reason).alias("reason"),
        F.nullif(F.col("cloned_from"), F.lit("")).alias("repository"),
        "enabled",
        "active",
        "first_party",
        F.when(counts_here & (F.size("m.kinds") > 0), F.col("m.kinds")).otherwise(row_kinds).alias("kinds"),
        "found",
    )
    mismatch = F.when((F.col("id") != F.col("name")) & (F.col("classification") != "unscannable"), F.array(F.lit("directory_id_mismatch"))).otherwise(none)
    return told.withColumn("limitations", F.array_sort(F.array_distinct(F.concat("found", mismatch)))).drop("found")


def claimed_rows(directories: DataFrame, listing: DataFrame) -> DataFrame:
    """(root, id) of the listing rows that a directory claims, as ``inspect`` does it."""
    read = directories.where(~is_backup(F.col("name"))).select(
        "root", "name", manifest(F.when(~F.coalesce("is_link", F.lit(False)), F.col("manifest")))["id"].alias("manifest_id")
    )
    return claim_listing_rows(read, listing.select("root", "id", "ord")).where("name IS NOT NULL AND id IS NOT NULL").select("root", "id")


def unclaimed(claims: DataFrame) -> DataFrame:
    """Listing rows that no directory claimed (result of claim_listing_rows)."""
    return claims.where("name IS NULL").select("root", "id", "ord")


def counts(rows: DataFrame) -> DataFrame:
    """One row: installed (all but backups), backups, unscannable."""
    is_kind = lambda k: F.count_if(F.coalesce(F.col("classification") == k, F.lit(False)))
    return rows.agg(
        (F.count(F.lit(1)) - is_kind("backup")).alias("installed"), is_kind("backup").alias("backups"), is_kind("unscannable").alias("unscannable")
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Inventory rows as they are shown: by id, then name (a sort of the whole result)."""
    return rows.orderBy("id", "name")


def report_rows(rows: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """*keys* and the JSON of each row; the fields of its claim are there, as ``marketplace_...``, only if they are known."""
    named = [F.col(c).alias(f"marketplace_{c}") for c in claims.columns if c not in keys]
    joined = rows.join(claims.select(*keys, *named), keys, "left")
    return joined.select(*keys, F.to_json(F.struct(*[c for c in joined.columns])).alias("json"))
