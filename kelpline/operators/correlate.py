"""Matching local components with a registry's listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import known_layout, normalize_repository


#: Columns of the snapshot an entry was listed in that a whole claim has.
SNAPSHOT = ("registry_repository", "registry_commit", "retrieved_at", "generation_time")
CLAIM = (
    *SNAPSHOT,
    *("repository", "verification_status", "listing_validated_commit", "upstream_observed_commit"),
    *("upstream_moved", "installed_matches_listing", "repository_layout"),
)


def correlate(installed: DataFrame, catalog: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Each installed row (any columns, with plugin_id, repository, head) with status and claim.

    A listing matches by id and normalized repository, null matching null.  Exactly one
    match gives a claim; no listing of that id 'unlisted'; an id without matching
    repository, or several matches, 'conflict' (nothing is chosen).  With a claim:
    'incomplete' if the layout is unknown, 'installed-differs'
    if the installed head is another commit than the validated one, else 'listed'.
    Comparisons with a null side are null.  Listings are counted per (id, repository)
    before the join, so listings of one hot id do not multiply rows.  The *carried* columns of
    the catalog come along with a claim.
    """
    listing = catalog.select(
        F.col("entry_id").alias("listed_id"),
        normalize_repository(F.col("repo")).alias("listed_repo"),
        "listing_validated_commit",
        "upstream_observed_commit",
        "repository_layout",
        "verification_status",
        *[F.col(c).alias(f"{c}_carried") for c in carried],
    ).where("listed_id IS NOT NULL")
    held = ("listing_validated_commit", "upstream_observed_commit", "repository_layout", "verification_status", *[f"{c}_carried" for c in carried])
    claim = F.struct(*held)
    matches = listing.groupBy("listed_id", "listed_repo").agg(F.count(F.lit(1)).alias("n_match"), F.min(claim).alias("claim"))
    ids = matches.groupBy("listed_id").agg(F.sum("n_match").alias("n_id"))
    mine = installed.withColumn("own_repo", normalize_repository(F.col("repository")))
    joined = mine.join(ids, mine.plugin_id == ids.listed_id, "left").drop("listed_id")
    both = joined.join(
        matches, (joined.plugin_id == matches.listed_id) & joined.own_repo.eqNullSafe(matches.listed_repo), "left"
    )
    one = F.col("n_match") == 1
    validated = F.col("claim.listing_validated_commit")
    status = (
        F.when(F.col("n_id").isNull(), "unlisted")
        .when(~F.coalesce(one, F.lit(False)), "conflict")
        .when(~known_layout(F.col("claim.repository_layout")), "incomplete")
        .when(F.col("head") != validated, "installed-differs")
        .otherwise("listed")
    )
    return both.select(
        *installed.columns,
        status.alias("status"),
        F.when(one, F.col("head") == validated).alias("installed_matches_listing"),
        F.when(one, F.col("claim.upstream_observed_commit") != validated).alias("upstream_moved"),
        F.when(one, F.col("claim.verification_status")).alias("verification_status"),
        *[F.when(one, F.col(f"claim.{c}_carried")).alias(c) for c in carried],
    )


def registry_claims(installed: DataFrame, catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """*keys*, plugin_id, status and the whole CLAIM of each installed row (see ``correlate``); all of the
    claim is null without one.  *catalog* also has SNAPSHOT columns."""
    whole = catalog.select(
        "*", F.col("repo").alias("claimed_repository"), F.col("listing_validated_commit").alias("validated"),
        F.col("upstream_observed_commit").alias("observed"), F.col("repository_layout").alias("layout"),
    )
    told = correlate(installed.select(*keys, "plugin_id", "repository", "head"), whole, (*SNAPSHOT, "claimed_repository", "validated", "observed", "layout"))
    named = {"repository": "claimed_repository", "listing_validated_commit": "validated", "upstream_observed_commit": "observed", "repository_layout": "layout"}
    return told.select(*keys, "plugin_id", "status", *[F.col(named.get(c, c)).alias(c) for c in CLAIM])


def catalog_stats(catalog: DataFrame, unverified: Column, drifted: Column, builtin: Column) -> DataFrame:
    """One row of conditional counts over all listings."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return catalog.agg(
        F.count(F.lit(1)).alias("total"),
        n(~builtin).alias("community"),
        n(builtin).alias("built_in"),
        n(~builtin & unverified).alias("unverified"),
        n(~builtin & drifted).alias("drifted"),
    )


def package_stats(packages: DataFrame, unrated: Column, recent: Column, flagged: Column) -> DataFrame:
    """One row: total, unrated, recent, flagged of a package index; a null condition does not count."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return packages.agg(F.count(F.lit(1)).alias("total"), n(unrated).alias("unrated"), n(recent).alias("recent"), n(flagged).alias("flagged"))


def claim_listing_rows(directories: DataFrame, listing: DataFrame) -> DataFrame:
    """Directories (root, name, manifest_id) ⟗ runtime listing (root, id, ord).

    A listing id given twice: the last (highest ord) counts.  A directory claims the
    row of its manifest id, the first by name if several do; one that cannot claims the
    row of its own name if no other did.  Every listing row is claimed at most once.
    Directories without a row keep null, unclaimed rows have a null name.
    """
    rows = listing.groupBy("root", "id").agg(F.max("ord").alias("ord"))
    dirs = directories.select("root", "name", "manifest_id").distinct()
    first = Window.partitionBy("root", "manifest_id").orderBy("name")
    by_manifest = (
        dirs.join(rows.select("root", F.col("id").alias("manifest_id"), F.lit(True).alias("offered")), ["root", "manifest_id"], "left")
        .withColumn("nth", F.row_number().over(first))
        .select("root", "name", "manifest_id", F.when(F.col("offered") & (F.col("nth") == 1), F.col("manifest_id")).alias("claimed"))
    )
    taken = by_manifest.where("claimed IS NOT NULL").select("root", F.col("claimed").alias("id"))
    free = rows.join(taken, ["root", "id"], "left_anti").select("root", F.col("id").alias("name"), F.col("id").alias("by_name"))
    # Of rows of one directory name (several manifests), the first takes the free row.
    nth = Window.partitionBy("root", "name", F.col("claimed").isNull()).orderBy("manifest_id")
    claims = (
        by_manifest.join(free, ["root", "name"], "left")
        .withColumn("nth", F.row_number().over(nth))
        .select("root", "name", "manifest_id", F.coalesce("claimed", F.when(F.col("nth") == 1, F.col("by_name"))).alias("id"))
    )
    joined = claims.where("id IS NOT NULL").join(rows, ["root", "id"], "full")
    return joined.select("root", "name", "manifest_id", "id", "ord").unionByName(
        claims.where("id IS NULL").select("root", "name", "manifest_id", "id", F.lit(None).cast("long").alias("ord"))
    )
