"""The inventory of a folder of components, from its files to its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import identity, inventory
from kelpline.sources import trees


def component_inventory(spark: SparkSession, root: str, listing: str | None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, limitations) of the components below *root*, with what the runtime *listing* (JSON text) adds.

    Rows are those of ``inventory.inspect`` in order, with content_digest, file_count and file_digests of the scannable
    ones.  Limitations tell of an absent or malformed listing, and name listed components without a directory.
    With *target* only its directories are read below their manifest: these are few and their names go to the reader.
    """
    trees.register(spark)
    here = F.lit(root).alias("root")
    directories = spark.read.format("component_directories").option("root", root).load().select(here, "name", "is_link", "has_git", "manifest")
    listed, limitations = inventory.parse_listing(spark.createDataFrame([(root, listing)], "root string, text string"))
    files = spark.read.format("component_files").option("root", root)
    if target is not None:
        names = [r.name for r in inventory.inspect(directories, listed, target).select("name").collect()]
        files = files.option("target", "/".join(names))
    files = files.load()
    found = identity.limitations_of(files, ["component"]).withColumnRenamed("component", "name")
    rows = inventory.inspect(directories.join(found, "name", "left"), listed, target)
    content = identity.content_identity(files, ["component"]).select(F.col("component").alias("name"), "content_digest", "file_count", "file_digests")
    scanned = ~F.col("classification").isin("unscannable", "backup")
    empty = identity.sha256_hex(F.lit(b""))
    whole = rows.join(content, "name", "left").select(
        *rows.columns,
        F.when(scanned, F.coalesce("content_digest", empty)).alias("content_digest"),
        F.when(scanned, F.coalesce("file_count", F.lit(0).cast("long"))).alias("file_count"),
        F.when(scanned, F.coalesce("file_digests", F.create_map().cast("map<string,string>"))).alias("file_digests"),
    )
    without = listed.where("coalesce(cloned_from, 'x') <> '' AND NOT coalesce(first_party, FALSE)").join(
        inventory.claimed_rows(directories, listed), ["root", "id"], "left_anti"
    )
    missing = without.select("root", F.concat(F.lit("listed_without_directory:"), "id").alias("limitation")).distinct()
    return inventory.in_order(whole), limitations.unionByName(missing)
