"""What changed between full snapshots (problem 6).

Entry keys are hashed into ranges, the leaves of one Merkle tree per snapshot.  A
leaf's digest is an order-independent fold of its rows' digests, an inner node's
digest that of its children's.  The trees of consecutive snapshots are compared top
down, each level only below nodes that differ; rows are compared only in leaves that
differ.  Values never travel: a row is 128 bits of digest besides its key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.frames import pick

VALUES = (
    "repo",
    "verification_status",
    "listing_validated_commit",
    "upstream_observed_commit",
    "upstream_check_status",
    "repository_layout",
    "kind",
)
#: Children of an inner node (a power of two) and the rows a leaf should hold.
FANOUT_BITS, LEAF_ROWS = 3, 8


def canonical_json(text: Column) -> Column:
    """JSON text with object keys in order, no white space and numbers without trailing
    zeros; a text that is no JSON stands for itself; null stays null."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull(), F.concat(F.lit("j"), F.to_json(parsed))).otherwise(F.concat(F.lit("t"), text))


def row_digest(values: list[Column]) -> list[Column]:
    """Two 64-bit digests; null differs from every text and equals null."""
    marked = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("")) for v in values]
    return [F.xxhash64(F.lit(seed), *marked).alias(name) for seed, name in ((17, "d1"), (4242, "d2"))]


def tree_depth(entries: DataFrame) -> int:
    """Levels below the root so that leaves of the largest snapshot hold about LEAF_ROWS rows."""
    largest = entries.groupBy("snapshot_id").count().agg(F.max("count")).first()[0] or 1
    return max(1, math.ceil(math.log2(max(2, largest / LEAF_ROWS)) / FANOUT_BITS))


def fold(digests: DataFrame, keys: list[str]) -> DataFrame:
    """Digest of each group of digests, whatever their order: sums and XORs of both halves."""
    wide = F.col("d1").cast("decimal(38,0)")
    low = (F.sum(wide) % F.lit(1 << 62)).cast("long")
    return digests.groupBy(*keys).agg(
        F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"), low.alias("s1"), F.count(F.lit(1)).alias("n")
    ).select(*keys, F.xxhash64("x1", "s1", "n").alias("d1"), F.xxhash64(F.lit(7), "x2", "s1", "n").alias("d2"))


def snapshot_changes(snapshots: DataFrame, entries: DataFrame, depth: int | None = None) -> DataFrame:
    """registry_id, snapshot_id (the later one), entry_id, change_kind.

    Snapshots of a registry go by retrieved_at (nulls first, ties by snapshot_id); of
    a snapshot delivered again the last ingested row counts.  Null snapshot, registry
    and entry ids are left out.  Of an id listed twice the lowest pos counts (a null
    pos last).  Ids and values compare as stored, null equals only null, ``extra``
    as a JSON value.  A snapshot without entries counts as empty.  Rows are held equal
    if 128 bits of digest are.
    """
    catalog = pick(snapshots, "snapshot_id", "registry_id", "retrieved_at", "ingested_at").where(
        "snapshot_id IS NOT NULL AND registry_id IS NOT NULL"
    )
    once = catalog.groupBy("snapshot_id").agg(
        F.max_by(F.struct("registry_id", "retrieved_at"), F.struct("ingested_at", "retrieved_at", "registry_id")).alias("s")
    )
    along = Window.partitionBy("registry_id").orderBy(F.col("retrieved_at").asc_nulls_first(), "snapshot_id")
    ordered = once.select("snapshot_id", "s.*").select(
        "registry_id", "snapshot_id", F.lag("snapshot_id").over(along).alias("prior"), F.lead("snapshot_id").over(along).alias("later")
    )
    # A snapshot is the new side of its own pair and the old side of the next.
    roles = ordered.select(
        "snapshot_id",
        F.inline(
            F.filter(
                F.array(
                    F.when(F.col("prior").isNotNull(), F.struct("registry_id", F.col("snapshot_id").alias("pair"), F.lit(1).alias("side"))),
                    F.when(F.col("later").isNotNull(), F.struct("registry_id", F.col("later").alias("pair"), F.lit(0).alias("side"))),
                ),
                lambda r: r.isNotNull(),
            )
        ),
    )
    table = pick(entries, "snapshot_id", "pos", "entry_id", *VALUES, "extra").where(
        "snapshot_id IS NOT NULL AND entry_id IS NOT NULL"
    )
    depth = depth or tree_depth(table)
    leaf = F.shiftrightunsigned(F.xxhash64("entry_id"), 64 - FANOUT_BITS * depth)
    digested = table.select(
        "snapshot_id",
        leaf.alias("leaf"),
        "entry_id",
        F.coalesce("pos", F.lit((1 << 63) - 1)).alias("pos"),
        *row_digest([*[F.col(v) for v in VALUES], canonical_json(F.col("extra"))]),
    )
    # One exchange by (snapshot, leaf) serves deduplication, leaf digests and the final row comparison.
    rows = (
        digested.repartition("snapshot_id", "leaf")
        .groupBy("snapshot_id", "leaf", "entry_id")
        .agg(F.min(F.struct("pos", "d1", "d2")).alias("v"))
        .select("snapshot_id", "leaf", "entry_id", "v.d1", "v.d2")
    )
    levels = [fold(rows.select("snapshot_id", F.col("leaf").alias("node"), _both("entry_id")[0], _both("entry_id")[1]), ["snapshot_id", "node"])]
    for _ in range(depth):
        up = levels[0].select("snapshot_id", F.shiftrightunsigned("node", FANOUT_BITS).alias("node"), *_both("node"))
        levels.insert(0, fold(up, ["snapshot_id", "node"]))

    frontier: DataFrame | None = None
    for level in levels:
        sided = level.join(roles, "snapshot_id")
        if frontier is not None:
            above = frontier.select("pair", F.col("node").alias("above"))
            sided = sided.withColumn("above", F.shiftrightunsigned("node", FANOUT_BITS)).join(above, ["pair", "above"], "left_semi")
        nodes = sided.groupBy("registry_id", "pair", "node").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2"),
        )
        frontier = nodes.where("n < 2 OR a1 <> b1 OR a2 <> b2").select("registry_id", "pair", "node")

    reading = frontier.join(roles.drop("registry_id"), "pair").select(
        "registry_id", "pair", "side", "snapshot_id", F.col("node").alias("leaf")
    )
    sides = rows.join(reading, ["snapshot_id", "leaf"]).groupBy("registry_id", "pair", "leaf", "entry_id").agg(
        F.min("side").alias("first"), F.max("side").alias("last"),
        F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2"),
    )
    kind = (
        F.when(F.col("first") == 1, "added").when(F.col("last") == 0, "removed").when((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")), "changed")
    )
    return sides.withColumn("change_kind", kind).where("change_kind IS NOT NULL").select(
        "registry_id", F.col("pair").alias("snapshot_id"), "entry_id", "change_kind"
    )


def _both(key: str) -> list[Column]:
    """Digests bound to the key they belong to, so equal values under two keys do not cancel."""
    return [F.xxhash64(key, "d1").alias("d1"), F.xxhash64(F.lit(3), key, "d2").alias("d2")]
