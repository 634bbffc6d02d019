"""Baselines out of an append-only log, and comparisons against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.skew import running_sums
from kelpline.functions.text import truncated
from kelpline.operators.identity import FIELDS, drift_key, identity_of, same_identity


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row appended last of each key (by *order*, not by any time in it); partial
    aggregation keeps one row per key and task."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def nth_record(log: DataFrame, keys: list[str], order: list[str], index: int) -> DataFrame:
    """The *index*-th record (0-based, append order) of each key that has so many."""
    along = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("nth", F.row_number().over(along)).where(F.col("nth") == index + 1).drop("nth")


def record_by_digest(log: DataFrame, keys: list[str], order: list[str], digest: Column) -> DataFrame:
    """The newest record of each key whose digest is the one asked for."""
    return latest(log.where(digest), keys, order)


def in_force(events: DataFrame, keys: list[str], order: list[str], on: list[str], off: list[str], kind: str) -> DataFrame:
    """Keys whose last event of either sort is one of *on* (set add and remove, event-sourced)."""
    relevant = events.where(F.col(kind).isin(*on, *off)).select(*keys, *order, kind)
    return latest(relevant, keys, order).where(F.col(kind).isin(*on)).select(*keys)


def compare_with_baseline(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: 'untrusted' without baseline, 'changed' if any field differs
    (null-safe), 'partial' if equal but with limitations, else 'unchanged'."""
    old = F.struct(*[F.col(f"old_{f}").alias(f) for f in FIELDS])
    new = F.struct(*[F.col(f).alias(f) for f in FIELDS])
    base = baseline.select(*keys, F.lit(True).alias("known"), *[F.col(f).alias(f"old_{f}") for f in FIELDS if f not in keys])
    joined = current.join(base, keys, "left")
    joined = joined.withColumns({f"old_{f}": F.col(f) for f in FIELDS if f in keys})
    state = (
        F.when(F.col("known").isNull(), "untrusted")
        .when(~same_identity(old, new), "changed")
        .when(F.size("limitations") > 0, "partial")
        .otherwise("unchanged")
    )
    return joined.select(*keys, state.alias("state"))


def drifted(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """keys, drift_key of the components whose identity is not that of their baseline; the key tells this
    difference from any other (see ``identity.drift_key``)."""
    named = lambda c: identity_of(F.struct(*[c(f).alias(f) for f in FIELDS]))
    old = named(lambda f: F.col(f) if f in keys else F.col(f"old_{f}"))
    base = baseline.select(*keys, *[F.col(f).alias(f"old_{f}") for f in FIELDS if f not in keys])
    same = F.lit(True)
    for f in FIELDS:
        same = same & (F.lit(True) if f in keys else F.col(f).eqNullSafe(F.col(f"old_{f}")))
    changed = current.join(base, keys).where(~same)
    return changed.select(*keys, drift_key(F.col("plugin_id"), old, named(F.col)).alias("drift_key"))


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str], files: str) -> DataFrame:
    """keys, path of map entries that differ between the two sides; a missing entry differs
    from any present one, a null value only from values.  Only keys on both sides are compared,
    inside their joined row; the entries are hashed, so the work is linear in them."""
    pairs = old.select(*keys, F.col(files).alias("a")).join(new.select(*keys, F.col(files).alias("b")), keys)
    # One text per entry: whether there is a value, the length of the path, the path and the value.
    told = lambda e: F.concat(
        F.when(e["value"].isNull(), "-").otherwise("+"), F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.coalesce(e["value"], F.lit(""))
    )
    entries = lambda c: F.coalesce(F.transform(F.map_entries(c), told), F.array().cast("array<string>"))
    both = pairs.select(*keys, entries("a").alias("a"), entries("b").alias("b"))
    differs = F.concat(F.array_except("a", "b"), F.array_except("b", "a"))

    def path(entry: Column) -> Column:
        colon = F.instr(entry, ":")
        size = F.substring(entry, F.lit(2), colon - 2).cast("int")
        return F.substring(entry, colon + 1, size)

    return both.select(*keys, F.explode(F.sort_array(F.array_distinct(F.transform(differs, path)))).alias("path"))


def absent(known: DataFrame, present: DataFrame, keys: list[str], *except_for: DataFrame) -> DataFrame:
    """Distinct keys of *known* that are neither present nor in any of *except_for*."""
    out = known.select(*keys).distinct()
    for other in (present, *except_for):
        out = out.join(other.select(*keys).distinct(), keys, "left_anti")
    return out


def appended(log: DataFrame, fresh: DataFrame, keys: list[str], order: list[str], part: Column, seq: str = "seq") -> DataFrame:
    """*log* and, behind it, the rows of *fresh* (the same columns without *seq*): each key's rows in *order*
    take the numbers after its greatest.  A bag union; nothing is dropped or merged.  *part* cuts the order into
    ranges (not null, never decreasing along it), so that a hot key is numbered range by range."""
    ends = log.groupBy(*keys).agg(F.max(seq).alias("end"))
    counted = fresh.withColumns({"part_": part, "nth_": F.lit(1).cast("long")})
    numbered = running_sums(counted, keys, "part_", [F.col(c) for c in order], ["nth_"])
    same = [numbered[k].eqNullSafe(ends[k]) for k in keys]
    joined = numbered.join(ends, same, "left").select(
        *[numbered[c] for c in fresh.columns], (F.coalesce("end", F.lit(-1)) + F.col("nth_")).cast(log.schema[seq].dataType).alias(seq)
    )
    return log.unionByName(joined.select(*log.columns))


def changed_text(changed: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """keys, text: one line ``changed: path`` per path in order, cut at *limit* bytes, and whether it was.
    A key's paths are those of one component."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_set("path")), lambda p: F.concat(F.lit("changed: "), p, F.lit("\n"))), "")
    texts = changed.groupBy(*keys).agg(lines.alias("text"))
    return texts.select(*keys, truncated(F.col("text"), limit).alias("t")).select(*keys, "t.text", "t.truncated")
