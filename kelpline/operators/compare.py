"""Differences between two copies of a dataset, field by field (problem 3).

Both sides are tagged and united, grouped *once* by key into one struct per side
(partial aggregation folds repeated and outdated rows before the exchange), and the
two structs are compared by higher-order SQL generated from a field specification.
No join, no second shuffle.

Values only have to be told apart, so what crosses the exchange are 16-character tags (96 bits of
digest) of digests and of the values of a map, there as one text per entry, tag and key.  Two lists
of such texts are compared by hashing, in time linear in the entries.  Values are held equal if
their tags are; tags are only compared within one field, or one path, of one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.frames import pick


@dataclass(frozen=True)
class Field:
    """How a field compares.  kind: 'value', 'list' (null equals empty, order counts)
    or 'map' (null equals empty; one difference per key).  fold: a digest, whose letter case is ignored."""

    name: str
    kind: str = "value"
    fold: bool = False


IDENTITY = (
    Field("repository"),
    Field("head", fold=True),
    Field("tree", fold=True),
    Field("content_digest", fold=True),
    Field("file_count"),
    Field("limitations", "list"),
    Field("file_digests", "map", fold=True),
)


#: Characters of a tag: 12 bytes in base 64.
TAG = 16


def _tag(value: Column) -> Column:
    """Equal for equal values; null for null."""
    return F.substring(F.base64(F.unhex(F.md5(value))), 1, TAG)


def _canonical(f: Field) -> Column:
    c = F.col(f.name)
    if f.kind == "map":
        tagged = F.transform(
            F.map_entries(c), lambda e: F.concat(F.coalesce(_tag(F.lower(e["value"]) if f.fold else e["value"]), F.lit("-" * TAG)), e["key"])
        )
        return F.coalesce(tagged, F.array().cast("array<string>"))
    if f.kind == "list":
        return F.coalesce(c, F.array())
    return _tag(F.lower(c)) if f.fold else c


def difference_sql(fields: tuple[Field, ...], left: str, right: str) -> str:
    """SQL for an array of (field_name, file_path) structs, the differences of two structs."""
    parts = []
    for f in fields:
        a, b = f"{left}.{f.name}", f"{right}.{f.name}"
        item = f"named_struct('field_name', '{f.name}', 'file_path', %s)"
        if f.kind == "map":
            # An entry without its equal on the other side names a differing key; array_except hashes texts.
            only = f"concat(array_except({a}, {b}), array_except({b}, {a}))"
            keys = f"array_distinct(transform({only}, e -> substring(e, {TAG + 1})))"
            parts.append(f"transform({keys}, k -> {item % 'k'})")
        else:
            parts.append(f"IF({a} <=> {b}, array(), array({item % repr('')}))")
    return f"concat({', '.join(parts)})"


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: tuple[Field, ...],
    revision: list[str],
    names: tuple[str, str] = ("only_local", "only_mirror"),
) -> DataFrame:
    """keys, field_name, file_path: one row per difference between the two copies.

    Of each key and side the row with the highest *revision* columns counts (nulls
    are lowest; ties go to the greatest row hash, and equal rows are one).  Keys
    compare null-safely, so rows with a null key part are matched like any others.
    A key on one side only gives one row named in *names*.  Either side may be empty.
    """
    wanted = list(dict.fromkeys([*keys, *[f.name for f in fields], *revision]))

    def side(df: DataFrame, tag: int) -> DataFrame:
        row = F.struct(*[_canonical(f).alias(f.name) for f in fields])
        packed = pick(df, *wanted).select(*keys, *revision, row.alias("row"), F.lit(tag).alias("side"))
        return packed.withColumn("rank", F.struct(*revision, F.xxhash64("row").alias("tie")))

    both = side(left, 0).unionByName(side(right, 1))
    of = lambda tag: F.max_by(
        F.when(F.col("side") == tag, F.col("row")), F.when(F.col("side") == tag, F.col("rank"))
    )
    grouped = both.groupBy(*keys).agg(of(0).alias("a"), of(1).alias("b"))
    missing = f"named_struct('field_name', '%s', 'file_path', '')"  # noqa: F541
    differences = F.expr(
        f"CASE WHEN b IS NULL THEN array({missing % names[0]}) WHEN a IS NULL THEN array({missing % names[1]})"
        f" ELSE {difference_sql(fields, 'a', 'b')} END"
    )
    return grouped.select(*keys, F.inline(differences))


def identity_differences(local: DataFrame, mirror: DataFrame) -> DataFrame:
    """machine_id, plugin_id, field_name, file_path over two copies of the SourceIdentities."""
    return compare_copies(local, mirror, ["machine_id", "plugin_id"], IDENTITY, ["revision"])
