"""Content identities: ordered digests over the files of a component.

A component's digest is SHA-256 over its entries in path order (byte order), each as
length, path, kind, mode, length and data.  The order is part of the result, so the
entries of one component are gathered and sorted: of those met first in visit order (see
``visit_order``) at most ``MAX_FILES``, picked before anything is gathered; the bytes of each are
bounded where they are read (``sources/trees.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.skew import running_sums
from kelpline.functions.text import big_endian, sha256_hex

MAX_FILES = 10_000
MAX_FILE_BYTES, MAX_TOTAL_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 20, 1 << 20
FIELDS = ("plugin_id", "repository", "head", "tree", "content_digest", "file_count", "limitations")


def file_digest(kind: Column, mode: Column, data: Column) -> Column:
    """Digest of one file: kind, mode and data, without its path."""
    return sha256_hex(F.concat(F.encode(kind, "UTF-8"), big_endian(mode, 4), data))


def entry_bytes(path: Column, kind: Column, mode: Column, data: Column) -> Column:
    name = F.encode(path, "UTF-8")
    return F.concat(
        big_endian(F.length(name), 8), name, F.encode(kind, "UTF-8"), big_endian(mode, 4), big_endian(F.length(data), 8), data
    )


def content_identity(entries: DataFrame, keys: list[str], max_files: int = MAX_FILES) -> DataFrame:
    """keys, content_digest, file_count, file_digests, file_limit of rows (keys, path, kind, mode, data).

    Rows repeated alike count once, and of rows that give one path differently the least (kind, mode,
    data) counts; one without a path is no file, but its keys are a
    component all the same (with no files: the digest of no bytes).  A null kind is '?', a null mode 0 and null
    data no bytes, so every file counts.  Of the entries in visit order the first *max_files*
    are digested; ``file_limit`` tells whether there were more.
    """
    defined = entries.select(
        *keys,
        "path",
        F.coalesce("kind", F.lit("?")).alias("kind"),
        F.coalesce("mode", F.lit(0)).cast("long").alias("mode"),
        F.coalesce("data", F.lit(b"")).alias("data"),
    )
    met = Window.partitionBy(*keys).orderBy(F.col("path").isNull(), visit_order(F.col("path")), "path")
    # One more than is digested tells that there were more; Spark keeps so many per task before the exchange.
    once = defined.groupBy(*keys, "path").agg(F.min(F.struct("kind", "mode", "data")).alias("file")).select(*keys, "path", "file.*")
    first = once.withColumn("nth", F.row_number().over(met)).where(F.col("nth") <= max_files + 1)
    counts = F.col("path").isNotNull() & (F.col("nth") <= max_files)
    packed = first.select(
        *keys,
        (F.col("path").isNotNull() & ~counts).alias("beyond"),
        F.when(
            counts,
            F.struct(
                "path",
                F.hex(entry_bytes(*[F.col(c) for c in ("path", "kind", "mode", "data")])).alias("bytes"),
                file_digest(*[F.col(c) for c in ("kind", "mode", "data")]).alias("digest"),
            ),
        ).alias("file"),
    )
    kept = packed.groupBy(*keys).agg(F.array_sort(F.collect_list("file")).alias("files"), F.bool_or("beyond").alias("file_limit"))
    return kept.select(
        *keys,
        sha256_hex(F.unhex(F.array_join(F.transform("files", lambda e: e["bytes"]), ""))).alias("content_digest"),
        F.size("files").cast("long").alias("file_count"),
        F.map_from_arrays(F.transform("files", lambda e: e["path"]), F.transform("files", lambda e: e["digest"])).alias("file_digests"),
        "file_limit",
    )


def limitations_of(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, limitations: the sorted distinct limitation codes of each component's rows."""
    return entries.groupBy(*keys).agg(F.array_sort(F.collect_set("limitation")).alias("limitations"))


def map_identity(df: DataFrame, keys: list[str], files: str) -> DataFrame:
    """keys, content_digest, file_count over a map of path to digest (null is empty), in path order."""
    entries = F.array_sort(F.map_entries(F.coalesce(F.col(files), F.create_map().cast("map<string,string>"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\t"), F.coalesce(e["value"], F.lit("")), F.lit("\n"))), "")
    return df.select(*keys, sha256_hex(text).alias("content_digest"), F.size(entries).cast("long").alias("file_count"))


def limitation_set(limitations: Column) -> Column:
    """Sorted distinct limitations without nulls; null is empty."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(limitations, F.array().cast("array<string>")), lambda x: x.isNotNull())))


def identity_of(record: Column) -> Column:
    """SourceIdentity struct of a record struct: its FIELDS, a missing file count being 0."""
    return F.struct(*[(F.coalesce(record[f], F.lit(0).cast("long")) if f == "file_count" else record[f]).alias(f) for f in FIELDS])


def identity_material(identity: Column) -> Column:
    """JSON array of the fields that make identities equal (the file map is not one), null where one is."""

    def json(f: str) -> Column:
        if f == "limitations":
            return F.to_json(identity[f])
        if f == "file_count":
            return identity[f].cast("string")
        quoted = F.to_json(F.array(identity[f]))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    parts = [F.coalesce(json(f), F.lit("null")) for f in FIELDS]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def same_identity(a: Column, b: Column) -> Column:
    """Null-safe equality over FIELDS."""
    same = F.lit(True)
    for f in FIELDS:
        same = same & a[f].eqNullSafe(b[f])
    return same


def drift_key(plugin_id: Column, trusted: Column, current: Column) -> Column:
    return F.concat(
        F.lit("drift:"), plugin_id, F.lit(":"), sha256_hex(F.concat(identity_material(trusted), identity_material(current)))
    )


#: Files whose outcomes are appended one by one before they join the rest, so that appending stays near linear.
FOLD_CHUNK = 128


def budget_fold(files: Column, file_limit: int = MAX_FILE_BYTES, total_limit: int = MAX_TOTAL_BYTES, sample: int = SAMPLE_BYTES) -> Column:
    """Fold of files (array of (path, size) in visit order) under a byte budget.

    Once the budget is used up every file, empty ones included, is skipped.  Before that, a file within
    *file_limit* and what is left is read whole; any other is sampled: as much of its head as *sample*
    and what is left allow, and of a file larger than that half as many bytes of its tail, charged
    even beyond what was left.  Result: array of (path, outcome 'read' | 'sampled' | 'skipped', charged).
    """
    kind = "array<struct<path:string,outcome:string,charged:bigint>>"

    def step(acc: Column, f: Column) -> Column:
        left = F.lit(total_limit) - acc["used"]
        bound = F.least(F.lit(sample), left)
        head = F.least(bound, f["size"])
        tail = F.when((f["size"] > bound) & (bound > 1), F.floor(bound / 2)).otherwise(F.lit(0))
        over = left <= 0
        fits = (f["size"] <= file_limit) & (f["size"] <= left)
        outcome = F.when(over, "skipped").when(fits, "read").otherwise("sampled")
        charged = F.when(over, F.lit(0)).when(fits, f["size"]).otherwise(head + tail).cast("long")
        row = F.struct(f["path"].alias("path"), outcome.alias("outcome"), charged.alias("charged"))
        return F.struct((acc["used"] + charged).cast("long").alias("used"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    def chunk(acc: Column, some: Column) -> Column:
        part = F.aggregate(some, F.struct(acc["used"].alias("used"), F.array().cast(kind).alias("rows")), step)
        # One struct, evaluated once: the sum goes on, the rows of the chunk are kept as one element.
        return F.aggregate(
            F.array(part),
            acc,
            lambda a, p: F.struct(p["used"].alias("used"), F.concat(a["rows"], F.array(p["rows"])).alias("rows")),
        )

    last = F.greatest(F.size(files) - 1, F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(last / FOLD_CHUNK).cast("int")), lambda i: F.slice(files, i * FOLD_CHUNK + 1, FOLD_CHUNK))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("rows"))
    return F.when(files.isNotNull(), F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["rows"])))


def budget_folds(
    files: DataFrame, keys: list[str], part: str, file_limit: int = MAX_FILE_BYTES, total_limit: int = MAX_TOTAL_BYTES, sample: int = SAMPLE_BYTES
) -> DataFrame:
    """keys, path, outcome, charged: ``budget_fold`` over all files (keys, *part*, place, path, size) of
    each key in the order of place, of which *part* is a range.  Null keys form one group; places differ.

    A file charges at least the smaller of its size and *sample*, or all that is left.  So the
    files before which these sum up to *total_limit* decide the rest: after them the budget is
    used up whatever was charged.  Only they are gathered, at most one per byte of the budget, and
    without the empty ones, which charge nothing: those are read up to the place where the budget ends.
    """
    least = F.least("size", F.lit(sample)).cast("long")
    sized = files.select(*keys, part, "place", "path", "size", least.alias("least"), least.alias("until"))
    summed = running_sums(sized, keys, part, [F.col("place")], ["until"])
    early = F.col("until") - F.col("least") < total_limit
    gathered = summed.where(early & (F.col("size") > 0)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "size", "path"))).alias("files"))
    folded = gathered.select(*keys, "files", budget_fold(F.col("files"), file_limit, total_limit, sample).alias("rows"))
    # Places are in order, so the budget ends before the first skipped file or, if the last one used it up, after that.
    used = F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + r["charged"])
    n_open = F.size(F.filter("rows", lambda r: r["outcome"] != "skipped"))
    ends = folded.select(
        *[F.col(k).alias(f"{k}_of") for k in keys], F.when(used >= total_limit, F.get("files", n_open - 1)["place"]).alias("last")
    )
    empty = summed.where(early & (F.col("size") <= 0))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    outcome = F.when(F.col("place") > F.col("last"), "skipped").otherwise("read")
    free = F.lit(0).cast("long").alias("charged")
    return (
        folded.select(*keys, F.inline("rows"))
        .unionByName(empty.join(ends, same, "left").select(*keys, "path", outcome.alias("outcome"), free))
        .unionByName(summed.where(~early).select(*keys, "path", F.lit("skipped").alias("outcome"), free))
    )


def visit_order(path: Column) -> Column:
    """Key that sorts paths as a depth-first walk meets them: by name within each folder."""
    return F.split(path, "/")
