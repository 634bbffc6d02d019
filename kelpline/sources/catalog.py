"""Catalog documents: parsing, size limits, cached copies."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.structural import as_list, as_object, as_text, symbol
from kelpline.sources.state import replace

#: Largest catalog document that is read.
MAX_CATALOG_BYTES = 32 << 20


class CatalogError(ValueError):
    """A document that is too large or has no list of entries."""


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(entries, generation time) of one catalog file.

    The size is checked before the read.  The document is an array, or an object with
    a list under ``entries``, else ``plugins``; anything else is a CatalogError.
    Entries are (pos, id, repo, verification_status, listing_validated_commit,
    upstream_observed_commit, upstream_check_status, repository_layout, kind, extra);
    ``extra`` is JSON of all other fields.
    """
    if os.path.getsize(path) > MAX_CATALOG_BYTES:
        raise CatalogError(f"{path} is larger than {MAX_CATALOG_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return parse_catalog(spark, f.read())


def parse_catalog(spark: SparkSession, text: str) -> tuple[DataFrame, str | None]:
    if len(text.encode()) > MAX_CATALOG_BYTES:
        raise CatalogError("the document is too large")
    root = spark.createDataFrame([(text,)], "text string").select(F.try_parse_json("text").alias("v"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    listed = F.when(symbol(F.col("v")) == "array", F.col("v")).otherwise(
        F.when(symbol(get("entries")) == "array", get("entries")).when(
            symbol(get("entries")).isin("absent", "null") & (symbol(get("plugins")) == "array"), get("plugins")
        )
    )
    time = F.coalesce(F.try_variant_get("v", "$.generation_time", "string"), F.try_variant_get("v", "$.generatedAt", "string"))
    wrapped = symbol(F.col("v")) == "object"
    head = root.select(listed.isNotNull().alias("ok"), F.when(wrapped, time).alias("at")).first()
    if not head.ok:
        raise CatalogError("neither an array nor an object with a list of entries")
    return parsed_entries(root.select(listed.alias("list")), [], F.col("list")), head.at


#: Keys of an entry -> columns.
FIELDS = {
    "id": "id",
    "repo": "repo",
    "verificationStatus": "verification_status",
    "listingValidatedCommit": "listing_validated_commit",
    "upstreamObservedCommit": "upstream_observed_commit",
    "upstreamCheckStatus": "upstream_check_status",
    "repositoryLayout": "repository_layout",
    "kind": "kind",
}


def parsed_entries(catalogs: DataFrame, keys: list[str], listed: Column) -> DataFrame:
    """*keys*, pos, one text column per FIELDS (null unless the value is a scalar) and ``extra``, JSON of all other
    fields, of each element of the list (a VARIANT) of each catalog; an element that is no object has nulls."""
    entries = catalogs.select(*keys, F.posexplode(as_list(listed)).alias("pos", "e"))
    rest = F.map_filter(as_object(F.col("e")), lambda k, _: ~k.isin(*FIELDS))

    def text(key: str) -> Column:
        v = F.try_variant_get("e", f"$.{key}", "variant")
        return F.when(~symbol(v).isin("array", "object"), as_text(v))

    columns = [text(k).alias(n) for k, n in FIELDS.items()]
    return entries.select(*keys, F.col("pos").cast("long").alias("pos"), *columns, F.to_json(rest).alias("extra"))


def keep_catalog(folder: str, data: bytes, meta: dict) -> None:
    """Put a fetched catalog and what is known of it into *folder*, each file at once and private; CatalogError
    if it is too large.  The digest is recorded last, so a copy cut short is not verified."""
    if len(data) > MAX_CATALOG_BYTES:
        raise CatalogError("the document is too large")
    replace(os.path.join(folder, "catalog.json"), data)
    whole = meta | {"file_digest": hashlib.sha256(data).hexdigest()}
    replace(os.path.join(folder, "catalog.meta.json"), json.dumps(whole, indent=2, sort_keys=True).encode())


def load_cached(spark: SparkSession, folder: str, official: str, original: Callable[[str], bytes | None]) -> dict | None:
    """The catalog kept in *folder* (``catalog.json`` beside ``catalog.meta.json``), or None if either is missing.

    Gives entries, generation_time, repository, repository_commit, retrieved_at and verified: whether
    the recorded digest is the file's, the recorded repository is *official*, the commit is one, and
    *original*(commit), the bytes as fetched, are the file's.  Raises CatalogError for a file too large or no catalog.
    """
    meta_path, path = os.path.join(folder, "catalog.meta.json"), os.path.join(folder, "catalog.json")
    if not (os.path.exists(meta_path) and os.path.exists(path)):
        return None
    with open(meta_path, encoding="utf-8") as f:
        meta = json.load(f)
    entries, at = read_catalog(spark, path)
    commit = meta["repository_commit"]
    known = len(commit) in (40, 64) and not set(commit) - set("0123456789abcdefABCDEF")
    verified = known and meta.get("file_digest") is not None and verified_copy(path, meta["file_digest"], original(commit), meta.get("repository_url"), official)
    return {
        "entries": entries,
        "generation_time": at,
        "repository": meta.get("repository_url") or official,
        "repository_commit": commit,
        "retrieved_at": meta.get("retrieved_at") or "unknown",
        "verified": verified,
    }


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """A package index, a JSON array of objects, gzip or not: (votes, modified, flagged), absent ones null."""
    root = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    one = root.select(F.explode(as_list(F.col("v"))).alias("p"))
    flag = F.try_variant_get("p", "$.OutOfDate", "variant")
    flagged = F.when(symbol(flag).isin("absent", "null"), False).when(symbol(flag) == "boolean", F.try_variant_get(flag, "$", "boolean")).when(
        symbol(flag) == "number", F.try_variant_get(flag, "$", "double") != 0
    )
    return one.select(
        F.try_variant_get("p", "$.NumVotes", "bigint").alias("votes"),
        F.try_variant_get("p", "$.LastModified", "bigint").alias("modified"),
        flagged.alias("flagged"),
    )


def parse_remote_head(text: str) -> str:
    """Commit of the two-line answer ``ref: refs/... HEAD`` and ``<commit> HEAD``; ValueError otherwise."""
    lines = text.splitlines()
    if len(lines) != 2 or not lines[0].startswith("ref: refs/heads/") or not lines[0].endswith("\tHEAD"):
        raise ValueError("no symbolic head")
    commit, tab, name = lines[1].partition("\t")
    if not tab or name != "HEAD" or len(commit) not in (40, 64) or set(commit) - set("0123456789abcdefABCDEF"):
        raise ValueError("no commit")
    return commit


def verified_copy(path: str, digest: str, original: bytes | None, repository: str, official: str) -> bool:
    """Whether a cached file is what was fetched: digest, bytes and recorded repository agree."""
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest() == digest and original == data and repository == official
