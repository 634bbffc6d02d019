"""History of changing attributes as validity intervals (problem 2).

Presence bitmaps.  The observations of an entity in time order are its snapshots.
They are cut into words of at most 64; for each value seen in a word one BIGINT
holds one bit per snapshot at which the entity had that value.  A run of
consecutive set bits is one version: ``b & ~(b << 1)`` has the bits at which runs
begin, and a run beginning at bit 0 continues the word before it if that one ended
on the same value.

Values are compared by a 128-bit digest taken before the first shuffle, so wide
values never travel.  An entity with any number of observations is spread over its
time ranges (functions/skew.py): a range has at most one observation per second, that is
RANGE_SECONDS, whatever the table.  Versions that begin and end inside a range are done
there; across ranges only the first and the last run of each are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.frames import pick
from kelpline.functions.skew import time_range
from kelpline.functions.times import epoch_seconds

WORD = 64
ENTITY = ["entity", "machine_id", "plugin_id", "scope"]
IDENTITY_FIELDS = ["plugin_id", "repository", "head", "tree", "content_digest", "file_count", "limitations"]


def digest(*values: Column) -> Column:
    """16 bytes that are equal for equal values; null equals null, and null differs from empty."""
    named = [v.alias(f"v{i}") for i, v in enumerate(values)]
    return F.unhex(F.md5(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}))).alias("value")


def last_delivered(df: DataFrame, key: str, rest: list[str], ingested: str) -> DataFrame:
    """Of each *key* the last ingested row.  Spark keeps one row per key and partition
    before the exchange, so repeated deliveries of one key do not meet in one task.
    Ties on *ingested* go to the greatest row, nulls count as earliest."""
    newest = Window.partitionBy(key).orderBy(
        F.col(ingested).desc_nulls_last(), F.xxhash64(*rest).desc()
    )
    ranked = df.withColumn("nth", F.row_number().over(newest))
    return ranked.where("nth = 1").select(key, *rest)


def baseline_observations(trust_records: DataFrame) -> DataFrame:
    """(entity columns, at, seq, value) of trust records; value is the accepted
    SourceIdentity without its file map."""
    df = pick(trust_records, "record_id", "machine_id", "seq", "plugin_id", "accepted", "accepted_at", "ingested_at")
    narrow = df.select(
        "record_id",
        "machine_id",
        "plugin_id",
        "seq",
        epoch_seconds(F.col("accepted_at")).alias("at"),
        digest(*[F.col(f"accepted.{f}") for f in IDENTITY_FIELDS]),
        "ingested_at",
    )
    last = last_delivered(narrow, "record_id", ["machine_id", "plugin_id", "seq", "at", "value"], "ingested_at")
    return last.select(
        F.lit("baseline").alias("entity"), "machine_id", "plugin_id", F.lit("").alias("scope"), "at", "seq", "value"
    )


def review_observations(review_decisions: DataFrame) -> DataFrame:
    """(entity columns, at, seq, value) of review decisions; value is the action."""
    df = pick(
        review_decisions, "decision_id", "machine_id", "seq", "plugin_id", "action", "scope", "created_at", "ingested_at"
    )
    narrow = df.select(
        "decision_id",
        "machine_id",
        "plugin_id",
        "scope",
        "seq",
        epoch_seconds(F.col("created_at")).alias("at"),
        digest(F.col("action")),
        "ingested_at",
    )
    last = last_delivered(
        narrow, "decision_id", ["machine_id", "plugin_id", "scope", "seq", "at", "value"], "ingested_at"
    )
    return last.select(F.lit("review").alias("entity"), "machine_id", "plugin_id", "scope", "at", "seq", "value")


def _runs(observed: DataFrame, group: list[str]) -> DataFrame:
    """(*group*, at, value, opens) of rows (*group*, at, value), one per time: the starts of runs, found
    through one presence bitmap per word and value.  ``opens`` is false for a run that begins a
    word and may continue the run before it."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("at")) - 1
    placed = observed.withColumn("n", nth).select(
        *group, "at", "value", F.floor(F.col("n") / WORD).alias("word"), (F.col("n") % WORD).cast("int").alias("slot")
    )
    bitmaps = placed.groupBy(*group, "word", "value").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot"))).alias("bits"),
        F.collect_list(F.struct("slot", "at")).alias("seen"),
    )
    begun = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftleft("bits", 1)))
    first = F.filter("seen", lambda s: F.call_function("getbit", begun, s["slot"]) == 1)
    return bitmaps.select(*group, "value", F.inline(first)).select(*group, "at", "value", (F.col("slot") > 0).alias("opens"))


def validity_intervals(observations: DataFrame) -> DataFrame:
    """Versions: entity columns, valid_from, valid_to (BIGINT epoch seconds).

    *observations*: ENTITY columns, at, seq, value.  At equal times the highest seq
    holds (equal seqs: the greatest digest).  A repeated value opens no new version.
    valid_to is the next version's start, -1 if there is none.  Rows with a null
    plugin_id or time are left out; null machine ids or scopes are ordinary values.
    An entity without observations has no rows.
    """
    seen = observations.where("plugin_id IS NOT NULL AND at IS NOT NULL").withColumn(
        "part", time_range(F.col("at"))
    )
    group = [*ENTITY, "part"]
    at_once = seen.repartition(*group).groupBy(*group, "at").agg(F.max(F.struct("seq", "value")).alias("held"))
    runs = _runs(at_once.select(*group, "at", F.col("held.value").alias("value")), group)

    # Inside a range: runs that continue the one before them go, and all but the last learn their end.
    inside = Window.partitionBy(*group).orderBy("at")
    before = runs.select(*group, "at", "value", "opens", F.lag("value").over(inside).alias("before"))
    kept = before.where("opens OR before IS NULL OR value <> before")
    ended = kept.select(
        *group, "at", "value", F.lead("at").over(inside).alias("next_at"), (F.row_number().over(inside) == 1).alias("first")
    )
    # Across ranges: the first and the last run of each meet; the others stay in groups of their own range.
    meets = F.col("first") | F.col("next_at").isNull()
    sorted_out = ended.select(
        *ENTITY,
        F.when(~meets, F.col("part")).alias("part"),
        "at",
        F.when(meets, F.col("value")).alias("value"),
        "next_at",
        "first",
    )
    across = Window.partitionBy(*ENTITY, "part")
    linked = sorted_out.withColumn("before", F.lag("value").over(across.orderBy("at")))
    goes_on = F.col("first") & F.coalesce(F.col("value") == F.col("before"), F.lit(False))
    # Where the next version after a range begins: at its first run, or where that ends if it only goes on.
    marked = linked.select("*", goes_on.alias("goes_on"), F.when(goes_on, F.col("next_at")).otherwise(F.col("at")).alias("begins"))
    later = across.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    versions = marked.withColumn("following", F.last("begins", ignorenulls=True).over(later)).where("NOT goes_on")
    return versions.select(
        *ENTITY,
        F.col("at").alias("valid_from"),
        F.coalesce("next_at", "following", F.lit(-1).cast("long")).alias("valid_to"),
    )


def attribute_history(trust_records: DataFrame, review_decisions: DataFrame) -> DataFrame:
    """Versions of each baseline and each reviewed scope (see validity_intervals)."""
    return validity_intervals(
        baseline_observations(trust_records).unionByName(review_observations(review_decisions))
    )
