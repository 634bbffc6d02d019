"""Queries of the general problems (1 to 6) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import compare, history, references, schema_drift, snapshots, structural
from kelpline.plans.general_sql import ORACLES  # noqa: F401
from kelpline.sources.tables import reader


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return structural.flatten_reports(reader(spark, directory)("inventory_reports"))


def p1_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """How many plugin records have each structural variant."""
    plugins = structural.plugin_supertype(reader(spark, directory)("inventory_reports"))
    return plugins.groupBy("plugin_shape", "files_shape", "limits_shape").agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    t = reader(spark, directory)
    return history.attribute_history(t("trust_records"), t("review_decisions"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    t = reader(spark, directory)
    return compare.identity_differences(t("identities_local"), t("identities_mirror"))


#: Decisions and revocations are about a plugin's baseline: if that is orphaned, so are they.
CASCADE = (
    references.Edge("review_decisions", "trust_records", ("machine_id", "plugin_id")),
    references.Edge("trust_histories", "review_decisions", ("machine_id", "plugin_id")),
)


def _cascade(spark: SparkSession, directory: str) -> DataFrame:
    t = reader(spark, directory)
    return references.orphan_references(
        t("trust_records"), t("review_decisions"), t("trust_histories"), t("installed_plugins"), CASCADE
    )


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """The direct orphans, as the cascade reports them (depth 0) beside the inherited ones."""
    return _cascade(spark, directory).where("depth = 0").drop("depth")


def p4_cascade(spark: SparkSession, directory: str) -> DataFrame:
    """Orphans per table, reason, month and depth of inheritance."""
    return _cascade(spark, directory).groupBy("ref_table", "orphan_reason", "ref_month", F.col("depth").cast("long").alias("depth")).agg(
        F.count(F.lit(1)).alias("n")
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return schema_drift.schema_changes(reader(spark, directory)("catalog_files"))


def p5_rescued(spark: SparkSession, directory: str) -> DataFrame:
    """What ingestion rescued before anything is promoted: a row per field of an entry that is unknown or did not fit."""
    return schema_drift.rescued_fields(schema_drift.ingest(reader(spark, directory)("catalog_files")))


def p5_table(spark: SparkSession, directory: str) -> DataFrame:
    """The one consistent table: typed columns, renamed and retyped values replayed into
    them, promoted fields, and every other non-null value in ``_rescued``."""
    table = schema_drift.ingest(reader(spark, directory)("catalog_files"))
    approved = dict.fromkeys(schema_drift.TARGET, "string") | {"stars": "bigint", "license": "string"}
    return schema_drift.promote(table, approved, schema_drift.RENAMED)


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    t = reader(spark, directory)
    return snapshots.snapshot_changes(t("catalog_snapshots"), t("catalog_entries"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shapes, p2_found, p3_found, p4_found, p4_cascade, p5_found, p5_rescued, p5_table, p6_found)}
