"""References to records that do not exist (problem 4).

All referring rows are written once as a table of references.  A fixpoint cascade runs over
it: round 0 are the *direct* orphans, references whose parent was not there at the time of
the reference; every further round semi-joins the children, along the edges of a
foreign-key graph, of the orphans that the round before found, until a round adds none.
Those are the *inherited* orphans.

Round 0 is a sweep: installations become +1/-1 events, references probes, both folded
to one row per parent key and time, and a running sum per parent key tells at each probe how
many installations are open, had begun, or exist at all.  No join of references with intervals takes
place, so a parent key with very many rows on both sides stays linear.  The sum is
carried across time ranges (functions/skew.py); folded, a range of a key has one row per second at most,
so no task's work grows with a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.frames import pick
from kelpline.functions.skew import running_sums, time_range
from kelpline.functions.times import epoch_seconds, ntz_seconds, utc_month
from kelpline.operators.history import last_delivered
from kelpline.operators.storage import cut_lineage

KEYS = ["machine_id", "plugin_id"]
REFERENCE = ["ref_table", "ref_id", "ref_pos", *KEYS, "at"]
#: Before any time: markers of the existence of a parent key.
BEGINNING = -(1 << 62)


def references(trust_records: DataFrame, review_decisions: DataFrame, trust_histories: DataFrame) -> DataFrame:
    """REFERENCE rows of the three referring tables, last delivery of each row only.
    Null plugin ids and unreadable times are left out; a null machine_id is a machine of its
    own, that of the installations without one."""

    def flat(df: DataFrame, table: str, key: str, time: str) -> DataFrame:
        narrow = pick(df, key, "machine_id", "plugin_id", time, "ingested_at").withColumn(
            "at", epoch_seconds(F.col(time))
        )
        last = last_delivered(narrow, key, ["machine_id", "plugin_id", "at"], "ingested_at")
        return last.select(
            F.lit(table).alias("ref_table"), F.col(key).alias("ref_id"), F.lit(0).cast("long").alias("ref_pos"), *KEYS, "at"
        )

    histories = pick(trust_histories, "history_id", "machine_id", "revoked_plugins", "saved_at", "ingested_at")
    revoked = last_delivered(
        histories.withColumn("at", epoch_seconds(F.col("saved_at"))),
        "history_id",
        ["machine_id", "revoked_plugins", "at"],
        "ingested_at",
    ).select("history_id", "machine_id", "at", F.posexplode("revoked_plugins").alias("ref_pos", "plugin_id"))
    rows = (
        flat(trust_records, "trust_records", "record_id", "accepted_at")
        .unionByName(flat(review_decisions, "review_decisions", "decision_id", "created_at"))
        .unionByName(
            revoked.select(
                F.lit("trust_histories").alias("ref_table"),
                F.col("history_id").alias("ref_id"),
                F.col("ref_pos").cast("long").alias("ref_pos"),
                *KEYS,
                "at",
            )
        )
    )
    return rows.where("plugin_id IS NOT NULL AND at IS NOT NULL")


def direct_orphans(refs: DataFrame, installed: DataFrame) -> DataFrame:
    """REFERENCE columns and orphan_reason: 'missing' (no installation at any time),
    'late' (all begin later) or 'deleted'.

    An installation covers ``installed_at <= t < removed_at``, a null removed_at has no
    end.  One with a null installed_at or one removed before it begins covers nothing
    but exists.  Rows delivered twice cover the same time twice, which changes nothing.
    """
    rows = pick(installed, "machine_id", "plugin_id", "installed_at", "removed_at").where("plugin_id IS NOT NULL")
    start, end = ntz_seconds(F.col("installed_at")), ntz_seconds(F.col("removed_at"))
    empty = F.coalesce(F.col("removed_at") <= F.col("installed_at"), F.lit(False))
    event = lambda at, opened, begun, exists: F.struct(
        at.alias("at"), *[F.lit(v).cast("long").alias(n) for n, v in (("opened", opened), ("begun", begun), ("exists", exists))]
    )
    events = rows.select(
        *KEYS,
        F.lit(0).alias("probe"),
        F.inline(
            F.filter(
                F.array(
                    event(F.lit(BEGINNING).cast("long"), 0, 0, 1),
                    F.when(start.isNotNull(), event(start, F.when(empty, 0).otherwise(1), 1, 0)),
                    F.when(start.isNotNull() & end.isNotNull() & ~empty, event(end, -1, 0, 0)),
                ),
                lambda e: e.isNotNull(),
            )
        ),
    )
    counted = ("opened", "begun", "exists")
    probes = refs.select(*KEYS, F.lit(1).alias("probe"), "at", *[F.lit(0).cast("long").alias(c) for c in counted])
    part = F.when(F.col("at") == BEGINNING, F.lit(BEGINNING)).otherwise(time_range(F.col("at")))
    folded = probes.unionByName(events).groupBy(*KEYS, "at").agg(F.max("probe").alias("probe"), *[F.sum(c).alias(c) for c in counted])
    sums = running_sums(folded.withColumn("part", part), KEYS, "part", [F.col("at")], list(counted))
    reason = F.when(F.col("exists") == 0, "missing").when(F.col("begun") == 0, "late").otherwise("deleted")
    # The times of a key at which it is not there: few, so the references are joined with these alone.
    gone = sums.where("probe = 1 AND opened <= 0").select(*[F.col(c).alias(f"gone_{c}") for c in (*KEYS, "at")], reason.alias("orphan_reason"))
    same = [F.col(c).eqNullSafe(F.col(f"gone_{c}")) if c == "machine_id" else F.col(c) == F.col(f"gone_{c}") for c in (*KEYS, "at")]
    return refs.join(gone, same).select(*REFERENCE, "orphan_reason")


@dataclass(frozen=True)
class Edge:
    """Rows of *child* refer to rows of *parent* by equal values of these columns."""

    child: str
    parent: str
    on: tuple[str, ...]


def orphan_cascade(
    rows: DataFrame, direct: DataFrame, edges: Sequence[Edge], ids: Sequence[str] = ("ref_table", "ref_id", "ref_pos")
) -> DataFrame:
    """*direct* with ``depth`` 0 and, below it, the rows that only inherit orphanhood.

    *rows* holds all records (ids and join columns), *direct* the orphans among them.
    Round n finds the children, along *edges*, of the orphans new in round n - 1
    that are not orphans yet.  Orphan sets are written to the shared folder between
    rounds, so lineage does not grow.  It ends when a round adds nothing, or when no
    edge leads on from the tables it could add to.  Cycles end, since no row is added twice.
    """
    found = cut_lineage(direct.withColumn("depth", F.lit(0)))
    fresh, depth, tables = found, 0, {e.parent for e in edges}
    while leading := [e for e in edges if e.parent in tables]:
        depth += 1
        hits = []
        for e in leading:
            parents = fresh.where(F.col("ref_table") == e.parent).select(*e.on).distinct()
            hits.append(rows.where(F.col("ref_table") == e.child).join(parents, list(e.on), "left_semi").select(*rows.columns))
        new = reduce(DataFrame.unionByName, hits)
        if len({e.child for e in leading}) < len(leading):
            new = new.dropDuplicates(list(ids))
        new = new.join(found.select(*ids), list(ids), "left_anti")
        new = cut_lineage(new.withColumn("orphan_reason", F.lit("inherited")).withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        found, fresh, tables = found.unionByName(new), new, {e.child for e in leading}
    return found


def orphan_references(
    trust_records: DataFrame,
    review_decisions: DataFrame,
    trust_histories: DataFrame,
    installed: DataFrame,
    edges: Sequence[Edge] = (),
) -> DataFrame:
    """ref_table, ref_id, ref_pos, orphan_reason, ref_month, depth (0: direct)."""
    refs = cut_lineage(references(trust_records, review_decisions, trust_histories))
    found = orphan_cascade(refs, direct_orphans(refs, installed), edges)
    return found.select("ref_table", "ref_id", "ref_pos", "orphan_reason", utc_month(F.col("at")).alias("ref_month"), "depth")
