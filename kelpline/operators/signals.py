"""Signals with stable keys and the state that tells new ones from known ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNAL = ("ord", "plugin_id", "kind", "severity", "key")


def union_signals(*parts: DataFrame) -> DataFrame:
    """Bag union of signal tables by name."""
    return reduce(DataFrame.unionByName, [p.select(*SIGNAL) for p in parts])


def new_signals(signals: DataFrame, state: DataFrame) -> DataFrame:
    """Signals whose key is not in *state*; repeated rows of one key are all new."""
    return signals.join(state.select("key").distinct(), "key", "left_anti")


def next_state(signals: DataFrame, state: DataFrame, emitted_at: str) -> DataFrame:
    """(key, emitted_at): known keys that are still live keep their time, new ones get
    *emitted_at*; keys no longer live are forgotten, so they are new when they return."""
    live = signals.select("key").distinct()
    kept = state.join(live, "key", "left_semi").groupBy("key").agg(F.min("emitted_at").alias("emitted_at"))
    fresh = live.join(state, "key", "left_anti").select("key", F.lit(emitted_at).alias("emitted_at"))
    return kept.unionByName(fresh)


def summary(signals: DataFrame, state: DataFrame) -> DataFrame:
    """One row: outstanding (distinct keys), new (rows), quiet, highest_severity."""
    known = state.select("key", F.lit(True).alias("known")).distinct()
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    one = signals.join(known, "key", "left").agg(
        F.count_distinct("key").alias("outstanding"), F.count_if(F.col("known").isNull()).alias("new"), F.max(rank).alias("top")
    )
    return one.select(
        "outstanding",
        "new",
        (F.col("outstanding") == 0).alias("quiet"),
        F.when(F.col("top") == 2, "critical").when(F.col("top") == 1, "warning").otherwise("none").alias("highest_severity"),
    )
