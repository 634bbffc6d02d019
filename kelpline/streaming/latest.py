"""Structured Streaming forms of the log operators.

An append-only log arrives as files; what is kept between batches is one row per
key.  A batch is folded down to its own latest rows and written as one more part of the table, so it
costs what the batch costs; a reader takes the latest row over all parts.  After COMPACT parts they are
folded into one, and parts and manifests no reader can need are removed.

Which parts are the table, and which batch of which stream is in it, stands in a numbered manifest that
appears at once.  Folding is idempotent, so a batch that runs twice gives the same table.  A stream is
known by the id in its checkpoint: one restarted with a new checkpoint is another stream,
whose batches count from 0 again and are never taken for old ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kelpline.operators.baseline import latest
from kelpline.sources.files import Files

#: Parts that are folded into one.
COMPACT = 16


class LatestTable:
    """One row per key of a log: that with the greatest order columns so far.  *folder* may be on any file
    system that Spark can write; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str]):
        self.spark, self.folder, self.keys, self.order = spark, folder, keys, order
        self.files = Files(spark)

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if n.startswith("manifest-") and n.endswith(".json")]

    def _current(self) -> dict:
        """The newest manifest: number, parts, and per stream the last batch folded in."""
        names = self._manifests()
        return json.loads(self.files.read(f"{self.folder}/{names[-1]}")) if names else {"number": 0, "parts": [], "folded": {}}

    def _rows(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts])
        return rows if len(parts) == 1 else latest(rows, self.keys, self.order).select(*rows.columns)

    def read(self) -> DataFrame | None:
        parts = self._current()["parts"]
        return self._rows(parts) if parts else None

    def apply(self, batch: DataFrame, number: int, stream: str = "") -> None:
        """Fold batch *number* of *stream* in, unless that is in the table already."""
        now = self._current()
        if now["folded"].get(stream, -1) >= number:
            return
        part = f"part-{now['number'] + 1:09d}-{uuid.uuid4().hex}"
        latest(batch, self.keys, self.order).select(*batch.columns).write.parquet(f"{self.folder}/{part}")
        parts = [*now["parts"], part]
        if len(parts) > COMPACT:
            whole = f"part-{now['number'] + 1:09d}-{uuid.uuid4().hex}"
            self._rows(parts).write.parquet(f"{self.folder}/{whole}")
            parts = [whole]
        following = {"number": now["number"] + 1, "parts": parts, "folded": now["folded"] | {stream: number}}
        if not self.files.create(f"{self.folder}/manifest-{following['number']:09d}.json", json.dumps(following)):
            raise RuntimeError(f"another writer is at {self.folder}")
        self._sweep({*parts, *now["parts"]})

    def _sweep(self, needed: set[str]) -> None:
        """Remove all but the two newest manifests, and the parts neither of them has."""
        for name in self._manifests()[:-2]:
            self.files.remove(f"{self.folder}/{name}")
        for name in self.files.names(self.folder):
            if name.startswith("part-") and name not in needed:
                self.files.remove(f"{self.folder}/{name}")


def follow_latest(
    spark: SparkSession, source: str, schema: StructType, table: LatestTable, checkpoint: str
) -> StreamingQuery:
    """Fold every new Parquet file of *source* into *table*; ends when all present are in."""
    rows = spark.readStream.schema(schema).parquet(source)

    def fold(batch: DataFrame, number: int) -> None:
        # Spark gives every new checkpoint an id of its own.
        table.apply(batch, number, json.loads(table.files.read(f"{checkpoint}/metadata"))["id"])

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
