"""Helpers that make operators indifferent to extra or clashing input columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns *names*, by exact spelling.

    Extra columns are ignored even if they differ from a wanted one only in
    letter case or repeat its name (then the first one counts), which plain
    ``select`` rejects as ambiguous.
    """
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    plain = df.toDF(*[f"c{i}_" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[n]}_").alias(n) for n in names])

