"""All queries outside the subpackage ``llm``, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpline.plans import general, trust


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return general.QUERIES | trust.QUERIES


def oracles() -> dict[str, str]:
    return general.ORACLES | trust.ORACLES
