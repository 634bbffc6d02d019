"""Small driver-side state: versioned JSON documents, locks, reports, notifications."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import platform
import tempfile
import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


class StateError(ValueError):
    """A state document that is malformed or of another version."""


class LockBusy(RuntimeError):
    """Another process holds the lock."""


def load(path: str, empty: Callable[[], dict]) -> dict:
    """The document at *path*; *empty()* if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
    except FileNotFoundError:
        return empty()
    except ValueError as e:
        raise StateError(str(e)) from e
    if not isinstance(value, dict) or value.get("schema_version") != VERSION:
        raise StateError(f"not a document of version {VERSION}")
    return value


def load_or_quarantine(path: str, empty: Callable[[], dict]) -> tuple[dict, str | None]:
    """(document, None), or (empty, place of the broken one, moved aside)."""
    try:
        return load(path, empty), None
    except StateError:
        aside = f"{path}.corrupt-{time.time_ns()}"
        os.replace(path, aside)
        return empty(), aside


def save(path: str, value: dict) -> None:
    """Replace the document at once."""
    replace(path, json.dumps(value, indent=2, sort_keys=True).encode())


def replace(path: str, data: bytes) -> None:
    """Replace a file at once: written beside, flushed, private, renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(beside, 0o600)
        os.replace(beside, path)
        where = os.open(folder, os.O_RDONLY)
        try:
            os.fsync(where)
        finally:
            os.close(where)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(beside)
        raise


@contextlib.contextmanager
def lock(path: str, tries: int = 20, wait: float = 0.025) -> Iterator[None]:
    """Exclusive between processes for the time of the block; LockBusy if it can't be had."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a") as f:
        for k in range(tries):
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if k == tries - 1:
                    raise LockBusy(path) from None
                time.sleep(wait)
        yield


def report(result: Any, generated_at: str, tool_version: str) -> str:
    """JSON envelope around a result."""
    body = {"schema": "kelpline.report.v1", "tool_version": tool_version, "generated_at": generated_at, "result": result}
    return json.dumps(body, indent=2, ensure_ascii=False)


def commit_signals(path: str, fresh: DataFrame, state: DataFrame, notify: Callable[[str], None] = lambda key: None) -> int:
    """Notify of each new key and save the next state (both must be bounded: signals are
    kept per key, and *fresh* and *state* are read with toLocalIterator).  Returns the
    number of new signal rows."""
    seen: set[str] = set()
    rows = 0
    for row in fresh.select("key").toLocalIterator():
        rows += 1
        if row.key not in seen:
            seen.add(row.key)
            notify(row.key)
    save(path, {"schema_version": VERSION, "alerts": {r.key: r.emitted_at for r in state.toLocalIterator()}})
    return rows


def exit_code(outstanding: int, new: int, only_new: bool = False) -> int:
    """3 if there are findings (new ones under *only_new*), else 0."""
    return 3 if (new if only_new else outstanding) else 0


def folder_for(kind: str, environment: Mapping[str, str], home: str, name: str = "kelpline") -> str:
    """Where *kind* ('state', 'cache', 'config' or 'data') is kept: below the folder of the environment
    if that is absolute, else below its usual place in *home*."""
    variable, usual = {
        "state": ("XDG_STATE_HOME", ".local/state"),
        "cache": ("XDG_CACHE_HOME", ".cache"),
        "config": ("XDG_CONFIG_HOME", ".config"),
        "data": ("XDG_DATA_HOME", ".local/share"),
    }[kind]
    named = environment.get(variable, "")
    return os.path.join(named if os.path.isabs(named) else os.path.join(home, usual), name)


def provenance(spark: SparkSession, version: str, limitations: list[str]) -> DataFrame:
    """One row on what made a result: schema, tool, version, versions of Spark and Python, known limitations of coverage."""
    row = ("kelpline.provenance.v1", "kelpline", version, spark.version, platform.python_version(), limitations)
    return spark.createDataFrame([row], "schema string, tool string, version string, spark string, python string, coverage_limitations array<string>")
