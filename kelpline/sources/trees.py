"""Python data sources over component directories.

``component_files``: ``spark.read.format("component_files").option("root", ROOT)`` gives one row per
file, folder or link below each component directory: (component, path, kind, mode, size, data,
limitation).  Unlike ``binaryFile`` it has hidden names, does not follow links and has modes.
Kinds: ``f`` file, ``d`` folder, ``l`` link (data: its target), ``g`` and ``h`` repository
metadata and hooks, ``x`` what was not read whole.  Every component directory is its own partition,
read depth first, by name within each folder; the file limit and the byte budget of a component
hold in that order.  A filter ``component = 'x'`` reaches the reader, or names can be given as option
``target``, so other components are not read.  A row without a path only bears a limitation.

``component_directories`` gives one row per name directly under the root: (name, is_link,
is_directory, has_git, manifest, limitation), the input of ``operators.inventory.inspect``.

Neither follows a link in place of a component directory: it has no file rows.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "component string, path string, kind string, mode bigint, size bigint, data binary, limitation string"
DIRECTORY_SCHEMA = "name string, is_link boolean, is_directory boolean, has_git boolean, manifest string, limitation string"
MAX_FILES = 10_000
FILE_BYTES, TOTAL_BYTES, SAMPLE_BYTES, METADATA_BYTES = 16 << 20, 64 << 20, 1 << 20, 1 << 20
HEAD_FILES = ("config", "HEAD", "packed-refs")
MANIFEST = "manifest.json"
#: Tasks that read manifests.
LISTING_TASKS = 64


class ComponentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "component_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ComponentReader(self.options)


class ComponentReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["root"]
        #: Only these components, as a name or several with "/" between them, which no name has.
        self.target = options.get("target") and options["target"].split("/")
        given = {name: options.get(key) for name, key in (("files", "maxFiles"), ("file", "fileBytes"), ("total", "totalBytes"), ("sample", "sampleBytes"))}
        self.limits = {name: int(value) for name, value in given.items() if value is not None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("component",):
                self.target = [n for n in [f.value] if self.target is None or n in self.target]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in names_below(self.root) if self.target is None or n in self.target] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            folder = os.path.join(self.root, partition.value)
            if not os.path.islink(folder) and os.path.isdir(folder):
                for row in Walk(**self.limits).rows(folder, ""):
                    yield (partition.value, *row)


class ComponentDirectories(DataSource):
    @classmethod
    def name(cls) -> str:
        return "component_directories"

    def schema(self) -> str:
        return DIRECTORY_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DirectoryReader(self.options)


class DirectoryReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["root"]

    def partitions(self) -> list[InputPartition]:
        names = names_below(self.root)
        return [InputPartition(names[i::LISTING_TASKS]) for i in range(min(LISTING_TASKS, len(names)))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.value:
            place = os.path.join(self.root, name)
            link = os.path.islink(place)
            manifest, limitation = None, None
            if not link:
                try:
                    with open(os.path.join(place, MANIFEST), "rb") as f:
                        data = f.read(METADATA_BYTES + 1)
                    if len(data) > METADATA_BYTES:
                        limitation = "manifest_too_large"
                    else:
                        manifest = data.decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    limitation = "manifest_unavailable"
            yield name, link, not link and os.path.isdir(place), not link and os.path.exists(os.path.join(place, ".git")), manifest, limitation


def names_below(folder: str) -> list[str]:
    """Names in *folder* in byte order; none if it cannot be read."""
    try:
        return sorted(os.listdir(folder), key=os.fsencode)
    except OSError:
        return []


class Walk:
    """One walk below a component directory: its budgets are used up in the order of visit.

    Of at most *files* rows, files are read whole while *total* bytes last.  A file larger than *file*,
    or than what is left, is only sampled (kind x, data: a digest of size, head and tail);
    what the sample read is charged, even where it goes beyond what was left.  Once nothing is left, files are not
    opened at all (kind x, data: their size).
    """

    def __init__(self, files: int = MAX_FILES, file: int = FILE_BYTES, total: int = TOTAL_BYTES, sample: int = SAMPLE_BYTES):
        self.files, self.file, self.total, self.sample = files, file, total, sample
        self.seen = self.used = 0

    def rows(self, folder: str, prefix: str) -> Iterator[tuple]:
        """(path, kind, mode, size, data, limitation)."""
        try:
            names = sorted(os.listdir(folder), key=os.fsencode)
        except OSError:
            yield _only("unreadable_directory")
            return
        for name in names:
            if self.seen >= self.files:
                yield _only("file_limit")
                return
            place = os.path.join(folder, name)
            path = (f"{prefix}/{name}" if prefix else name).replace("\\", "/")
            for row in self.below(place, name, path):
                self.seen += row[0] is not None
                yield row
            if self.is_folder(place, name):
                yield from self.rows(place, path)

    @staticmethod
    def is_folder(place: str, name: str) -> bool:
        return name != ".git" and not os.path.islink(place) and os.path.isdir(place)

    def below(self, place: str, name: str, path: str) -> Iterator[tuple]:
        try:
            info = os.lstat(place)
        except OSError:
            yield _only("metadata_unavailable")
            return
        mode = info.st_mode
        if name == ".git":
            if os.path.isdir(place):
                yield from git_metadata(place, path)
            else:
                yield path, "g", mode, info.st_size, head_of(place), None
        elif stat.S_ISLNK(mode):
            yield path, "l", mode, info.st_size, os.fsencode(os.readlink(place)), None
        elif stat.S_ISDIR(mode):
            yield path, "d", mode, None, b"", None
        elif stat.S_ISREG(mode):
            yield (path, *self.content(place, mode, info.st_size))
        else:
            yield path, "x", mode, None, b"", "special_file"

    def content(self, place: str, mode: int, size: int) -> tuple:
        """(kind, mode, size, data, limitation) of a regular file, charged to the budget."""
        left = self.total - self.used
        if left <= 0:
            return "x", mode, size, size.to_bytes(8, "big"), "aggregate_byte_limit"
        if size > self.file or size > left:
            data, charged = sampled_digest(place, size, min(self.sample, left))
            self.used += charged
            return "x", mode, size, data, "oversize_file" if size > self.file else "aggregate_byte_limit"
        try:
            with open(place, "rb") as f:
                data = f.read()
        except OSError:
            return "x", mode, size, b"", "unreadable_file"
        self.used += len(data)
        return "f", mode, size, data, None


def _only(limitation: str) -> tuple:
    return None, None, None, None, None, limitation


def head_of(place: str) -> bytes:
    """The first METADATA_BYTES and one more; nothing if it cannot be read."""
    try:
        with open(place, "rb") as f:
            return f.read(METADATA_BYTES + 1)
    except OSError:
        return b""


def git_metadata(folder: str, prefix: str) -> Iterator[tuple]:
    """Configuration and heads of a repository (kind g) and its hooks (kind h); no link in place of the former is followed."""
    for name in HEAD_FILES:
        place = os.path.join(folder, name)
        if os.path.isfile(place) and not os.path.islink(place):
            info = os.lstat(place)
            yield f"{prefix}/{name}", "g", info.st_mode, info.st_size, head_of(place), None
    hooks = os.path.join(folder, "hooks")
    if not os.path.exists(hooks):
        return
    try:
        names = sorted(os.listdir(hooks), key=os.fsencode)
    except OSError:
        yield _only("git_hooks_unreadable")
        return
    for name in names:
        place = os.path.join(hooks, name)
        info = os.lstat(place)
        yield f"{prefix}/hooks/{name}", "h", info.st_mode, info.st_size, head_of(place), None


def sampled_digest(place: str, size: int, sample: int = SAMPLE_BYTES) -> tuple[bytes, int]:
    """(SHA-256 of the size, the first *sample* bytes and, of a file longer than those, half as many last
    ones; bytes read).  Head and tail may overlap."""
    digest, read = hashlib.sha256(size.to_bytes(8, "big")), 0
    try:
        with open(place, "rb") as f:
            parts = [f.read(sample)]
            if size > sample > 1:
                f.seek(-(sample // 2), os.SEEK_END)
                parts.append(f.read(sample // 2))
    except OSError:
        parts = []
    for part in parts:
        digest.update(part)
        read += len(part)
    return digest.digest(), read


def register(spark: SparkSession) -> None:
    """Make the sources known to *spark* and let filters reach them (a reader that takes them needs that)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ComponentFiles)
    spark.dataSource.register(ComponentDirectories)
