"""A data source of whole files: one row per file, with an error where a file cannot be read.

``spark.read.format("whole_files").option("pattern", "*.txt").load(folder)``. The folder is listed without opening
files; files are dealt in groups of about ``group_bytes`` to tasks, which open them. A file that fails
is a row of its group, so it stops no other file, and nothing has to be joined or moved to find out which ones failed.
"""

from __future__ import annotations

import fnmatch
import json
import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: the error of a file that cannot be read.
UNREADABLE = "Could not load file"
SCHEMA = "file_path string, file_size long, content binary, error string"
GROUP_BYTES = 64 << 20
# What opening a file counts for, so that groups of many small files stay small.
OPEN_BYTES = 1 << 16
# Content handed on at once.
BATCH_BYTES = 32 << 20


def file_system(path: str):
    """File system of a path or URI, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest.startswith("/") or "/" in scheme:
        plain = rest if scheme == "file" else path
        return fs.LocalFileSystem(), "/" + plain.lstrip("/") if scheme == "file" else plain
    return fs.FileSystem.from_uri(path)


def shown(folder: str, name: str) -> str:
    """Path of a file as Spark's own sources show it."""
    scheme = folder.partition(":")[0]
    base = folder.rstrip("/")
    if scheme == "file":
        base = "file:/" + base[5:].lstrip("/")
    elif "/" in scheme or scheme == folder:
        base = "file:" + base
    return f"{base}/{name}"


@dataclass
class Group(InputPartition):
    """Names of files, their sizes as listed, all in one folder."""

    names: list[str]
    sizes: list[int]


def _fits_sums(data: bytes, sums: bytes) -> bool:
    """Whether a file is what the checksums beside it say: a head of 8 bytes with the block size, then a CRC32 of each block."""
    if sums[:4] != b"crc\0":
        return True
    block = int.from_bytes(sums[4:8], "big")
    return all(zlib.crc32(data[i : i + block]) == int.from_bytes(sums[at : at + 4], "big")
               for i, at in zip(range(0, len(data), block), range(8, 8 + 4 * len(data), 4), strict=False))


class FolderReader(DataSourceReader):
    def __init__(self, folder: str, pattern: str, group_bytes: int, asked: list[str]):
        self.folder, self.pattern, self.group_bytes, self.asked = folder, pattern, group_bytes, asked

    def partitions(self) -> list[Group]:
        # Names that begin as those of hidden files are left out.
        files = sorted((name, size) for name, size in self.listed() if name[0] not in "._" and fnmatch.fnmatchcase(name, self.pattern))
        files += [(name, 0) for name in dict.fromkeys(self.asked) if name not in dict(files)]
        groups, room = [], 0
        for name, size in files:
            if not groups or room < size:
                groups.append(Group([], []))
                room = self.group_bytes
            groups[-1].names.append(name)
            groups[-1].sizes.append(size)
            room -= size + OPEN_BYTES
        return groups or [Group([], [])]

    def listed(self) -> Iterator[tuple[str, int]]:
        """Names and sizes of what is no folder; a link that leads nowhere is a file that cannot be read."""
        from pyarrow import fs

        system, at = file_system(self.folder)
        if isinstance(system, fs.LocalFileSystem):
            with os.scandir(at) as entries:
                for e in entries:
                    if not e.is_dir():
                        yield e.name, e.stat().st_size if e.is_file() else 0
        else:
            for f in system.get_file_info(fs.FileSelector(at, recursive=False)):
                if f.type != fs.FileType.Directory:
                    yield f.base_name, f.size or 0

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, at = file_system(self.folder)
        rows, held = [], 0
        for name, size in zip(partition.names, partition.sizes, strict=True):
            content, error = None, None
            try:
                with system.open_input_stream(f"{at}/{name}", compression=None) as f:
                    content = f.read()
                try:
                    with system.open_input_stream(f"{at}/.{name}.crc", compression=None) as f:
                        sums = f.read()
                except OSError:
                    sums = b""
                if not _fits_sums(content, sums):
                    content, error = None, UNREADABLE
            except OSError:
                error = UNREADABLE
            rows.append((shown(self.folder, name), size if content is None else len(content), content, error))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file_path", "file_size", "content", "error"])


class WholeFiles(DataSource):
    """Options: ``path`` (the folder), ``pattern`` (shell pattern of names, default all), ``group_bytes``, and ``asked``: a JSON
    list of names that must have a row, whether they are there or not."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("group_bytes", GROUP_BYTES)), json.loads(self.options.get("asked", "[]")))


_REGISTERED: set[str] = set()


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes a data source known to a session, once."""
    key = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}/{source.name()}"
    if key not in _REGISTERED:
        spark.dataSource.register(source)
        _REGISTERED.add(key)


def read_files(spark: SparkSession, folder: str, pattern: str = "*", asked: Sequence[str] = (), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Files of a folder that match a pattern, and a row for each name in ``asked`` besides: see :data:`SCHEMA`."""
    register(spark, WholeFiles)
    return spark.read.format(WholeFiles.name()).option("pattern", pattern).option("group_bytes", group_bytes).option("asked", json.dumps(list(asked))).load(folder)
