"""A data source that writes one file per row, under the name that the row gives.

Each file is written aside and moved to its name when it is complete. Tasks list what they saved in a file of their own,
and their commit messages name these lists and their counts; so nothing is listed to learn what exists, and no more than one
small message of each task reaches the driver. Files that are there already are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from veriform.sources.folder import file_system, shown

# Names that no file can have; a longer one than most systems allow fails when it is written.
_FORBIDDEN = ("", ".", "..")


@dataclass
class Saved(WriterCommitMessage):
    """List of one task, and how many files it saved and could not save."""

    listed: str
    saved: int
    failed: int


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, lists: str):
        self.folder, self.lists = folder, lists

    def save(self, system, at: str, name: str | None, data: bytes) -> str | None:
        """Why a file is not there, or None."""
        from pyarrow import fs

        if name is None or name in _FORBIDDEN or "/" in name or "\0" in name:
            return "no file name"
        path = f"{at}/{name}"
        try:
            there = system.get_file_info(path)
            if there.type != fs.FileType.NotFound:
                if there.type == fs.FileType.File and there.size == len(data):
                    with system.open_input_stream(path, compression=None) as f:
                        if f.read() == data:  # a task that runs again meets its own files
                            return None
                return "exists"
            aside = f"{at}/.{uuid.uuid4().hex}"
            with system.open_output_stream(aside, compression=None) as f:
                f.write(data)
            try:
                system.move(aside, path)
            except OSError:
                system.delete_file(aside)
                raise
        except OSError as e:
            return str(e) or type(e).__name__
        return None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Saved:
        system, at = file_system(self.folder)
        lists_system, lists_at = file_system(self.lists)
        system.create_dir(at, recursive=True)
        lists_system.create_dir(lists_at, recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        saved = failed = 0
        with lists_system.open_output_stream(f"{lists_at}/.{name}", compression=None) as out:
            for batch in iterator:
                for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    error = self.save(system, at, file, data or b"")
                    saved, failed = saved + (error is None), failed + (error is not None)
                    path = shown(self.folder, file) if error is None else None
                    out.write((json.dumps({"output_name": file, "path": path, "error": error}) + "\n").encode())
        lists_system.move(f"{lists_at}/.{name}", f"{lists_at}/{name}")
        return Saved(name, saved, failed)

    def commit(self, messages: list[Saved | None]) -> None:
        """Names the lists that count: those of tasks that were repeated are not among them."""
        system, at = file_system(self.lists)
        system.create_dir(at, recursive=True)
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{at}/_lists.json", compression=None) as f:
            f.write(json.dumps({"lists": [m.listed for m in done], "saved": sum(m.saved for m in done), "failed": sum(m.failed for m in done)}).encode())

    def abort(self, messages: list[Saved | None]) -> None:
        """Files that were saved stay; the next run meets them."""


class NamedFiles(DataSource):
    """Options: ``path`` (the folder of the files), ``lists`` (a folder for the lists of this run). Columns: a name and the content, as binary."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "output_name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("files that are there are kept; use append")
        return NamedFilesWriter(self.options["path"], self.options["lists"])


def committed(lists: str) -> dict:
    """``lists``, ``saved``, ``failed`` of a finished run."""
    system, at = file_system(lists)
    with system.open_input_stream(f"{at}/_lists.json", compression=None) as f:
        return json.loads(f.read())
