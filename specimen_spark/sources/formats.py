"""A user's own file format as a data source: ``spark.read.format(name)`` and ``df.write.format(name)``.

A format says how the lines of a file become sequences and how sequences become lines.  Reading plans
one task for each file.  Writing is by tasks into a folder of their own and takes effect with the commit
alone: what failed or was run twice leaves nothing behind.  Paths may be of any file system that
Arrow opens.
"""

from __future__ import annotations

import io
import os
import sys
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, ord long, title string, seq string"


class SequenceFormat(ABC):
    """Lines to sequences and back."""

    #: What the format is called in Spark.
    name: str
    #: What names of files that are written end with.
    ending = ".txt"

    @abstractmethod
    def read(self, lines: Iterator[str]) -> Iterator[tuple[str, str]]:
        """(title, seq) of a file's lines, in order."""

    def lines(self, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
        """The lines of a file that holds (title, seq)."""
        raise ValueError(f"files of the format {self.name} can't be written")


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


def _place(options: dict) -> tuple[fs.FileSystem, str]:
    path = options.get("path")
    if not path:
        raise ValueError("the format needs a path")
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class _Reader(DataSourceReader):
    def __init__(self, form: SequenceFormat, options: dict):
        self.form, self.options = form, dict(options)

    def partitions(self) -> list[_File]:
        system, path = _place(self.options)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.is_file:
            return [_File(path)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and not x.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, _ = _place(self.options)
        with system.open_input_stream(partition.path) as raw:
            text = io.TextIOWrapper(raw, "utf-8", "replace")
            for i, (title, seq) in enumerate(self.form.read(line.rstrip("\n") for line in text)):
                yield os.path.basename(partition.path), i, title, seq


class _Writer(DataSourceWriter):
    def __init__(self, form: SequenceFormat, options: dict, columns: list[str], overwrite: bool):
        self.form, self.options, self.overwrite = form, dict(options), overwrite
        self.at = columns.index("title"), columns.index("seq")
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        system, path = _place(self.options)
        task = TaskContext.get()
        system.create_dir(f"{path}/{self.staged}", recursive=True)
        # an attempt has a name of its own: only those that the commit hears of are kept
        name, count = f"{path}/{self.staged}/part-{task.partitionId():06d}-{task.taskAttemptId()}{self.form.ending}", 0

        def counted() -> Iterator[tuple[str, str]]:
            nonlocal count
            for row in iterator:
                count += 1
                yield row[self.at[0]], row[self.at[1]]

        with system.open_output_stream(name) as out:
            for line in self.form.lines(counted()):
                out.write(line.encode() + b"\n")
        return _Written(name, count)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = _place(self.options)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.is_file:
                    system.delete_file(old.path)
        run = uuid.uuid4().hex[:8]
        for done in messages:
            if done is None:
                continue
            if done.rows:
                part = os.path.basename(done.path).split("-")[1]
                system.move(done.path, f"{path}/part-{part}-{run}{self.form.ending}")
        self._clear(system, path)
        with system.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_place(self.options))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.staged}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.staged}")


def register(spark: SparkSession, form: SequenceFormat) -> None:
    """Makes a format known to the session under its name; reading gives file, ord, title and seq.

    The module that defines the format travels to the executors, which need no copy of it.
    """
    cloudpickle.register_pickle_by_value(sys.modules[type(form).__module__])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return form.name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(form, self.options)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(form, self.options, schema.names, overwrite)

    spark.dataSource.register(Source)


class Tabbed(SequenceFormat):
    """A line for each sequence: its title, a tab, and its residues."""

    name, ending = "tabbed", ".tab"

    def read(self, lines: Iterator[str]) -> Iterator[tuple[str, str]]:
        for line in lines:
            if line.strip():
                title, _, seq = line.partition("\t")
                yield title, seq.replace(" ", "").upper()

    def lines(self, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
        for title, seq in rows:
            yield f"{' '.join(title.split())}\t{seq}"
