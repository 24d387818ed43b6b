"""A data source of metrics as JSON lines, with a commit: `df.write.format("metric-lines")` and `spark.read.format("metric-lines")`.

Every task writes a staged file of its own and hands its name over in its commit message. The commit moves the files of
the tasks that count into place and then writes a list of them, which makes the write visible at once. A task that is retried,
or run twice, adds no line twice, as only one of its messages reaches the commit; a write that fails leaves nothing visible, and its
staged files are removed. Readers see the files of the lists only.

The folder ("path") has to be one that the driver and all executors share; it may be a local path or a URI that
pyarrow's file systems open. Rows: step long, name string, value double; nulls are kept. Overwriting removes
the lists before it with the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "step long, name string, value double"
STAGED, LISTS = "_staged", "_lists"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    lines: int


@dataclass
class Part(InputPartition):
    file: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.File)


class MetricLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metric-lines"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MetricWriter(self.options["path"], schema.names, overwrite)

    def reader(self, schema: StructType) -> DataSourceReader:
        return MetricReader(self.options["path"])


class MetricWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        missing = {"step", "name", "value"} - set(names)
        if missing:
            raise ValueError(f"metrics need the columns {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = _opened(self.path)
        folder = f"{base}/{STAGED}/{self.job}"
        store.create_dir(folder, recursive=True)
        file, lines = f"{folder}/{uuid.uuid4().hex}.jsonl", 0  # an attempt's own
        with store.open_output_stream(file) as out:
            for row in iterator:
                out.write(json.dumps({k: row[k] for k in ("step", "name", "value")}, ensure_ascii=False).encode() + b"\n")
                lines += 1
        return Written(file if lines else None, lines)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _opened(self.path)
        store.create_dir(f"{base}/{LISTS}", recursive=True)
        before = _names(store, f"{base}/{LISTS}")
        made = []
        for k, m in enumerate(m for m in messages if m is not None and m.file):
            store.move(m.file, f"{base}/{self.job}-{k:05d}.jsonl")
            made.append(f"{self.job}-{k:05d}.jsonl")
        new = {"files": made, "lines": sum(m.lines for m in messages if m is not None), "replaces": [p.rsplit("/", 1)[1] for p in before] if self.overwrite else []}
        with store.open_output_stream(f"{base}/{STAGED}/{self.job}.json") as out:
            out.write(json.dumps(new).encode())
        store.move(f"{base}/{STAGED}/{self.job}.json", f"{base}/{LISTS}/{self.job}.json")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, base = _opened(self.path)
        folder = f"{base}/{STAGED}/{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def committed(path: str) -> list[str]:
    """The files of all writes that were committed and not replaced since."""
    store, base = _opened(path)
    lists = {}
    for p in _names(store, f"{base}/{LISTS}"):
        with store.open_input_stream(p) as given:
            lists[p.rsplit("/", 1)[1]] = json.loads(given.read())
    gone = {name for x in lists.values() for name in x["replaces"]}
    return [f"{base}/{f}" for name, x in sorted(lists.items()) if name not in gone for f in x["files"]]


class MetricReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(f) for f in committed(self.path)] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.file:
            store, _ = _opened(self.path)
            with store.open_input_stream(partition.file) as given:
                rest = b""
                while chunk := given.read(1 << 20):
                    *lines, rest = (rest + chunk).split(b"\n")
                    for x in map(json.loads, lines):
                        yield (x["step"], x["name"], x["value"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetricLines)
