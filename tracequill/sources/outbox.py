"""Batches of events as a data source: a write makes the request bodies of a log store, once each, and a read gives them back.

Each task joins its own lines into bodies of at most `size` events as they come, so no order over all rows and no shuffle is needed, and writes one file. A file counts only once its name stands in the manifest that the
driver writes last, from one message a task; what a lost or retried task left is never named and is cleared at the next overwrite. With dry_run nothing but the counts is written.

Options of a write: path (a folder that all machines share), size (500 events), separator (between lines), ending (after the last one), dry_run. Columns: line, and any others, which are dropped. A null line is left out.
A read gives file, batch, events and body of every batch that was committed; dry runs give none.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "event_batches"
SCHEMA = "file string, batch long, events long, body string"
MANIFEST = "_batches-"


def _folder(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"].removeprefix("file:")
    return (fs.LocalFileSystem(), "/" + path.lstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _read_json(at: fs.FileSystem, path: str) -> dict:
    with at.open_input_stream(path) as f:
        return json.loads(f.read())


def _listed(at: fs.FileSystem, folder: str) -> list[str]:
    return sorted(x.path for x in at.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.is_file)


def manifests(options: dict) -> list[dict]:
    """What each committed write holds: files, events, batches, bytes, dry_run."""
    at, folder = _folder(options)
    return [_read_json(at, p) for p in _listed(at, folder) if p.rsplit("/", 1)[-1].startswith(MANIFEST)]


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    events: int
    batches: int
    size: int


class Outbox(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.size, self.dry = int(options.get("size", 500)), str(options.get("dry_run", "false")).lower() == "true"
        self.separator, self.ending = options.get("separator", "\n"), options.get("ending", "")
        if self.size < 1:
            raise ValueError("size must be at least 1")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, folder = _folder(self.options)
        name, out = f"part-{uuid.uuid4().hex}.jsonl", None
        events = batches = size = 0
        held: list[str] = []

        def flush():
            nonlocal out, events, batches, size
            body = self.separator.join(held) + self.ending
            if not self.dry:
                if out is None:
                    at.create_dir(folder, recursive=True)
                    out = at.open_output_stream(f"{folder}/{name}")
                out.write(json.dumps({"batch": batches, "events": len(held), "body": body}).encode() + b"\n")
            events, batches, size = events + len(held), batches + 1, size + len(body.encode())
            held.clear()

        for rows in iterator:
            for line in rows.column("line").to_pylist():
                if line is not None:
                    held.append(line)
                    if len(held) == self.size:
                        flush()
        if held:
            flush()
        if out is not None:
            out.close()
        return Written(name if out is not None else None, events, batches, size)

    def commit(self, messages: list[Written | None]) -> None:
        at, folder = _folder(self.options)
        done = [m for m in messages if m is not None]
        old = _listed(at, folder) if self.overwrite else []
        at.create_dir(folder, recursive=True)
        files = sorted(m.file for m in done if m.file)
        name = f"{MANIFEST}{uuid.uuid4().hex}.json"
        # named for good only once it is whole
        with at.open_output_stream(f"{folder}/_{name}") as f:
            f.write(json.dumps({"files": files, "events": sum(m.events for m in done), "batches": sum(m.batches for m in done), "bytes": sum(m.size for m in done), "dry_run": self.dry}).encode())
        # the old manifests go first and the old files last, so that no manifest ever names a file that is gone
        new = {f"{folder}/{x}" for x in files}
        stale = [p for p in old if p not in new]
        for p in sorted(stale, key=lambda p: not p.rsplit("/", 1)[-1].startswith(MANIFEST)):
            at.delete_file(p)
        at.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        at, folder = _folder(self.options)
        for m in messages:
            if m is not None and m.file:
                at.delete_file(f"{folder}/{m.file}")


@dataclass
class File(InputPartition):
    name: str


class Batches(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[File]:
        return [File(x) for m in manifests(self.options) for x in m["files"]]

    def read(self, partition: File) -> Iterator[tuple]:
        if not isinstance(partition, File):  # a read of no file has one partition all the same
            return
        at, folder = _folder(self.options)
        with at.open_input_stream(f"{folder}/{partition.name}", buffer_size=1 << 20) as f:
            for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                row = json.loads(line)
                yield partition.name, row["batch"], row["events"], row["body"]


class EventBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batches:
        return Batches(self.options)

    def writer(self, schema, overwrite: bool) -> Outbox:
        return Outbox(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventBatches)
