"""The published chunk set as a data source: what the manifest names, and nothing else.

A set is a folder ``set-<id>`` below the published folder. ``jobs_manifest.json`` names the set
in force and the lists (one a writing task) with the set's chunks, a row each. Writing stages
a whole new set and then replaces the manifest, so readers see the old set or the new one.
Documents with a plain ``chunks`` array, as other publishers write them, are read as well.

Paths are opened with pyarrow's file systems (local or shared folders, hdfs, s3, gs).
"""

import gzip
import json
import os
import sys
import uuid
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "job_chunks"
MANIFEST_NAME = "jobs_manifest.json"
NAMES = "names.jsonl"
SCHEMA = "chunk string, value string"
#: Rows that a reading task takes at least, where that leaves so many tasks, and rows of a chunk whose list does not tell.
PART_ROWS, LEAST_PARTS, USUAL_ROWS = 100_000, 64, 25_000


def opened(path):
    """File system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _kind(fs, path):
    return fs.get_file_info(path).type


def _only_file(fs, path):
    """The path itself, or the one data file of a folder that Spark wrote."""
    if _kind(fs, path) != pafs.FileType.Directory:
        return path
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("part-")]
    return min(files, default=f"{path}/{MANIFEST_NAME}")


def _read(fs, path):
    with fs.open_input_stream(path, compression=None) as file:
        return file.read()


def manifest_of(folder):
    """The manifest in force as a dict; empty where there is none."""
    fs, root = opened(folder)
    path = _only_file(fs, f"{root}/{MANIFEST_NAME}")
    if _kind(fs, path) != pafs.FileType.File:
        return {}
    return json.loads(_read(fs, path) or b"{}")


def named_chunks(folder):
    """(name, path below the folder, rows where they are known) of every chunk that the manifest names."""
    fs, root = opened(folder)
    manifest = manifest_of(folder)
    for name in manifest.get("chunks") or []:
        yield name, name, None
    for names in manifest.get("lists") or []:
        for line in _read(fs, f"{root}/{names}").splitlines():
            row = json.loads(line)
            yield row["name"], row["path"], row.get("rows")


@dataclass
class Chunks(InputPartition):
    named: list


class ChunkReader(DataSourceReader):
    """Partitions of chunks that the manifest names, one each or as many as have enough rows; an absent chunk has no rows."""

    def __init__(self, folder):
        self.folder = folder

    def partitions(self):
        named = [(name, path, USUAL_ROWS if rows is None else rows) for name, path, rows in named_chunks(self.folder)]
        enough = min(PART_ROWS, sum(rows for *_, rows in named) / LEAST_PARTS)
        parts, held = [], enough
        for name, path, rows in named:
            if held >= enough:
                parts.append(Chunks([]))
                held = 0
            parts[-1].named.append((name, path))
            held += rows
        return parts or [Chunks([])]

    def read(self, partition):
        fs, root = opened(self.folder)
        for name, below in partition.named:
            path = next((p for p in (f"{root}/{below}", f"{root}/name={below}") if below and _kind(fs, p) != pafs.FileType.NotFound), None)
            if path is None:
                continue
            raw = _read(fs, _only_file(fs, path))
            text = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text.decode()])], ["chunk", "value"])


@dataclass
class Staged(WriterCommitMessage):
    names: str | None
    chunks: int
    rows: int


class ChunkWriter(DataSourceArrowWriter):
    """Rows ``chunk`` (number) and ``line`` (JSON), each chunk whole and in order in one task, as gzip JSON arrays.

    Lines stream into the file, so a task holds no chunk. Files carry the task's attempt in
    their path: what a lost or doubled attempt leaves behind is in no list.
    """

    def __init__(self, folder, last_updated):
        self.folder, self.last_updated = folder, last_updated
        self.staged = f"set-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, root = opened(self.folder)
        below = f"{self.staged}/{TaskContext.get().taskAttemptId()}"
        written, file = [], None

        def close():
            file.write(b"]")
            file.close()

        try:
            for batch in iterator:
                for number, rows in groupby(zip(batch["chunk"].to_pylist(), batch["line"].cast(pa.binary()).to_pylist()), itemgetter(0)):
                    lines = [line for _, line in rows]
                    name = f"jobs_chunk_{number}.json.gz"
                    if not written or written[-1]["name"] != name:
                        if file:
                            close()
                        if any(row["name"] == name for row in written[:-1]):
                            raise ValueError(f"{name} comes twice in one task: sort the rows by chunk")
                        fs.create_dir(f"{root}/{below}", recursive=True)
                        written.append({"name": name, "path": f"{below}/{name}", "rows": 0})
                        file = gzip.GzipFile(fileobj=fs.open_output_stream(f"{root}/{below}/{name}", compression=None), mode="wb", mtime=0)
                        file.write(b"[" + b",\n".join(lines))
                    else:
                        file.write(b",\n" + b",\n".join(lines))
                    written[-1]["rows"] += len(lines)
            if file:
                close()
        finally:
            if file and file.fileobj:
                file.fileobj.close()
        if not written:
            return Staged(None, 0, 0)
        with fs.open_output_stream(f"{root}/{below}/{NAMES}") as names:
            names.write("".join(json.dumps(row) + "\n" for row in written).encode())
        return Staged(f"{below}/{NAMES}", len(written), sum(row["rows"] for row in written))

    def commit(self, messages):
        """Put the staged set in force and drop the one before the last."""
        fs, root = opened(self.folder)
        done = [m for m in messages if m is not None and m.names]
        before = manifest_of(self.folder)
        manifest = {
            "set": self.staged, "previous": before.get("set"), "lists": sorted(m.names for m in done),
            "chunkCount": sum(m.chunks for m in done), "totalJobs": sum(m.rows for m in done), "last_updated": self.last_updated,
        }
        fs.create_dir(root, recursive=True)
        draft, path = f"{root}/_{self.staged}.json", f"{root}/{MANIFEST_NAME}"
        with fs.open_output_stream(draft) as file:
            file.write(json.dumps(manifest).encode())
        if _kind(fs, path) == pafs.FileType.Directory:
            fs.delete_dir(path)
        try:
            fs.move(draft, path)  # replaces the old file at once where the file system can
        except OSError:
            fs.delete_file(path)
            fs.move(draft, path)
        if before.get("previous"):
            _drop(fs, f"{root}/{before['previous']}")

    def abort(self, messages):
        fs, root = opened(self.folder)
        _drop(fs, f"{root}/{self.staged}")


def _drop(fs, path):
    if _kind(fs, path) == pafs.FileType.Directory:
        fs.delete_dir(path)


class ChunkSet(DataSource):
    """``spark.read.format("job_chunks").load(folder)``: a row for each chunk with its document."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ChunkReader(self.options["path"])

    def writer(self, schema, overwrite):
        if not overwrite:
            raise ValueError("a chunk set is replaced as a whole: write it with mode overwrite")
        return ChunkWriter(self.options["path"], self.options.get("last_updated"))


def register(spark):
    spark.dataSource.register(ChunkSet)
    return spark


# the classes travel with the job, so that workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
