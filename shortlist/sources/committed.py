"""A Spark data source of JSON lines that count only once they are committed: ``format("committed_lines")``.

Each task writes one file under a name of its own. The files of a write count when the driver has put a manifest
beside them that names them; a reader sees what manifests name, so a failed task or a lost job
leaves nothing to be read, and what an aborted write left is deleted. A batch of a stream has a manifest
named by the stream and the batch, so that a batch that is replayed takes the place of its first try.

    spark.dataSource.register(CommittedLines)
    df.write.format("committed_lines").mode("append").save(path)            # or mode("overwrite")
    df.writeStream.format("committed_lines").option("checkpointLocation", ..).start(path)
    spark.read.format("committed_lines").schema("place long, line string").load(path)

Paths are those of the stores that Arrow knows (file, hdfs, s3, gs). Values are those of JSON: times and
decimals travel as text, bytes are not taken. Texts, whole numbers and booleans are written by Arrow batches, and
read so where the manifest says that they were written with the types that are asked for; all else goes row by row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

MANIFESTS, DATA = "_manifests", "data"
#: Types that are written and read by batches.
PLAIN = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_encode = json.JSONEncoder(ensure_ascii=False).encode


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File)


def _kinds(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def _plain(schema: T.StructType) -> bool:
    """Whether all columns are of ``PLAIN`` types, with names of their own."""
    kinds = _kinds(schema)
    return 0 < len(kinds) == len(schema.fields) and set(kinds.values()) <= set(PLAIN)


def _values(column: pa.Array) -> pa.Array:
    """The JSON of each value."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        different = column.dictionary_encode()
        text = pa.array([_encode(x) for x in different.dictionary.to_pylist()], pa.large_string()).take(different.indices)
    else:
        text = column.cast(pa.large_string())
    return text.fill_null("null")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writing:
    """What a batch write and a batch of a stream have in common."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.columns, self.kinds = path, schema.names, _kinds(schema)

    def lines(self, rows: Iterator) -> Iterator[tuple[int, bytes]]:
        """(number of lines, their bytes)."""
        for row in rows:
            values = row.asDict(recursive=True)
            yield 1, json.dumps({c: values[c] for c in self.columns}, default=str, ensure_ascii=False).encode() + b"\n"

    def write(self, rows: Iterator) -> Written:
        store, base = _store(self.path)
        store.create_dir(f"{base}/{DATA}")
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{base}/{DATA}/{name}") as out:
            for size, text in self.lines(rows):
                out.write(text)
                n += size
        return Written(name, n)

    def publish(self, messages: list, name: str, replace: bool = False) -> None:
        store, base = _store(self.path)
        folder = f"{base}/{MANIFESTS}"
        store.create_dir(folder)
        before = [x for x in _names(store, folder) if x.endswith(".json") and (replace or x == f"{name}.json")]
        old = [f for x in before for f in _read(store, f"{folder}/{x}")["files"]]
        with store.open_output_stream(f"{folder}/{name}.new") as out:
            out.write(json.dumps({"files": [m.file for m in messages if m and m.rows], "kinds": self.kinds}).encode())
        store.move(f"{folder}/{name}.new", f"{folder}/{name}.json")
        for x in before:
            if x != f"{name}.json":
                store.delete_file(f"{folder}/{x}")
        self.drop([*old, *[m.file for m in messages if m and not m.rows]])

    def drop(self, files: list[str]) -> None:
        store, base = _store(self.path)
        for f in files:
            if store.get_file_info(f"{base}/{DATA}/{f}").type == fs.FileType.File:
                store.delete_file(f"{base}/{DATA}/{f}")


class _ByBatches(_Writing):
    """The same lines of plain columns, from Arrow batches."""

    def lines(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in rows:
            if not batch.num_rows:
                continue
            parts = []
            for i, c in enumerate(self.columns):
                parts += [f"{', ' if i else '{'}{_encode(c)}: ", _values(batch.column(i))]
            joined = pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in [*parts, "}\n", ""]])
            yield batch.num_rows, joined.buffers()[2].slice(0, pc.sum(pc.binary_length(joined)).as_py())


def _read(store: fs.FileSystem, manifest: str) -> dict:
    with store.open_input_stream(manifest) as f:
        return json.loads(f.read())


class LinesWriter(_Writing, DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        super().__init__(path, schema)
        self.overwrite = overwrite

    def commit(self, messages: list) -> None:
        self.publish(messages, uuid.uuid4().hex, self.overwrite)

    def abort(self, messages: list) -> None:
        self.drop([m.file for m in messages if m])


class LinesStreamWriter(_Writing, DataSourceStreamWriter):
    def __init__(self, path: str, schema: T.StructType, run: str):
        super().__init__(path, schema)
        self.run = run

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, f"{self.run}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.drop([m.file for m in messages if m])


class ArrowLinesWriter(_ByBatches, LinesWriter, DataSourceArrowWriter):
    pass


class ArrowLinesStreamWriter(_ByBatches, LinesStreamWriter, DataSourceStreamArrowWriter):
    pass


class LinesReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        store, base = _store(self.path)
        folder, wanted, found = f"{base}/{MANIFESTS}", _kinds(self.schema), []
        for x in _names(store, folder):
            if x.endswith(".json"):
                manifest = _read(store, f"{folder}/{x}")
                kinds = manifest.get("kinds")  # none in manifests of before
                batches = _plain(self.schema) and kinds is not None and all(kinds.get(c, k) == k for c, k in wanted.items())
                found += [InputPartition((f, batches)) for f in manifest["files"]]
        return found or [InputPartition(None)]

    def _blocks(self, file: str) -> Iterator[bytes]:
        """The file by blocks of whole lines."""
        store, base = _store(self.path)
        with store.open_input_stream(f"{base}/{DATA}/{file}") as raw:
            kept = []
            while block := raw.read(1 << 20):
                end = block.rfind(b"\n") + 1
                if end:
                    yield b"".join([*kept, block[:end]])
                    kept = []
                kept.append(block[end:])

    def read(self, partition: InputPartition) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        file, batches = partition.value
        schema = pa.schema([(c, PLAIN[k]) for c, k in _kinds(self.schema).items()]) if batches else None
        for block in self._blocks(file):
            if batches:
                options = pyarrow.json.ReadOptions(use_threads=False, block_size=len(block) + 1)
                table = pyarrow.json.read_json(pa.BufferReader(block), options, pyarrow.json.ParseOptions(explicit_schema=schema, newlines_in_values=False, unexpected_field_behavior="ignore"))
                yield from table.select(schema.names).to_batches()
                continue
            for line in block[:-1].split(b"\n"):
                row = json.loads(line)
                yield tuple(row.get(c) for c in self.schema.names)


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def schema(self) -> str:
        return "place long, line string"

    def reader(self, schema: T.StructType) -> LinesReader:
        return LinesReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> LinesWriter:
        return (ArrowLinesWriter if _plain(schema) else LinesWriter)(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> LinesStreamWriter:  # noqa: N802
        place = self.options.get("checkpointLocation") or self.options.get("checkpointlocation")
        if not place:
            raise ValueError("give the stream its own checkpointLocation: it names the batches")
        return (ArrowLinesStreamWriter if _plain(schema) else LinesStreamWriter)(self.options["path"], schema, hashlib.sha256(place.encode()).hexdigest()[:16])
