"""The Spark format `captures`: bundles of captured state as a batch or a stream, and written documents as files.

A bundle is a text of JSON lines, plain or with gzip, below `path`; each line is a row of one captured table and names it:
{"table": "net_bodies", "capture_id": ..., ...}. Folders may be named kind=report and so on; such a folder holds captures of
that kind only. Files and folders whose names begin with _ or . are passed over. Paths are those that pyarrow.fs reaches.

    register(spark)
    bodies = spark.read.format("captures").option("table", "net_bodies").load(path)
    arriving = spark.readStream.format("captures").option("table", "dom_html").load(path)
    documents.write.format("captures").mode("append").save(path)  # capture_id, json: a file for each
    spark.read.format("captures").option("table", "documents").load(path)  # those files again: name (without .json), json

Options of reading: table (captures); kind, to read folders of one kind; split, bytes of a task (64 MB; plain files are cut at
lines, those with gzip are read whole); mode, FAILFAST to fail at a line that is no JSON object, which is passed over otherwise;
settle, seconds that a file must be old for a stream to take it (2). Values that aren't of their column's type are null.
Option of writing: fan, hex digits of a hash that name a subfolder (0).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.sources.schemas import SCHEMAS

#: Rows and bytes of lines of an Arrow batch.
ROWS, BYTES = 512, 4 << 20
#: Folders that a task remembers to have made.
FOLDERS = 65_536


def _system(path: str) -> tuple[pa.fs.FileSystem, str]:
    fs, at = pa.fs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


def _hidden(path: str, base: str) -> bool:
    return any(p.startswith(("_", ".")) for p in path[len(base) :].split("/"))


def files_of(path: str, kinds: set[str] | None = None) -> list[pa.fs.FileInfo]:
    """The bundles below a folder in the order of their paths; with kinds, none of a folder of another kind."""
    fs, base = _system(path)
    found = fs.get_file_info(pa.fs.FileSelector(base, recursive=True, allow_not_found=False))
    out = [f for f in found if f.type == pa.fs.FileType.File and not _hidden(f.path, base)]
    if kinds is not None:
        out = [f for f in out if all(p.removeprefix("kind=") in kinds for p in f.path[len(base) :].split("/")[:-1] if p.startswith("kind="))]
    return sorted(out, key=lambda f: f.path)


@dataclass
class Piece(InputPartition):
    """What a task reads: parts (path, begin, end) of files, end None for the whole of a packed one."""

    parts: list[tuple[str, int, int | None]]


def pieces(files: list[pa.fs.FileInfo], split: int) -> list[Piece]:
    """Tasks of about split bytes each: large files are cut, small ones put together."""
    cut: list[tuple[int, tuple[str, int, int | None]]] = []
    for f in files:
        if f.path.endswith(".gz") or f.size <= split:
            cut.append((f.size, (f.path, 0, None)))
        else:
            cut += [(min(split, f.size - a), (f.path, a, min(a + split, f.size))) for a in range(0, f.size, split)]
    out, held = [Piece([])], 0
    for size, part in cut:
        if out[-1].parts and held + size > split:
            out.append(Piece([]))
            held = 0
        out[-1].parts.append(part)
        held += size
    return out if out[0].parts else []


def _lines(fs: pa.fs.FileSystem, path: str, begin: int, end: int | None) -> Iterator[bytes]:
    """The lines of a file that begin from begin on and before end; a line across a border is of the part that it begins in."""
    raw = fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) if end is None else fs.open_input_file(path)
    with raw:
        at = begin
        if begin:
            raw.seek(begin - 1)
            at = begin - 1
        rest, first = b"", bool(begin)
        while end is None or at < end or rest:
            block = raw.read(1 << 20)
            whole = (rest + block).split(b"\n")
            rest = whole.pop() if block else b""
            for line in whole:
                begins, at = at, at + len(line) + 1
                if first:
                    first = False
                elif end is None or begins < end:
                    yield line
                else:
                    return
            if not block:
                return


def _fitted(kind: T.DataType) -> Callable[[Any], Any]:
    """A function that gives a value as one of the type, or None."""
    if isinstance(kind, T.StringType):
        return lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(kind, T.IntegerType):
        return lambda v: v if type(v) is int and -(2**31) <= v < 2**31 else None
    if isinstance(kind, T.DoubleType):
        return lambda v: float(v) if type(v) in (int, float) and abs(v) < 1e308 else None
    if isinstance(kind, T.BooleanType):
        return lambda v: v if isinstance(v, bool) else None
    if isinstance(kind, T.TimestampType):
        return _moment
    if isinstance(kind, T.ArrayType):
        one = _fitted(kind.elementType)
        return lambda v: [one(x) for x in v] if isinstance(v, list) else None
    fields = {f.name: _fitted(f.dataType) for f in kind.fields}
    return lambda v: {k: f(v.get(k)) for k, f in fields.items()} if isinstance(v, dict) else None


def _moment(v: Any) -> datetime | None:
    try:
        found = datetime.fromisoformat(v)
    except (TypeError, ValueError):
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


class _Rows:
    """Rows of one table from pieces of bundles, as Arrow batches."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.table = schema, options["path"], options.get("table", "captures")
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.split = int(options.get("split", 64 << 20))
        self.kinds = {options["kind"]} if "kind" in options else None
        self.wanted: dict[str, list] = {}

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = _system(self.path)
        fit = {f.name: _fitted(f.dataType) for f in self.schema.fields}
        arrow = to_arrow_schema(self.schema)
        mark = json.dumps(self.table).encode()
        held, size = [], 0
        for path, begin, end in piece.parts:
            for line in _lines(fs, path, begin, end):
                if mark not in line and not self.strict:
                    continue  # another table's line needn't be parsed
                row = self._row(line, fit)
                if row is not None:
                    held.append(row)
                    size += len(line)
                if len(held) >= ROWS or size > BYTES:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    def _row(self, line: bytes, fit: dict[str, Callable]) -> dict | None:
        if not line.strip():
            return None
        try:
            got = json.loads(line)
        except (ValueError, RecursionError):
            got = None
        if not isinstance(got, dict):
            if self.strict:
                raise ValueError(f"not a JSON object: {line[:80]!r}")
            return None
        if got.get("table") != self.table:
            return None
        row = {k: f(got.get(k)) for k, f in fit.items()}
        return row if all(row[k] is not None and row[k] in v for k, v in self.wanted.items()) else None


class CaptureReader(_Rows, DataSourceReader):
    """Batches: = and IN over texts, numbers and truths are tested before a row is made, and a kind before a folder is read."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {f.name: f.dataType for f in self.schema.fields if isinstance(f.dataType, (T.StringType, T.IntegerType, T.BooleanType))}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in kinds or not isinstance(f, (EqualTo, EqualNullSafe, In)) or f.value is None:
                yield f
                continue
            values = list(f.value) if isinstance(f, In) else [f.value]
            self.wanted[name] = [v for v in values if v is not None and (name not in self.wanted or v in self.wanted[name])]

    def partitions(self) -> list[Piece]:
        kinds = self.kinds
        if self.table == "captures" and "kind" in self.wanted:
            kinds = set(self.wanted["kind"]) & (kinds or set(self.wanted["kind"]))
        return pieces(files_of(self.path, kinds), self.split) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class CaptureStream(_Rows, DataSourceStreamReader):
    """Arriving bundles: an offset is the time and path of the last file taken; what a file holds is read once."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        self.settle = float(options.get("settle", 2))

    def _files(self) -> list[tuple[int, str, pa.fs.FileInfo]]:
        return sorted(((f.mtime_ns, f.path, f) for f in files_of(self.path, self.kinds)), key=lambda x: x[:2])

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        last = next((f for f in reversed(self._files()) if f[0] <= until), None)
        return {"at": last[0], "path": last[1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        a, b = (start["at"], start["path"]), (end["at"], end["path"])
        return pieces([f for at, path, f in self._files() if a < (at, path) <= b], self.split)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


#: Columns of written documents.
DOCUMENTS = "name string, json string"


@dataclass
class Folder(InputPartition):
    """A folder whose documents a task lists and reads, with or without those of the folders in it."""

    path: str
    deep: bool


class DocumentReader(DataSourceReader):
    """Written documents, a task for each folder of the fan. The driver lists the folders only; files are listed where they are read."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]

    def partitions(self) -> list[Folder]:
        fs, base = _system(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=False))
        inner = sorted(f.path for f in found if f.type == pa.fs.FileType.Directory and not _hidden(f.path, base))
        return [Folder(base, False), *(Folder(path, True) for path in inner)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, _ = _system(self.path)
        arrow = to_arrow_schema(self.schema)
        held, size = [], 0
        for f in fs.get_file_info(pa.fs.FileSelector(partition.path, recursive=partition.deep)):
            if f.type != pa.fs.FileType.File or _hidden(f.path, partition.path) or not f.path.endswith(".json"):
                continue
            with fs.open_input_stream(f.path) as raw:
                data = raw.read()
            held.append({"name": f.base_name.removesuffix(".json"), "json": data.decode()})
            size += len(data)
            if len(held) >= ROWS or size > BYTES:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)


@dataclass
class Written(WriterCommitMessage):
    documents: int
    bytes: int


class DocumentWriter(DataSourceWriter):
    """A file <capture_id>.json for each row (capture_id, json), whole or not there; a task that is done again writes the same files.

    A null capture_id or json has no file. Of a repeated capture_id one document stays. The driver hears counts only; _SUCCESS
    tells that all are there.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.fan = options["path"], int(options.get("fan", 0))
        fs, base = _system(self.path)
        fs.create_dir(base, recursive=True)
        if overwrite:
            fs.delete_dir_contents(base)

    def write(self, rows: Iterator[Row]) -> Written:
        fs, base = _system(self.path)
        n = size = 0
        there: set[str] = set()
        for row in rows:
            if row["capture_id"] is None or row["json"] is None:
                continue
            data = row["json"].encode()
            folder, name = self._place(row["capture_id"])
            at = f"{base}/{folder}" if folder else base
            if folder not in there:
                fs.create_dir(at, recursive=True)
                if len(there) < FOLDERS:
                    there.add(folder)
            own = f"{at}/_{name}.{time.time_ns():x}"
            with fs.open_output_stream(own) as out:
                out.write(data)
            fs.move(own, f"{at}/{name}")
            n, size = n + 1, size + len(data)
        return Written(n, size)

    def _place(self, capture: str) -> tuple[str, str]:
        digest = hashlib.sha256(capture.encode()).hexdigest()
        name = quote(capture, safe="").replace(".", "%2E")
        name = name if 0 < len(name) <= 150 else f"{name[:80]}-{digest[:40]}"
        return digest[: self.fan], f"{name.replace('_', '%5F', 1) if name.startswith('_') else name}.json"

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _system(self.path)
        done = [m for m in messages if m]
        with fs.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(json.dumps({"documents": sum(m.documents for m in done), "bytes": sum(m.bytes for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Documents that were written stay whole; without _SUCCESS they are known not to be all."""


class Captures(DataSource):
    """The format `captures`; see the module."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        table = self.options.get("table", "captures")
        if table == "documents":
            return DOCUMENTS
        if table not in SCHEMAS:
            raise ValueError(f"no such table of captures: {table}; there are {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema: T.StructType) -> CaptureReader | DocumentReader:
        made = DocumentReader if self.options.get("table") == "documents" else CaptureReader
        return made(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> CaptureStream:
        return CaptureStream(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentWriter:
        if not {"capture_id", "json"} <= set(schema.names):
            raise ValueError("documents have the columns capture_id and json")
        return DocumentWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captures)
