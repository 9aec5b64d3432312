"""Keyed binary archives of vectors and matrices as a Spark data source: ``spark.read.format("ark")`` and ``df.write``.

A record is a key, a space, and a value: text, or a zero byte, ``B`` and a typed binary value. Index lines ``key path:offset``
name records in archives.

``register`` makes the format known. A read takes an index, an archive, or a folder of either. Of an index, each task gets a
range of its lines, opens each archive they name once, and reads its records in order of their offsets; a filter on ``key``
leaves the others unread. An archive without an index is one task, record by record. ``index_of`` makes the index of archives
from the heads of their records alone, and ``read_index`` reads index rows of any table, a range of an archive a task. A
write makes an archive and its index for each task, which appear when all tasks have ended.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..functions.files import BUFFER, listed, open_range, system
from ..functions.stage import materialise

# Binary type marks of the format.
FLOATS = {b"FV ": np.float32, b"DV ": np.float64}
MATRICES = {b"FM ": np.float32, b"DM ": np.float64}
SCHEMA = "key string, ints array<int>, vector array<double>, matrix array<array<double>>"
#: What a file holds, as the binary forms of the last two begin as an integer vector does.
KINDS = {"plain": SCHEMA, "posterior": "key string, posterior array<array<struct<index:int,value:float>>>", "times": "key string, times array<struct<begin:float,end:float>>"}
PAIR = {"posterior": ("index", "<i4", "value"), "times": ("begin", "<f4", "end")}
PAIR_NAMES = {kind: (first, second) for kind, (first, _, second) in PAIR.items()}
PAIRS = {"posterior": pa.list_(pa.list_(pa.struct([("index", pa.int32()), ("value", pa.float32())]))), "times": pa.list_(pa.struct([("begin", pa.float32()), ("end", pa.float32())]))}
PLAIN = [("ints", pa.list_(pa.int32())), ("vector", pa.list_(pa.float64())), ("matrix", pa.list_(pa.list_(pa.float64())))]
SOME = 200  # records that leave Python at once
RANGE, LINES = 64 << 20, 1 << 20  # bytes of an archive, and of index lines, a task


def _int(f: io.BytesIO) -> int:
    f.read(1)  # the size of the integer, always 4
    return struct.unpack("<i", f.read(4))[0]


def _compressed(f: io.BytesIO, mark: bytes) -> np.ndarray:
    low, span, rows, cols = struct.unpack("<ffii", f.read(16))
    if mark == b"CM ":  # a header of four quartiles a column, then a byte a value, column by column
        q = low + span * np.frombuffer(f.read(8 * cols), dtype="<u2").reshape(cols, 4).astype(np.float64) / 65535
        x = np.frombuffer(f.read(rows * cols), dtype=np.uint8).reshape(cols, rows).astype(np.float64)
        p0, p25, p75, p100 = (q[:, i : i + 1] for i in range(4))
        return np.where(x <= 64, p0 + (p25 - p0) * x / 64, np.where(x <= 192, p25 + (p75 - p25) * (x - 64) / 128, p75 + (p100 - p75) * (x - 192) / 63)).T
    kind, top = ("<u2", 65535) if mark == b"CM2" else (np.uint8, 255)
    size = rows * cols * np.dtype(kind).itemsize
    return low + span * np.frombuffer(f.read(size), dtype=kind).reshape(rows, cols).astype(np.float64) / top


def _value(f: io.BytesIO) -> tuple[str, object]:
    start = f.read(2)
    if start != b"\0B":
        return _text_value(start + f.readline(), f)
    at = f.tell()
    if f.read(1) == b"\4":  # an integer vector: its length, then marked integers
        n = struct.unpack("<i", f.read(4))[0]
        data = np.frombuffer(f.read(5 * n), dtype=np.dtype([("m", "u1"), ("v", "<i4")]))
        return "ints", data["v"].tolist()
    f.seek(at)
    mark = f.read(3)
    if mark in FLOATS:
        n = _int(f)
        return "vector", np.frombuffer(f.read(n * np.dtype(FLOATS[mark]).itemsize), dtype=FLOATS[mark]).astype(np.float64).tolist()
    if mark in MATRICES:
        rows, cols = _int(f), _int(f)
        data = f.read(rows * cols * np.dtype(MATRICES[mark]).itemsize)
        return "matrix", np.frombuffer(data, dtype=MATRICES[mark]).reshape(rows, cols).astype(np.float64).tolist()
    if mark[:2] == b"CM":
        if mark != b"CM ":
            f.read(1)
        return "matrix", _compressed(f, mark).tolist()
    raise ValueError(f"unknown value mark {mark!r}")


def _text_value(line: bytes, f: io.BytesIO) -> tuple[str, object]:
    text = line.decode().strip()
    if not text.startswith("["):
        return "ints", [int(x) for x in text.split()]
    while "]" not in text:
        text += "\n" + f.readline().decode().strip()
    rows = [[float(x) for x in r.split()] for r in text.strip("[] \n").split("\n") if r.strip()]
    return ("vector", rows[0] if rows else []) if len(rows) < 2 else ("matrix", rows)


def _pairs(f: io.BytesIO, kind: str) -> list[tuple]:
    """Marked pairs behind their number: of an index and a value, or of two times."""
    first, form, second = PAIR[kind]
    n = _int(f)
    data = np.frombuffer(f.read(10 * n), dtype=np.dtype([("m", "u1"), (first, form), ("n", "u1"), (second, "<f4")]))
    return list(zip(data[first].tolist(), data[second].tolist(), strict=True))


def _value_of(f: io.BytesIO, kind: str) -> tuple[str, object]:
    if kind == "plain":
        return _value(f)
    if f.read(2) != b"\0B":
        raise ValueError(f"{kind} is read in binary form alone")
    return kind, _pairs(f, kind) if kind == "times" else [_pairs(f, kind) for _ in range(_int(f))]


def _key(f: io.BufferedIOBase) -> str | None:
    """The key that comes next, None at the end."""
    key = bytearray()
    while (c := f.read(1)) and c != b" ":
        key += c
    return key.decode().strip() if c else None


def _skip(f: io.BufferedIOBase, kind: str) -> None:
    """Passes a value, reading its head alone where it is binary."""
    start = f.read(2)
    if start != b"\0B":
        _text_value(start + f.readline(), f)
        return
    at = f.tell()
    if kind != "plain":
        for _ in range(_int(f) if kind == "posterior" else 1):
            f.seek(10 * _int(f), 1)
    elif f.read(1) == b"\4":
        f.seek(5 * struct.unpack("<i", f.read(4))[0], 1)
    else:
        f.seek(at)
        mark = f.read(3)
        if mark in FLOATS:
            f.seek(_int(f) * np.dtype(FLOATS[mark]).itemsize, 1)
        elif mark in MATRICES:
            rows, cols = _int(f), _int(f)
            f.seek(rows * cols * np.dtype(MATRICES[mark]).itemsize, 1)
        elif mark[:2] == b"CM":
            f.seek(8 if mark == b"CM " else 9, 1)
            rows, cols = struct.unpack("<ii", f.read(8))
            f.seek(cols * (8 + rows) if mark == b"CM " else rows * cols * (2 if mark == b"CM2" else 1), 1)
        else:
            raise ValueError(f"unknown value mark {mark!r}")


def records(data: bytes | io.BufferedIOBase, kind: str = "plain") -> Iterator[dict]:
    """The records of an archive's bytes, or of an open one, one at a time."""
    f = io.BytesIO(data) if isinstance(data, bytes | bytearray) else data
    while (key := _key(f)) is not None:
        name, value = _value_of(f, kind)
        none = {"ints": None, "vector": None, "matrix": None} if kind == "plain" else {}
        yield {"key": key} | none | {name: value}


def heads(f: io.BufferedIOBase, kind: str = "plain") -> Iterator[tuple[str, int]]:
    """Key and offset of the value of each record of an open archive."""
    while (key := _key(f)) is not None:
        yield key, f.tell()
        _skip(f, kind)


def at_offsets(lines: Iterator[tuple[str, str, int]], kind: str = "plain") -> Iterator[dict]:
    """The records of (key, path, offset), each archive opened once as long as lines of one path follow each other."""
    for path, own in groupby(lines, lambda x: x[1]):
        with open_range(path) as f:
            for key, _, offset in own:
                f.seek(offset)
                name, value = _value_of(f, kind)
                yield {"key": key, name: value}


def _rows(found: list[dict], kind: str = "plain") -> pd.DataFrame:
    names = ["key", "ints", "vector", "matrix"] if kind == "plain" else ["key", kind]
    return pd.DataFrame([[r.get(c) for c in names] for r in found], columns=names, dtype=object)


def read_ark(spark: SparkSession, path: str | list[str], kind: str = "plain") -> DataFrame:
    """(key, ints, vector, matrix), one of the three filled; or (key, posterior), or (key, times), as kind says."""
    return explode_ark(spark.read.format("binaryFile").load(path), kind)


def explode_ark(files: DataFrame, kind: str = "plain") -> DataFrame:
    """The records of (content) rows, a file a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = records(data, kind)
                while some := list(islice(rows, SOME)):
                    yield _rows(some, kind)

    return files.select("content").mapInPandas(run, KINDS[kind])


def index_of(files: DataFrame, kind: str = "plain") -> DataFrame:
    """(key, path, offset) of the records of the archives in (path) rows; values are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with open_range(path, 1 << 14) as f:
                    found = ((key, path, offset) for key, offset in heads(f, kind))
                    while some := list(islice(found, 10_000)):
                        yield pd.DataFrame(some, columns=["key", "path", "offset"])

    return files.select("path").mapInPandas(run, "key string, path string, offset long")


def read_index(index: DataFrame, kind: str = "plain", range_bytes: int = RANGE) -> DataFrame:
    """The records that (key, path, offset) rows name. A task gets the rows of a range of an archive, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = at_offsets((x for pdf in batches for x in zip(pdf["key"], pdf["path"], pdf["offset"].astype(int), strict=True)), kind)
        while some := list(islice(rows, SOME)):
            yield _rows(some, kind)

    ranged = materialise(index.select("key", "path", "offset", F.floor(F.col("offset") / range_bytes).alias("_range")), "ark-index")
    n = max(1, ranged.select("path", "_range").distinct().count())  # a number, as Spark would join so few bytes of index to one task
    return ranged.repartition(n, "path", "_range").sortWithinPartitions("path", "offset").select("key", "path", "offset").mapInPandas(run, KINDS[kind])


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, path, offset) of index lines; no offset is 0."""
    at = lambda i: F.regexp_extract("value", r"^(\S+)\s+(.*?)(?::(\d+))?$", i)
    return spark.read.text(path).select(at(1).alias("key"), at(2).alias("path"), F.coalesce(at(3).try_cast("bigint"), F.lit(0).cast("bigint")).alias("offset"))


def encode_pairs(kind: str, value: list) -> bytes:
    """A posterior (a list of pairs for each frame) or times (a list of pairs) in binary form."""
    first, form, second = PAIR[kind]

    def pairs(xs: list) -> bytes:
        out = np.zeros(len(xs), dtype=np.dtype([("m", "u1"), (first, form), ("n", "u1"), (second, "<f4")]))
        out["m"] = out["n"] = 4
        out[first], out[second] = [x[0] for x in xs], [x[1] for x in xs]
        return b"\4" + struct.pack("<i", len(xs)) + out.tobytes()

    return b"\0B" + (pairs(value) if kind == "times" else b"\4" + struct.pack("<i", len(value)) + b"".join(map(pairs, value)))


def encode(ints: list | None, vector: list | None, matrix: list | None) -> bytes:
    if ints is not None:
        x = np.zeros(len(ints), dtype=np.dtype([("m", "u1"), ("v", "<i4")]))
        x["m"], x["v"] = 4, ints
        return b"\0B\4" + struct.pack("<i", len(ints)) + x.tobytes()
    if vector is not None:
        return b"\0BFV \4" + struct.pack("<i", len(vector)) + np.asarray(vector, dtype="<f4").tobytes()
    m = np.asarray([list(r) for r in matrix], dtype="<f4")
    m = m.reshape(len(matrix), -1) if len(matrix) else m.reshape(0, 0)
    return b"\0BFM \4" + struct.pack("<i", m.shape[0]) + b"\4" + struct.pack("<i", m.shape[1]) + m.tobytes()


@dataclass
class LinesPart(InputPartition):
    """Index lines that begin in a range of bytes."""

    path: str
    start: int
    end: int


@dataclass
class ArchivePart(InputPartition):
    path: str


@dataclass
class ArkPart(WriterCommitMessage):
    name: str
    rows: int


def register(spark: SparkSession) -> None:
    """Makes ``format("ark")`` known to a session, with filters that go to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArkSource)


class ArkSource(DataSource):
    """``spark.read.format("ark").load(path)`` and ``df.write.format("ark").save(folder)``. Options of a read: kind (plain, posterior, times) and lineBytes (bytes of index lines a task)."""

    @classmethod
    def name(cls) -> str:
        return "ark"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "plain")]

    def reader(self, schema) -> ArkReader:
        return ArkReader(self.options["path"], self.options.get("kind", "plain"), int(self.options.get("lineBytes", LINES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        writer = ArkWriter(self.options["path"], overwrite)
        where, job = system(writer.job)
        where.create_dir(job)  # not by tasks, so that one which ends after the job has failed finds none
        return writer


class ArkReader(DataSourceReader):
    def __init__(self, path: str, kind: str, line_bytes: int) -> None:
        self.path, self.kind, self.line_bytes, self.keys = path, kind, line_bytes, None

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality and lists of keys; the rest goes back to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("key",):
                yield f
            else:
                self.keys = wanted if self.keys is None else self.keys & wanted

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path, ".scp", ".ark"):
            if path.endswith(".scp"):
                where, name = system(path)
                size = where.get_file_info(name).size
                out += [LinesPart(path, at, min(at + self.line_bytes, size)) for at in range(0, size, self.line_bytes)]
            else:
                out.append(ArchivePart(path))
        return out or [LinesPart("", 0, 0)]

    def _lines(self, part: LinesPart) -> Iterator[tuple[str, str, int]]:
        """(key, path, offset) of the part's lines of wanted keys. Paths are as the index has them, or beside it."""
        with open_range(part.path) as f:
            f.seek(max(part.start - 1, 0))
            if part.start:
                f.readline()  # the end of a line of the part before, or its line end alone
            while f.tell() < part.end and (line := f.readline()):
                key, _, place = line.decode().strip().partition(" ")
                if not key or self.keys is not None and key not in self.keys:
                    continue
                path, colon, offset = place.strip().rpartition(":")
                path, offset = (path, int(offset)) if colon and offset.isdigit() else (place.strip(), 0)
                yield key, path if "/" in path else f"{part.path.rpartition('/')[0]}/{path}", offset

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), *(PLAIN if self.kind == "plain" else [(self.kind, PAIRS[self.kind])])])
        if isinstance(partition, ArchivePart):
            with open_range(partition.path) as f:
                yield from self._batches((r for r in records(f, self.kind) if self.keys is None or r["key"] in self.keys), schema)
        elif partition.end:
            yield from self._batches(at_offsets(iter(sorted(self._lines(partition), key=lambda x: x[1:])), self.kind), schema)

    def _batches(self, rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        names = [n for n in schema.names[1:] if self.kind != "plain"]
        while some := list(islice(rows, SOME)):
            for r in some:
                for n in names:  # pairs as structs
                    r[n] = [dict(zip(PAIR_NAMES[n], p, strict=True)) for p in r[n]] if n == "times" else [[dict(zip(PAIR_NAMES[n], p, strict=True)) for p in frame] for frame in r[n]]
            yield pa.RecordBatch.from_pylist(some, schema=schema)


class ArkWriter(DataSourceArrowWriter):
    """Tasks write under a folder of the job. When all have ended, the driver moves what they report to its place, and nothing else."""

    def __init__(self, folder: str, overwrite: bool = False) -> None:
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.job = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ArkPart:
        where, job = system(self.job)
        name, at, n = f"part-{uuid.uuid4().hex}", 0, 0
        with where.open_output_stream(f"{job}/{name}.ark", compression=None, buffer_size=BUFFER) as ark, where.open_output_stream(f"{job}/{name}.scp", compression=None, buffer_size=BUFFER) as index:
            for batch in iterator:
                for row in batch.to_pylist():
                    head = row["key"].encode() + b" "
                    data = head + encode(row["ints"], row["vector"], row["matrix"])
                    ark.write(data)
                    index.write(f"{row['key']} {self.folder}/{name}.ark:{at + len(head)}\n".encode())
                    at, n = at + len(data), n + 1
        return ArkPart(name, n)

    def commit(self, messages: list) -> None:
        where, job = system(self.job)
        folder = system(self.folder)[1]
        if self.overwrite:
            for path in [*listed(self.folder, ".ark"), *listed(self.folder, ".scp")]:
                where.delete_file(system(path)[1])
        for m in messages:
            if m is not None and m.rows:
                for suffix in ("ark", "scp"):  # an index names its archive, so it comes last
                    where.move(f"{job}/{m.name}.{suffix}", f"{folder}/{m.name}.{suffix}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, job = system(self.job)
        if where.get_file_info(job).type == fs.FileType.Directory:
            where.delete_dir(job)
