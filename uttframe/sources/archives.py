"""Utterances in tar and zip shards, and waveforms.

``archives`` reads files of any size in two passes. The first lists their samples, from the heads of a tar's members or a
zip's directory: names, offsets and sizes, a row a sample. The second deals ranges of archives to tasks, which open each
archive once and read the members of their samples by seeking. A compressed tar has no places to seek to, so it is read as
a stream by one task. ``explode_archives`` takes archives that are values of a column.
"""

from __future__ import annotations

import io
import struct
import tarfile
import wave
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import open_range, size_of
from ..functions.stage import materialise

AUDIO = frozenset(("flac", "mp3", "m4a", "ogg", "opus", "wav", "wma"))
SOME = 16  # samples that leave Python at once
RANGE = 64 << 20  # bytes of an archive that a task reads
SHARE = 4  # tasks a core at least, where there are so many ranges; short ranges and small archives share these
#: A sample's members: where its bytes begin (in a zip, its local head), how many are stored, how (none, or deflated), size and checksum (zip) of the bytes.
LISTED = "path string, place long, key string, members array<struct<postfix:string,at:long,stored:long,method:int,size:long,crc:long>>, error string"
STREAM = -1  # method of a whole compressed tar
BROKEN = (ValueError, tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, zlib.error, struct.error)
SCHEMA = "key string, file_name string, tar_file_name string, wav binary, txt string, extras map<string,string>, error string"


def _sample(prefix: str, parts: dict[str, bytes], shard: str) -> dict:
    row: dict = {"key": prefix, "file_name": shard, "tar_file_name": shard, "wav": None, "txt": None, "extras": {}, "error": None}
    try:
        for postfix, data in parts.items():
            if postfix in AUDIO:
                row["wav"] = data
            else:
                text = data.decode("utf8").strip()
                if postfix == "txt":
                    row["txt"] = text
                else:
                    row["extras"][postfix] = text
    except UnicodeDecodeError as e:
        row["error"] = f"{prefix}: {e}"
    return row


def tar_samples(data: bytes | io.BufferedIOBase, shard: str) -> Iterator[dict]:
    """Consecutive members with one prefix (up to the last dot) are a sample; one that doesn't decode makes it an error."""
    prefix, parts = None, {}
    with tarfile.open(fileobj=io.BytesIO(data) if isinstance(data, bytes | bytearray) else data, mode="r:*" if isinstance(data, bytes | bytearray) else "r|*") as archive:
        for member in archive:
            stem, dot, postfix = member.name.rpartition(".")
            if not dot or not member.isfile():
                continue
            if prefix is not None and stem != prefix:
                yield _sample(prefix, parts, shard)
                parts = {}
            prefix = stem
            parts[postfix] = archive.extractfile(member).read()
    if prefix is not None:
        yield _sample(prefix, parts, shard)


def _failed(path: str, error: Exception | str) -> dict:
    return {"file_name": path, "tar_file_name": path, "extras": {}, "error": str(error) or type(error).__name__}


def _tar_list(f: io.BufferedIOBase) -> Iterator[tuple[str, list[tuple]]]:
    """Prefix and members of each sample of a plain tar, from the heads alone."""
    with tarfile.open(fileobj=f, mode="r:") as archive:

        def members() -> Iterator[tuple[str, tuple]]:
            while (m := archive.next()) is not None:
                archive.members.clear()  # kept by the library for lookups that aren't made here
                stem, dot, postfix = m.name.rpartition(".")
                if dot and m.isfile():
                    yield stem, (postfix, m.offset_data, m.size, 0, m.size, None)

        for stem, own in groupby(members(), lambda x: x[0]):
            yield stem, list({m[0]: m for _, m in own}.values())


def _zip_list(f: io.BufferedIOBase) -> Iterator[tuple[str, list[tuple]]]:
    """The same of a zip, from its directory: each wav member, with every other postfix of the archive under its prefix."""
    try:
        with zipfile.ZipFile(f) as archive:
            entries = {x.filename: x for x in archive.infolist()}
    except ValueError:  # a seek before the file's start
        raise zipfile.BadZipFile("File is not a zip file") from None
    postfixes = sorted({n.rpartition(".")[2] for n in entries if "." in n} - {"wav"})
    for name in sorted(n for n in entries if n.endswith(".wav")):
        stem = name.removesuffix(".wav")
        own = [(p, entries[n]) for p in ("wav", *postfixes) if (n := f"{stem}.{p}") in entries]
        yield stem, [(p, x.header_offset, x.compress_size, x.compress_type, x.file_size, x.CRC) for p, x in own]


def _member(f: io.BufferedIOBase, m: dict) -> bytes:
    f.seek(m["at"])
    if m["crc"] is None:
        data = f.read(m["stored"])
        if len(data) < m["stored"]:
            raise EOFError("unexpected end of data")
        return data
    head = f.read(30)
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(name + extra, 1)
    data = f.read(m["stored"])
    if m["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {m['method']}")
    data = zlib.decompress(data, -15) if m["method"] == zipfile.ZIP_DEFLATED else data
    if len(data) != m["size"] or zlib.crc32(data) != m["crc"]:
        raise zipfile.BadZipFile("bad checksum")
    return data


def list_samples(files: DataFrame) -> DataFrame:
    """LISTED rows of the archives in (path) rows; a broken archive ends with a row that has its error."""

    def found(path: str) -> Iterator[tuple]:
        how = _zip_list if path.endswith(".zip") else _tar_list if path.endswith(".tar") else None
        try:
            if path.endswith(("tar.gz", ".tgz")):
                yield path, 0, None, [("", 0, size_of(path), STREAM, 0, None)], None
                return
            if how is None:
                raise ValueError("unknown kind of archive")
            with open_range(path, 1 << 14) as f:
                for stem, members in how(f):
                    yield path, min(m[1] for m in members), stem, members, None
        except BROKEN as e:
            yield path, 0, None, None, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in "path string, place long, key string, members array, error string".split(", ")]
        for pdf in batches:
            for path in pdf["path"]:
                rows = found(path)
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=names, dtype=object)

    return files.select("path").mapInPandas(run, LISTED)


def _least(spark: SparkSession) -> int:
    return SHARE * spark.sparkContext.defaultParallelism


def read_samples(listed: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """The samples of LISTED rows. Ranges of archives are dealt to tasks: as many as their bytes ask for, or the cores, never one for each small archive."""

    def of(path: str, rows: Iterator[tuple]) -> Iterator[dict]:
        held = None
        for _, stem, members, error in rows:
            try:
                if error is not None:
                    raise ValueError(error)
                held = held or open_range(path)
                if members[0]["method"] == STREAM:
                    yield from tar_samples(held, path)
                else:
                    yield _sample(stem, {m["postfix"]: _member(held, m) for m in members}, path)
            except BROKEN as e:
                yield _failed(path, e)
        if held:
            held.close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows = (r for pdf in batches for r in zip(pdf["path"], pdf["key"], pdf["members"], pdf["error"], strict=True))
        samples = (s for path, own in groupby(rows, lambda r: r[0]) for s in of(path, own))
        while some := list(islice(samples, SOME)):
            yield pd.DataFrame([[r.get(c) for c in names] for r in some], columns=names, dtype=object)

    ranged = materialise(listed.withColumn("_range", F.floor(F.col("place") / range_bytes)), "archive-list")
    stored = F.aggregate(F.coalesce(F.col("members.stored"), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x)
    n, size = ranged.groupBy("path", "_range").agg(F.sum(stored).alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(_least(ranged.sparkSession), -(-size // RANGE))))  # a number, as Spark would join so short a list to one task
    return ranged.repartition(tasks, "path", "_range").sortWithinPartitions("path", "place").mapInPandas(run, SCHEMA)


def zip_samples(data: bytes, shard: str) -> Iterator[dict]:
    """Each wav member is a sample; every other postfix of the archive is looked up under its prefix."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        postfixes = {n.rpartition(".")[2] for n in names if "." in n} - {"wav"}
        for name in sorted(n for n in names if n.endswith(".wav")):
            stem = name.removesuffix(".wav")
            parts = {"wav": archive.read(name)} | {p: archive.read(f"{stem}.{p}") for p in sorted(postfixes) if f"{stem}.{p}" in names}
            yield _sample(stem, parts, shard)


def explode_archives(files: DataFrame) -> DataFrame:
    """Samples of (path, content) rows: tar (also compressed) and zip by suffix; others, and broken archives, give a row with an error."""

    def samples(path: str, data: bytes) -> Iterator[dict]:
        how = zip_samples if path.endswith(".zip") else tar_samples if path.endswith((".tar", "tar.gz", ".tgz")) else None
        try:
            if how is None:
                raise ValueError("unknown kind of archive")
            yield from how(data, path)
        except BROKEN as e:
            yield _failed(path, e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = samples(path, data)
                while some := list(islice(rows, SOME)):
                    yield pd.DataFrame([[r.get(c) for c in names] for r in some], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def archives(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """Samples of archive files: tar (also compressed) and zip by suffix; others, and broken archives, give a row with an error."""
    files = spark.read.format("binaryFile").load(path).select("path")  # names alone: contents are not read
    return read_samples(list_samples(files.repartition(_least(spark), "path")), range_bytes)  # a number here too: names are a short list


def shards(spark: SparkSession, lists: DataFrame) -> DataFrame:
    """Samples of the archives that (line) rows name. The list is metadata: its paths, not its data, pass the driver."""
    return archives(spark, [r["line"] for r in lists.select("line").toLocalIterator()])


def decode_wave(content: Column) -> Column:
    """A struct of sample_rate and samples (first channel, -1 to 1) of uncompressed wav bytes; null where that fails."""

    @F.pandas_udf("sample_rate int, samples array<float>")
    def run(xs: pd.Series) -> pd.DataFrame:
        rows = []
        for data in xs:
            try:
                with wave.open(io.BytesIO(data)) as w:
                    width, raw = w.getsampwidth(), w.readframes(w.getnframes())
                    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
                    x = np.frombuffer(raw, dtype=kind)[:: w.getnchannels()].astype(np.float64)
                    x = (x - 128) / 128 if width == 1 else x / (1 << (8 * width - 1))
                    rows.append((w.getframerate(), x.astype(np.float32)))
            except (wave.Error, EOFError, KeyError, TypeError):
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["sample_rate", "samples"]).astype({"sample_rate": "Int32"})

    return run(content)


def waves(samples: DataFrame) -> DataFrame:
    """Samples with their bytes decoded; undecodable ones get an error."""
    out = samples.withColumn("_w", decode_wave(F.col("wav"))).drop("wav").select("*", F.col("_w.sample_rate").alias("sample_rate"), F.col("_w.samples").alias("samples")).drop("_w")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("samples").isNull(), "no uncompressed wave")))
