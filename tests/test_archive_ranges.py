"""Binary archives by index and range, their committing writer, and tar and zip shards by range."""

from __future__ import annotations

import io
import os
import random
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from uttframe.functions import files
from uttframe.sources import archives, ark


def some_rows(n: int, size: int = 300) -> list[tuple]:
    rng = random.Random(n)
    out = []
    for i in range(n):
        x = [rng.randrange(1000) / 8 for _ in range(rng.randrange(1, size))]
        out.append((f"k{i}", *[([int(v) for v in x], None, None), (None, x, None), (None, None, [x, x])][i % 3]))
    return out


def plain(rows) -> dict:
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows, folder = some_rows(400), str(tmp_path_factory.mktemp("ark") / "out")
    ark.register(spark)
    spark.createDataFrame(rows, ark.SCHEMA).repartition(3).write.format("ark").mode("append").save(folder)
    return rows, folder


def test_a_folder_by_its_indexes(spark, written):
    rows, folder = written
    assert plain(spark.read.format("ark").load(folder).collect()) == plain(rows)
    small = spark.read.format("ark").option("lineBytes", "500").load(folder)
    assert small.rdd.getNumPartitions() > 20 and plain(small.collect()) == plain(rows) and small.count() == len(rows)


def test_an_archive_without_index_and_an_index_made_from_heads(spark, written, tmp_path):
    rows, folder = written
    paths = [f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".ark")]
    assert plain(r for p in paths for r in spark.read.format("ark").load(p).collect()) == plain(rows)
    index = ark.index_of(spark.createDataFrame([(p,) for p in paths], "path string"))
    lines = ark.index_lines(spark, f"{folder}/*.scp")
    assert Counter(map(tuple, index.collect())) == Counter(map(tuple, lines.collect()))
    read = ark.read_index(index, range_bytes=20_000)
    assert plain(read.collect()) == plain(rows)
    assert read.select(F.spark_partition_id()).distinct().count() > 5


def test_heads_pass_every_kind_of_value():
    text = b"a 1 2 3\nb  [ 1.5 2 ]\nc  [\n 1 2\n 3 4 ]\n"
    packed = b"d \0BCM2 " + __import__("struct").pack("<ffii", 0.0, 65535.0, 1, 2) + b"\0\0\xff\xff"
    eight = b"e \0BCM3 " + __import__("struct").pack("<ffii", 0.0, 255.0, 1, 2) + b"\0\xff"
    quartiles = b"f \0BCM " + __import__("struct").pack("<ffii", 0.0, 1.0, 2, 1) + b"\0" * 8 + b"\0\1"
    last = b"g " + ark.encode([7], None, None)
    data = text + packed + eight + quartiles + last
    found = dict(ark.heads(io.BytesIO(data)))
    assert list(found) == list("abcdefg") and [r["key"] for r in ark.records(data)] == list("abcdefg")
    assert next(ark.records(data[found["g"] - 2 :]))["ints"] == [7]
    pairs = b"p " + ark.encode_pairs("posterior", [[(1, 0.5)], []]) + b"q " + ark.encode_pairs("posterior", [])
    assert list(dict(ark.heads(io.BytesIO(pairs), "posterior"))) == ["p", "q"]
    times = b"p " + ark.encode_pairs("times", [(0.0, 1.0)] * 3) + b"q " + ark.encode_pairs("times", [])
    assert list(dict(ark.heads(io.BytesIO(times), "times"))) == ["p", "q"]


def test_posteriors_and_times_by_the_format(spark, tmp_path):
    ark.register(spark)
    posterior, times = [[(1, 0.5), (2, 0.25)], []], [(0.0, 0.5), (0.5, 2.0)]
    (tmp_path / "p.ark").write_bytes(b"a " + ark.encode_pairs("posterior", posterior))
    (tmp_path / "t.ark").write_bytes(b"a " + ark.encode_pairs("times", times))
    p = spark.read.format("ark").option("kind", "posterior").load(str(tmp_path / "p.ark")).first()
    t = spark.read.format("ark").option("kind", "times").load(str(tmp_path / "t.ark")).first()
    assert [[tuple(x) for x in f] for f in p.posterior] == posterior and [tuple(x) for x in t.times] == times


class Counted(io.RawIOBase):
    """A file that counts what is read and how often it is opened."""

    read_bytes, opened = 0, Counter()

    def __init__(self, path: str) -> None:
        self.f = open(path, "rb")
        Counted.opened[path] += 1

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, *a) -> int:
        return self.f.seek(*a)

    def readinto(self, buffer) -> int:
        n = self.f.readinto(buffer)
        Counted.read_bytes += n
        return n


def test_bytes_read_and_filters(spark, tmp_path, monkeypatch):
    rows = some_rows(900, 600)
    ark.register(spark)
    folder = str(tmp_path / "out")
    spark.createDataFrame(rows, ark.SCHEMA).coalesce(1).write.format("ark").mode("append").save(folder)
    path = next(f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".ark"))
    monkeypatch.setattr(ark, "open_range", lambda p, buffer=4096: io.BufferedReader(Counted(p), buffer))
    size = os.path.getsize(path)
    reader = ark.ArkReader(folder, "plain", 1 << 20)
    (part,) = reader.partitions()
    Counted.read_bytes, Counted.opened = 0, Counter()
    assert sum(b.num_rows for b in reader.read(part)) == len(rows)
    assert Counted.opened[path] == 1 and Counted.read_bytes < 1.2 * (size + os.path.getsize(part.path))
    left = list(reader.pushFilters([EqualTo(("key",), "k7"), In(("key",), ("k7", "k8")), GreaterThan(("key",), "a")]))
    assert len(left) == 1 and reader.keys == {"k7"}
    Counted.read_bytes, Counted.opened = 0, Counter()
    assert [r["key"] for b in reader.read(part) for r in b.to_pylist()] == ["k7"]
    assert Counted.read_bytes < os.path.getsize(part.path) + 4096 * 4
    found = spark.read.format("ark").load(folder).filter("key IN ('k1', 'k899') AND ints IS NULL")
    assert sorted(r.key for r in found.collect()) == ["k1", "k899"]


def test_a_failing_task_leaves_nothing_and_an_overwrite_replaces(spark, tmp_path):
    ark.register(spark)
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame(some_rows(50), ark.SCHEMA)
    bad = rows.repartition(4).withColumn("key", F.when(F.col("key") == "k30", F.raise_error(F.lit("broken"))).otherwise(F.col("key")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("ark").mode("append").save(folder)
    assert not os.path.isdir(folder) or os.listdir(folder) == []
    rows.write.format("ark").mode("append").save(folder)
    rows.write.format("ark").mode("append").save(folder)
    assert spark.read.format("ark").load(folder).count() == 100
    rows.repartition(2).write.format("ark").mode("overwrite").save(folder)
    assert spark.read.format("ark").load(folder).count() == 50 and not [n for n in os.listdir(folder) if n.startswith("_")]


def test_of_a_task_that_ran_twice_one_copy_stays(tmp_path):
    import pyarrow as pa

    writer = ark.ArkSource({"path": str(tmp_path / "out")}).writer(None, False)
    batch = pa.RecordBatch.from_pylist([{"key": "a", "ints": [1], "vector": None, "matrix": None}])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.name != kept.name
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path / "out")) == [f"{kept.name}.ark", f"{kept.name}.scp"]


def make_tar(path, members: list[tuple[str, bytes]], mode: str = "w") -> None:
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def shard_members(n: int) -> list[tuple[str, bytes]]:
    rng = random.Random(n)
    long = "very-long-directory-name/" * 8
    out: list[tuple[str, bytes]] = [("folder", b"")]
    for i in range(n):
        stem = f"{long if i % 7 == 0 else ''}u.{i}"
        out += [(f"{stem}.wav", rng.randbytes(rng.randrange(3000))), (f"{stem}.txt", f" text {i} é ".encode())]
        out += [(f"{stem}.speaker", b"s1")] if i % 3 else [(f"{stem}.note", b"\xff\xfe")] if i % 5 == 0 else []
    return out


def samples(df) -> Counter:
    return Counter((r.key, r.tar_file_name.rpartition("/")[2], bytes(r.wav) if r.wav is not None else None, r.txt, tuple(sorted((r.extras or {}).items())), r.error) for r in df.collect())


def test_archives_by_range_equal_archives_by_value(spark, tmp_path):
    make_tar(tmp_path / "a.tar", shard_members(60))
    make_tar(tmp_path / "b.tar.gz", shard_members(20), "w:gz")
    make_tar(tmp_path / "empty.tar", [])
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in shard_members(40):
            z.writestr(name, data, zipfile.ZIP_STORED if name.endswith("1.wav") else None)
    (tmp_path / "d.zip").write_bytes(b"no zip")
    (tmp_path / "e.bin").write_bytes(b"no archive")
    whole = archives.explode_archives(spark.read.format("binaryFile").load(str(tmp_path / "*")))
    ranged = archives.archives(spark, str(tmp_path / "*"), range_bytes=10_000)
    assert samples(ranged) == samples(whole)
    assert ranged.filter("tar_file_name LIKE '%a.tar'").select(F.spark_partition_id()).distinct().count() > 3
    assert ranged.filter("tar_file_name LIKE '%c.zip'").select(F.spark_partition_id()).distinct().count() > 2


def test_many_small_archives_share_tasks(spark, tmp_path):
    for i in range(120):
        make_tar(tmp_path / (f"{i}.tar.gz" if i % 3 == 0 else f"{i}.tar"), [("a.wav", bytes(3000)), ("a.txt", str(i).encode())], "w:gz" if i % 3 == 0 else "w")
    least = archives.SHARE * spark.sparkContext.defaultParallelism
    listed = archives.list_samples(spark.createDataFrame([(f"{tmp_path}/0.tar.gz",)], "path string")).first()
    assert listed.members[0].stored == os.path.getsize(tmp_path / "0.tar.gz")
    found = archives.archives(spark, str(tmp_path), range_bytes=1000)
    assert 1 < found.rdd.getNumPartitions() <= least
    assert sorted(int(r.txt) for r in found.collect()) == list(range(120))


def test_a_cut_archive_gives_its_whole_samples_and_an_error(spark, tmp_path):
    make_tar(tmp_path / "a.tar", [(f"{i}.wav", bytes(2000)) for i in range(5)])
    data = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "a.tar").write_bytes(data[:4000])
    rows = archives.archives(spark, str(tmp_path / "a.tar")).collect()
    assert [r.key for r in rows if r.error is None] == ["0"] and any(r.error for r in rows)


def test_files(tmp_path):
    (tmp_path / "x.ark").write_bytes(b"0123456789")
    assert files.listed(f"file://{tmp_path}", ".scp", ".ark") == [f"file://{tmp_path}/x.ark"]
    assert files.listed(str(tmp_path / "x.ark"), ".scp") == [str(tmp_path / "x.ark")]
    with files.open_range(f"file:{tmp_path}/x.ark") as f:
        f.seek(4)
        assert f.read(3) == b"456"
