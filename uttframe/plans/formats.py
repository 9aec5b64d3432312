"""Queries over files: driver tables written in the line, archive and binary formats, and read again by the sources."""

from __future__ import annotations

import io
import json
import tarfile
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage_path
from ..operators import bias, features, scoring
from ..functions import files
from ..llm.common import light_batches
from ..sources import archives, ark, sinks
from ..sources import text as S
from .base import Tables, query
from .speech import TIMED, WORDS, _segments, _words


def _written(t: Tables, lines: DataFrame, name: str, *by: str) -> str:
    """A path of text files with the lines in column value; a file for each value of ``by``."""
    path = stage_path(t.spark, name)
    (lines.repartition(*by).write.partitionBy(*by) if by else lines.write).text(path)
    return path


# Manifests


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) GROUP BY line")
def manifest_lines(t: Tables) -> DataFrame:
    path = _written(t, t.benchmark.select(F.col("text").alias("value")), "lines")
    return S.lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


def _manifest(t: Tables) -> str:
    """documents as JSON lines; every seventh lacks its text, every eleventh is cut."""
    row = F.struct(F.format_string("u%d", "doc_id").alias("key"), F.concat(F.lit("s3/"), F.col("source")).alias("wav"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("txt"), "lang", F.col("n_chars").cast("string").alias("chars"))
    line = F.when(F.col("doc_id") % 11 != 0, F.to_json(row)).otherwise("{\"key\": ")
    return _written(t, t.documents.select(line.alias("value")), "manifest")


ERRORS = "CASE WHEN doc_id % 11 = 0 THEN 'not JSON' WHEN doc_id % 7 = 0 OR text IS NULL THEN 'lacks txt' END"


@query(f"SELECT 'u' || doc_id AS key, 's3/' || source AS wav, md5(text) AS digest, lang, n_chars::VARCHAR AS chars FROM documents WHERE ({ERRORS}) IS NULL")
def manifest_json(t: Tables) -> DataFrame:
    sound, _ = S.quarantine(S.manifest(t.spark, _manifest(t)))
    return sound.select("key", "wav", F.md5("txt").alias("digest"), "lang", F.try_element_at("extras", F.lit("chars")).alias("chars"))


@query(f"SELECT {ERRORS} AS error, count(*) AS n FROM documents WHERE ({ERRORS}) IS NOT NULL GROUP BY ALL")
def manifest_errors(t: Tables) -> DataFrame:
    _, broken = S.quarantine(S.manifest(t.spark, _manifest(t)))
    return broken.groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT CASE k % 3 WHEN 0 THEN -1 WHEN 1 THEN 100 ELSE 50 END::BIGINT AS share, CASE WHEN k % 3 = 0 THEN 'ZeroDivisionError' ELSE '' END AS error, count(*) AS n, sum(CASE WHEN k % 3 = 0 THEN 0 ELSE event_id END)::BIGINT AS ids
    FROM (SELECT event_id, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k FROM events) GROUP BY ALL""")
def tolerant_rows(t: Tables) -> DataFrame:
    """A function of rows that fails for a third of them: these come out with their error."""
    parse = lambda row: {"event_id": row["event_id"], "share": 100 // (json.loads(row["props"])["k"] % 3)}
    rows = t.events.select("event_id", "props")
    out = S.tolerant_map(rows, parse, "event_id long, share long")
    return out.groupBy(F.coalesce("share", F.lit(-1)).alias("share"), F.regexp_extract(F.coalesce("error", F.lit("")), r"^(\w*)", 1).alias("error")).agg(F.count("*").alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))


# Tables of symbols and dictionaries


@query("SELECT n_name AS token, n_nationkey AS id FROM nation")
def symbol_table(t: Tables) -> DataFrame:
    path = _written(t, t.nation.select(F.format_string("%s  %d ", "n_name", "n_nationkey").alias("value")), "symbols")
    return S.symbol_table(t.spark, path)


@query("SELECT c_mktsegment AS item, count(*) AS n FROM customer GROUP BY ALL")
def item_list(t: Tables) -> DataFrame:
    path = _written(t, t.customer.select(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\t")).alias("value")), "items")
    return S.items(t.spark, path).groupBy("item").agg(F.count("*").alias("n"))


@query("SELECT '<' || lower(n_name) || '>' AS symbol FROM nation")
def bracketed_symbols(t: Tables) -> DataFrame:
    path = _written(t, t.nation.select(F.concat(F.lit("<"), F.lower("n_name"), F.lit("> ")).alias("value")), "bracketed")
    return S.bracketed_symbols(t.spark, path)


@query("SELECT DISTINCT p_name AS word, replace(p_name, ' ', '@@ ') AS pieces FROM part")
def segmentation_dictionary(t: Tables) -> DataFrame:
    rows = t.part.select("p_name").distinct()
    path = _written(t, rows.select(F.concat_ws("\t", "p_name", F.replace("p_name", F.lit(" "), F.lit("@@ "))).alias("value")), "segmentation")
    return S.segmentation(t.spark, path)


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM benchmark) GROUP BY word")
def word_frequencies(t: Tables) -> DataFrame:
    counts = bias.word_counts(t.benchmark, "text")
    parts = counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "freq")))).alias("value"))
    return S.word_frequencies(t.spark, _written(t, parts, "frequencies", "part"))


# Times


@query(f"{TIMED} SELECT file::VARCHAR AS file, '0' AS channel, ws / 1000 AS start, 0.4::DOUBLE AS dur, word, 1.0::DOUBLE AS conf FROM t")
def ctm_round_trip(t: Tables) -> DataFrame:
    line = sinks.ctm_line(F.col("file").cast("string"), F.col("start"), F.col("start") + F.col("dur"), F.col("word"), F.lit(1.0))
    return S.ctm(t.spark, _written(t, _words(t).select(line.alias("value")), "ctm"))


@query(f"{TIMED} SELECT file::VARCHAR AS file, round(s / 1000, 3) AS start, round(e / 1000, 3) AS end, label FROM s")
def rttm_round_trip(t: Tables) -> DataFrame:
    line = sinks.rttm_line(F.col("file").cast("string"), F.col("start") / 1000, F.col("end") / 1000, F.col("label"))
    rows = S.rttm(t.spark, _written(t, _segments(_words(t)).select(line.alias("value")), "rttm"))
    return rows.select("file", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "label")


@query(f"{TIMED} SELECT file || ' 1 ' || role || ' ' || printf('%.3f', ws / 1000) || ' ' || printf('%.3f', we / 1000) || ' ' || word AS line, count(*) AS n FROM t GROUP BY line")
def stm_lines(t: Tables) -> DataFrame:
    line = sinks.stm_line(F.col("file").cast("string"), F.col("role"), F.col("start") / 1000, (F.col("start") + F.col("dur")) / 1000, F.col("word"))
    path = _written(t, _words(t).select(line.alias("value")), "stm")
    return S.lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query(f"{TIMED} SELECT file, word_id, printf('%.2f', ws / 1000) || ' ' || printf('%.2f', we / 1000) || ' ' || word AS line FROM t")
def label_lines(t: Tables) -> DataFrame:
    return _words(t).select("file", "word_id", sinks.label_line(F.col("start") / 1000, (F.col("start") + F.col("dur")) / 1000, F.col("word")).alias("line"))


@query(f"""{TIMED} SELECT file, string_agg(word, '' ORDER BY word_id) AS text, avg(1.0 / length(word)) AS confidence, count(*) AS n_tokens, min(ws) AS first, max(we) AS last FROM t GROUP BY file""")
def token_info(t: Tables) -> DataFrame:
    """JSON objects of tokens, written and parsed again: many to a text file, a line each behind its own file's name."""
    tokens = _words(t).select("file", F.col("word_id").alias("idx"), F.col("word").alias("token"), "start", (F.col("start") + F.col("dur")).alias("end"), (1.0 / F.length("word")).alias("confidence"))
    path = _written(t, sinks.token_info(tokens, ["file"]).select(F.concat_ws("\t", F.col("file").cast("string"), "value").alias("value")), "tokens")
    shape = "text string, confidence double, tokens array<struct<token:string,start:double,end:double,confidence:double>>"
    rows = t.spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("file"), F.from_json(F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1), shape).alias("x"))
    return rows.select(F.col("file").cast("long").alias("file"), "x.text", F.round("x.confidence", 9).alias("confidence"), F.size("x.tokens").cast("long").alias("n_tokens"), F.array_min("x.tokens.start").alias("first"), F.array_max("x.tokens.end").alias("last"))


@query("SELECT s.c_nationkey::VARCHAR AS rec, 'u' || s.c_custkey AS utt, count(*) AS n, min(f) AS first, max(f) AS last FROM (SELECT *, unnest(range(c_custkey % 40, c_custkey % 40 + 1 + c_custkey % 9)) AS f FROM customer) s GROUP BY ALL")
def segment_frames(t: Tables) -> DataFrame:
    start = (F.col("c_custkey") % 40) / 100
    end = (F.col("c_custkey") % 40 + 1 + F.col("c_custkey") % 9) / 100
    lines = t.customer.select(F.concat_ws(" ", F.concat(F.lit("u"), F.col("c_custkey")), "c_nationkey", start.cast("string"), end.cast("string")).alias("value"))
    rows = S.segment_frames(t.spark, _written(t, lines, "segments"))
    return rows.groupBy("rec", "utt").agg(F.count("*").alias("n"), F.min("frame_idx").cast("long").alias("first"), F.max("frame_idx").cast("long").alias("last"))


# Results and statistics


@query("SELECT (n_nationkey % 3)::BIGINT AS insertions, (n_nationkey % 5)::BIGINT AS deletions, (n_nationkey % 7)::BIGINT AS substitutions, (n_nationkey % 3 + n_nationkey % 5 + n_nationkey % 7)::BIGINT AS num_errors, n_nationkey::BIGINT AS num_ref FROM nation")
def alignment_counts(t: Tables) -> DataFrame:
    n = [(F.col("n_nationkey") % m).alias(k) for m, k in ((3, "insertions"), (5, "deletions"), (7, "substitutions"))]
    best = F.struct(*n, (F.col("n_nationkey") % 3 + F.col("n_nationkey") % 5 + F.col("n_nationkey") % 7).alias("numErrors"), F.col("n_nationkey").alias("numWordsInReference"))
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.struct(best.alias("bestWER")).alias("wer"))).alias("value"))
    return S.alignment_counts(t.spark, _written(t, rows, "aligned", "id")).drop("file")


@query("SELECT o_orderstatus AS dataset, o_orderkey::VARCHAR AS checkpoint, o_totalprice AS loss, o_totalprice / 2 AS acc_att, o_custkey::DOUBLE AS loss_tel FROM orders")
def loss_lines(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").cast("string").alias("checkpoint"), F.col("o_totalprice").alias("loss"), (F.col("o_totalprice") / 2).alias("acc_att"), F.col("o_custkey").cast("double").alias("loss_tel"))
    path = stage_path(t.spark, "losses")
    sinks.append_losses(rows.filter("dataset = 'F'"), path)
    sinks.append_losses(rows.filter("dataset <> 'F'"), path)
    return S.losses(t.spark, path, ("tel",)).select("dataset", "checkpoint", "loss", "acc_att", "loss_tel")


@query("SELECT n_nationkey % 20 AS epoch, n_nationkey::BIGINT * 1000 AS step, n_regionkey + 0.5::DOUBLE AS loss, n_name AS tag FROM nation")
def snapshot_files(t: Tables) -> DataFrame:
    # A repeated field counts with its last value.
    text = F.concat_ws("\n", F.lit("epoch: 99"), F.lit("loss: 0.25"), F.concat(F.lit("epoch: "), F.col("n_nationkey") % 20), F.concat(F.lit("step: "), F.col("n_nationkey") * 1000), F.concat(F.lit("loss: "), F.col("n_regionkey") + 0.5, F.lit("  # of the last epoch")), F.concat(F.lit("tag: "), F.col("n_name")))
    rows = t.nation.select("n_nationkey", text.alias("value"))
    return S.snapshots(t.spark, _written(t, rows, "snapshots", "n_nationkey")).select("epoch", "step", "loss", "tag")


DIMS = "SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"


def _sums(t: Tables) -> DataFrame:
    """(n, mean_stat, var_stat): one row."""
    stats = features.statistics(t.embeddings, "embedding")
    ordered = F.array_sort(F.collect_list(F.struct("dim", "total", "squares")))
    return stats.groupBy("n").agg(ordered.alias("x")).select("n", F.transform("x", lambda r: r["total"]).alias("mean_stat"), F.transform("x", lambda r: r["squares"]).alias("var_stat"))


STATS = f"SELECT dim::INT AS dim, count(*) AS n, round(sum(x), 4) AS total, round(sum(x * x), 4) AS squares FROM ({DIMS}) GROUP BY dim"


@query(STATS)
def cmvn_file(t: Tables) -> DataFrame:
    text = _sums(t).select(F.to_json(F.struct("mean_stat", "var_stat", F.col("n").alias("frame_num"))).alias("value"))
    return S.cmvn(t.spark, _written(t, text, "cmvn")).select("dim", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))


@query(STATS)
def cmvn_text_file(t: Tables) -> DataFrame:
    row = lambda xs, last: F.concat_ws(" ", F.transform(xs, lambda v: v.cast("string")), last.cast("string"))
    text = _sums(t).select(F.concat(F.lit(" [\n  "), row(F.col("mean_stat"), F.col("n")), F.lit("\n  "), row(F.col("var_stat"), F.lit(0)), F.lit(" ]")).alias("value"))
    return S.cmvn_text(t.spark, _written(t, text, "cmvn-text")).select("dim", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))


@query("""SELECT name || ':' || chr(9) || n || '/' || ref || ' = ' || printf('%.2f', 100.0::DOUBLE * n / ref) || '%' AS value
    FROM (SELECT sum(l_linenumber)::BIGINT AS i, sum(l_orderkey % 3)::BIGINT AS d, sum(l_partkey % 4)::BIGINT AS s, sum(l_quantity + 20)::BIGINT AS ref FROM lineitem),
    LATERAL (SELECT 'WER' AS name, i + d + s AS n UNION ALL SELECT 'INS', i UNION ALL SELECT 'DEL', d UNION ALL SELECT 'SUB', s)""")
def wer_summary(t: Tables) -> DataFrame:
    n = {"insertions": F.col("l_linenumber").cast("long"), "deletions": F.col("l_orderkey") % 3, "substitutions": F.col("l_partkey") % 4}
    rows = t.lineitem.select(*[c.alias(k) for k, c in n.items()], (n["insertions"] + n["deletions"] + n["substitutions"]).alias("num_errors"), (F.col("l_quantity") + 20).cast("long").alias("num_ref"))
    return t.spark.read.text(_written(t, scoring.summary(scoring.word_error_rate(rows)), "summary"))


# Archives: made in tasks, a shard of 20 pages an archive


def _pack(kind: str):
    """pages of a shard as one archive (path, content)."""

    def members(pdf: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        for r in pdf.sort_values("page_id").itertuples(index=False):
            yield f"p{r.page_id}.wav", b"RIFF" + str(r.page_id).encode()
            yield f"p{r.page_id}.txt", (r.html or "").encode()
            yield f"p{r.page_id}.url", r.url.encode()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, shard = io.BytesIO(), int(pdf["shard"].iloc[0])
        if kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in members(pdf):
                    z.writestr(name, data)
        else:
            with tarfile.open(fileobj=out, mode="w:gz" if kind == "tar.gz" else "w") as tar:
                for name, data in members(pdf):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"path": [f"shard-{shard}.{kind}"], "content": [out.getvalue()]})

    return pack


def _archive(t: Tables, kind: str) -> DataFrame:
    pages = t.pages.select(F.floor(F.col("page_id") / 20).alias("shard"), "page_id", "url", "html")
    return pages.groupBy("shard").applyInPandas(_pack(kind), "path string, content binary")


def _stored(t: Tables, kinds: dict[str, str]) -> str:
    """A folder with the archives of each kind in kinds, the values their suffixes; tasks write them."""
    folder = stage_path(t.spark, "archives")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, name = files.system(folder)
        where.create_dir(name)
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                with where.open_output_stream(f"{name}/{path}", compression=None) as f:
                    f.write(data)
            yield pdf[["path"]]

    for kind, suffix in kinds.items():
        named = _archive(t, kind).withColumn("path", F.replace("path", F.lit(f".{kind}"), F.lit(f".{suffix}")))
        named.mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()
    return folder


def _samples(t: Tables, kind: str) -> DataFrame:
    rows = archives.archives(t.spark, _stored(t, {kind: kind}), range_bytes=1 << 16).withColumn("file_name", F.element_at(F.split("file_name", "/"), -1))
    return rows.select("key", "file_name", F.decode("wav", "utf-8").alias("wav"), F.md5("txt").alias("digest"), F.try_element_at("extras", F.lit("url")).alias("url"), "error")


def _samples_sql(kind: str) -> str:
    return f"SELECT 'p' || page_id AS key, 'shard-' || page_id // 20 || '.{kind}' AS file_name, 'RIFF' || page_id AS wav, md5(trim(coalesce(html, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest, url, NULL::VARCHAR AS error FROM pages"


@query(_samples_sql("tar"))
def tar_shards(t: Tables) -> DataFrame:
    return _samples(t, "tar")


@query(_samples_sql("zip"))
def zip_shards(t: Tables) -> DataFrame:
    return _samples(t, "zip")


@query("""SELECT kind, count(*) AS n_rows, count(*) FILTER (WHERE kind = 'bin') AS n_errors FROM (SELECT DISTINCT page_id // 20 AS shard, 'bin' AS kind FROM pages UNION ALL SELECT page_id, 'tar.gz' FROM pages UNION ALL SELECT page_id, 'zip' FROM pages) GROUP BY kind""")
def archive_kinds(t: Tables) -> DataFrame:
    """Archives of three kinds told apart by suffix; one of no known kind is one row with an error."""
    rows = archives.archives(t.spark, _stored(t, {"tar.gz": "tar.gz", "zip": "zip", "tar": "bin"}))
    return rows.groupBy(F.regexp_extract("file_name", r"shard-\d+\.(.*)$", 1).alias("kind")).agg(F.count("*").alias("n_rows"), F.count("error").alias("n_errors"))


def _waves(t: Tables) -> DataFrame:
    """embeddings as 16-bit mono waves of 8 kHz."""

    @F.pandas_udf("binary")
    def encode(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            data = io.BytesIO()
            with wave.open(data, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(8000)
                w.writeframes(np.floor(np.clip(np.asarray(x, dtype=np.float64), -1, 1) * 32767).astype("<i2").tobytes())
            out.append(data.getvalue())
        return pd.Series(out)

    return t.embeddings.select("vec_id", encode("embedding").alias("wav"), F.lit(None).cast("string").alias("error"))


@query("SELECT vec_id, 8000 AS sample_rate, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: floor(greatest(-1, least(1, x::DOUBLE)) * 32767) / 32768)), 6) AS total FROM embeddings")
def wave_samples(t: Tables) -> DataFrame:
    rows = archives.waves(_waves(t))
    return rows.select("vec_id", "sample_rate", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[9:16], lambda x: floor(greatest(-1, least(1, x::DOUBLE)) * 32767) / 32768)), 6) AS total FROM embeddings")
def wave_slices(t: Tables) -> DataFrame:
    """Samples from 1 ms to 2 ms of 8 kHz waves."""
    rows = archives.waves(_waves(t))
    part: Column = S.slice_audio(F.col("samples"), F.col("sample_rate"), F.lit(0.001), F.lit(0.002))
    return rows.select("vec_id", F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# Keyed binary archives


@query("""SELECT 'i' || vec_id AS key, 'ints' AS kind, label + 7.0::DOUBLE AS total FROM embeddings UNION ALL SELECT 'v' || vec_id, 'vector', round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) FROM embeddings
    UNION ALL SELECT 'm' || vec_id, 'matrix', round(2 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) FROM embeddings""")
def binary_records(t: Tables) -> DataFrame:
    """Integer vectors, vectors and matrices as binary records, written with their indexes and read by these."""
    e, none = t.embeddings, [F.lit(None).cast(k) for k in ("array<int>", "array<double>", "array<array<double>>")]
    x = F.col("embedding").cast("array<double>")
    named = lambda prefix, *cols: e.select(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).alias("key"), *[c.alias(n) for c, n in zip(cols, ("ints", "vector", "matrix"), strict=True)])
    rows = named("i", F.array("label", F.lit(7)), none[1], none[2]).unionByName(named("v", none[0], x, none[2])).unionByName(named("m", none[0], none[1], F.array(x, x)))
    ark.register(t.spark)
    folder = stage_path(t.spark, "records")
    rows.write.format("ark").mode("append").save(folder)
    back = t.spark.read.format("ark").load(folder)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    kind = F.when(F.col("ints").isNotNull(), "ints").when(F.col("vector").isNotNull(), "vector").otherwise("matrix")
    total = F.coalesce(F.aggregate("ints", F.lit(0.0), lambda a, v: a + v), F.round(add(F.col("vector")), 4), F.round(add(F.flatten("matrix")), 4))
    return back.select("key", kind.alias("kind"), total.alias("total"))


@query("SELECT 'r' || c_custkey AS key, 'part-' || c_nationkey || '.ark' AS path, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS offset FROM customer")
def index_lines(t: Tables) -> DataFrame:
    at = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(":"), F.col("c_custkey"))).otherwise("")
    lines = t.customer.select(F.concat(F.lit("r"), F.col("c_custkey"), F.lit(" part-"), F.col("c_nationkey"), F.lit(".ark"), at).alias("value"))
    return ark.index_lines(t.spark, _written(t, lines, "index"))


@query("SELECT url, page_id FROM pages WHERE page_id % 4 <> 0")
def list_difference(t: Tables) -> DataFrame:
    """Paths of a list without those of another, both read from files."""
    every = S.items(t.spark, _written(t, t.pages.select(F.concat_ws(" ", "page_id", "url").alias("value")), "list"))
    gone = S.items(t.spark, _written(t, t.pages.filter("page_id % 4 = 0").select(F.concat_ws(" ", "page_id", "url").alias("value")), "list"))
    left = bias.list_difference(every.withColumnRenamed("item", "path"), gone.withColumnRenamed("item", "path"))
    return left.select(F.regexp_extract("path", r"^\d+ (.*)$", 1).alias("url"), F.regexp_extract("path", r"^(\d+) ", 1).cast("long").alias("page_id"))


def _packed(t: Tables, kind: str, value: Column) -> DataFrame:
    """embeddings as one record a file (content), with a value of pairs; few rows at a time are Python objects."""
    light_batches(t.spark)

    @F.pandas_udf("binary")
    def encode(keys: pd.Series, values: pd.Series) -> pd.Series:
        pairs = lambda xs: [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in xs]
        return pd.Series([f"k{k} ".encode() + ark.encode_pairs(kind, [pairs(xs) for xs in v] if kind == "posterior" else pairs(v)) for k, v in zip(keys, values, strict=True)])

    return t.embeddings.select(encode("vec_id", value).alias("content"))


@query("SELECT 'k' || vec_id AS key, 2 AS n_frames, sum(i - 1) * 2 AS places, round(2 * sum(x::DOUBLE), 4) AS total FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE x > 0 GROUP BY vec_id")
def posterior_records(t: Tables) -> DataFrame:
    """Posteriors of two equal frames, which have the positive values by their place."""
    frame = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("index"), x.alias("value"))), lambda p: p["value"] > 0)
    rows = ark.explode_ark(_packed(t, "posterior", F.array(frame, frame)), "posterior").withColumn("all", F.flatten("posterior"))
    places = F.aggregate("all", F.lit(0).cast("long"), lambda a, p: a + p["index"])
    return rows.select("key", F.size("posterior").alias("n_frames"), places.alias("places"), F.round(F.aggregate("all", F.lit(0.0), lambda a, p: a + p["value"]), 4).alias("total"))


@query("SELECT 'k' || vec_id AS key, len(embedding) AS n, (len(embedding) - 1) * 0.5::DOUBLE AS last_begin, len(embedding) * 0.5::DOUBLE AS last_end FROM embeddings")
def network_times(t: Tables) -> DataFrame:
    """Begin and end of bins of half a second."""
    times = F.transform("embedding", lambda x, i: F.struct((i * 0.5).alias("begin"), (i * 0.5 + 0.5).alias("end")))
    rows = ark.explode_ark(_packed(t, "times", times), "times").withColumn("last", F.element_at("times", -1))
    return rows.select("key", F.size("times").cast("long").alias("n"), F.col("last.begin").cast("double").alias("last_begin"), F.col("last.end").cast("double").alias("last_end"))
