"""Readers of line formats. Paths are Spark paths; nothing is opened on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BRACKETED, strip

UTTERANCE = "key string, wav string, txt string, start double, end double, speaker string, lang string"
LOSS = ("dataset string", "checkpoint string", "time_to_process double", "loss double", "acc_att double")
ALIGNMENT = "wer struct<bestWER: struct<insertions: bigint, deletions: bigint, substitutions: bigint, numErrors: bigint, numWordsInReference: bigint>>"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_name, line)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("line"))


def manifest(spark: SparkSession, path: str | list[str], schema: str = UTTERANCE) -> DataFrame:
    """Utterances of JSON lines with file_name and extras (fields that the schema lacks); rows that lack key, wav or txt, or don't parse, have an error."""
    raw = lines(spark, path).withColumn("_all", F.from_json("line", "map<string,string>")).withColumn("_x", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    missing = F.filter(F.array(*[F.when(F.col(f"_x.{c}").isNull(), F.lit(c)) for c in ("key", "wav", "txt")]), lambda c: c.isNotNull())
    error = F.when(F.col("_x._bad").isNotNull() | F.col("_all").isNull(), "not JSON").when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", ")))
    extras = F.map_filter("_all", lambda k, v: ~k.isin(*names))
    return raw.select("file_name", *[F.col(f"_x.{c}").alias(c) for c in names], extras.alias("extras"), error.alias("error"))


def quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(sound rows, rows with an error)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def tolerant_map(df: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """f of each row, as a dict, with an error: where f raises, its fields are null and the error says why. For what no column function can do."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    got = f(row)
                    out.append([*(got.get(n) for n in names), None])
                except Exception as e:  # whatever a user's function raises is data here
                    out.append([*(None for _ in names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return df.mapInPandas(run, f"{schema}, error string")


def symbol_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, id); a line without exactly two fields is an error."""
    fields = F.split(strip(F.col("value")), r"(?U)\s+")
    checked = F.when(F.size(fields) == 2, fields).otherwise(F.raise_error(F.concat(F.lit("not a token and an id: "), F.col("value"))).cast("array<string>"))
    return spark.read.text(path).select(checked.alias("f")).select(F.col("f")[0].alias("token"), F.col("f")[1].cast("int").alias("id"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """(item): one stripped line each."""
    return spark.read.text(path).select(strip(F.col("value")).alias("item"))


def bracketed_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol): each in brackets of one kind, or an error."""
    s = strip(F.col("value"))
    return spark.read.text(path).select(F.when(s.rlike(f"^({BRACKETED})$"), s).otherwise(F.raise_error(F.concat(F.lit("not a bracketed symbol: "), s)).cast("string")).alias("symbol"))


def segmentation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, pieces string").option("sep", "\t").option("quote", "").csv(path)


def ctm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, channel string, start double, dur double, word string, conf double").option("sep", " ").option("quote", "").csv(path)


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end, label) of the speaker lines."""
    f = F.split(strip(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).filter("f[0] = 'SPEAKER'")
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(at(1).alias("file"), at(3).cast("double").alias("start"), (at(3).cast("double") + at(4).cast("double")).alias("end"), at(7).alias("label"))


def alignment_counts(spark: SparkSession, path: str) -> DataFrame:
    """A row a file of aligner results, named as scoring names them."""
    best = spark.read.schema(ALIGNMENT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "wer.bestWER.*")
    return best.select("file", "insertions", "deletions", "substitutions", F.col("numErrors").alias("num_errors"), F.col("numWordsInReference").alias("num_ref"))


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "freq"))


def losses(spark: SparkSession, path: str, conditions: tuple[str, ...] = ()) -> DataFrame:
    """Losses and accuracies by dataset and checkpoint; for each further condition, fields of its name behind ``loss_`` and ``acc_att_``."""
    more = [f"{m}_{c} double" for c in conditions for m in ("loss", "acc_att")]
    return spark.read.schema(", ".join((*LOSS, *more))).json(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A row for each flat YAML file of scalars: path, a map of its fields (of a repeated one the last), and epoch, step, loss, tag."""
    field = F.lit(r"(?m)^(\w+): *([^\n#]*?) *(?:#.*)?$")
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), *[F.regexp_extract_all("value", field, F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "v"))])
    pairs = F.filter(F.arrays_zip("k", "v"), lambda x, i: ~F.array_contains(F.slice(F.col("k"), i + 2, F.size("k")), x["k"]))
    rows = text.select("path", F.map_from_entries(pairs).alias("fields"))
    get: dict[str, Column] = {n: F.try_element_at("fields", F.lit(n)) for n in ("epoch", "step", "loss", "cv_loss", "tag")}
    return rows.select("path", "fields", get["epoch"].cast("int").alias("epoch"), get["step"].cast("bigint").alias("step"), F.coalesce(get["loss"], get["cv_loss"]).try_cast("double").alias("loss"), get["tag"].alias("tag"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, other) word arrays of lines ``phrase | other ; other``; ``#`` begins a comment."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    rows = spark.read.text(path).select(F.split(line, r"\|", 2).alias("x")).filter(F.size("x") == 2)
    rows = rows.select(F.get("x", F.lit(0)).alias("phrase"), F.explode(F.split(F.get("x", F.lit(1)), ";")).alias("other"))
    return rows.select(*[F.filter(F.split(c, r"\s+"), lambda w: w != "").alias(c) for c in ("phrase", "other")]).filter(F.size("phrase") > 0)


def norms(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, words) of JSON files of normalised forms: for each label of a reference its candidates' words."""
    kind = "map<string,struct<candidates:array<struct<verbalization:array<string>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", kind)).alias("label", "x"))
    return rows.select("path", "label", F.explode("x.candidates").alias("c")).select("path", "label", F.col("c.verbalization").alias("words"))


def cmvn(spark: SparkSession, path: str) -> DataFrame:
    """(dim, n, total, squares) of a JSON file of sums."""
    x = spark.read.schema("mean_stat array<double>, var_stat array<double>, frame_num bigint").option("multiLine", True).json(path)
    return x.select("frame_num", F.posexplode(F.arrays_zip("mean_stat", "var_stat"))).select(F.col("pos").alias("dim"), F.col("frame_num").alias("n"), F.col("col.mean_stat").alias("total"), F.col("col.var_stat").alias("squares"))


def cmvn_text(spark: SparkSession, path: str) -> DataFrame:
    """The same of the bracketed text form: the sums and the count, then the squares and a 0."""
    rows = spark.read.text(path, wholetext=True).select(F.transform(F.regexp_extract_all(F.regexp_extract("value", r"(?s)\[(.*)\]", 1), F.lit(r"[^\s\[\]]+"), F.lit(0)), lambda v: v.cast("double")).alias("v"))
    half = (F.size("v") / 2).cast("int")
    return rows.select(F.element_at("v", half).cast("bigint").alias("n"), F.posexplode(F.arrays_zip(F.slice("v", F.lit(1), half - 1).alias("a"), F.slice("v", half + 1, half - 1).alias("b")))).select(F.col("pos").alias("dim"), "n", F.col("col.a").alias("total"), F.col("col.b").alias("squares"))


def segment_frames(spark: SparkSession, path: str, per_second: int = 100) -> DataFrame:
    """(rec, utt, frame_idx) of the frames inside segments; ends are rounded half to even."""
    s = spark.read.schema("utt string, rec string, beg double, end double").option("sep", " ").csv(path)
    low, high = F.rint(per_second * F.col("beg")).cast("int"), F.rint(per_second * F.col("end")).cast("int") - 1
    return s.filter(low <= high).select("rec", "utt", F.explode(F.sequence(low, high)).alias("frame_idx"))


def slice_audio(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    a, b = (start * rate).cast("int"), (end * rate).cast("int")
    return F.slice(samples, a + 1, b - a)
