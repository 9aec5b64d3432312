"""A training-data pipeline from a configuration: named stages, each switched on or off, composed with df.transform."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.files import open_range
from ..functions.rand import uniform
from ..functions.stage import materialise
from ..functions.text import char_tokens, strip
from ..operators import batching, bias, features, filters, language, ranking, vocab
from ..sources import archives
from ..sources import text as S

Stage = Callable[[DataFrame], DataFrame]

DEFAULTS: dict[str, Any] = {
    "special_tokens": False, "special_tokens_conf": {},
    "speakers": False, "speakers_conf": {"table": None},
    "language": False, "language_conf": {"model": None},
    "category": False, "category_conf": {"column": "lang", "ids": {}, "n": 1, "force": ()},
    "bias": False, "bias_conf": {"threshold": 20, "n_order": 3, "p_keep": 1.0},
    "collate": False, "collate_conf": {"feats": "feats", "more": (), "padded": ()},
    "tokenize": True, "tokenize_conf": {"symbols": False, "vocab": {"<unk>": 1}},
    "filter": True, "filter_conf": {},
    "speech_rate": False,
    "skip_tagged": False, "skip_tagged_conf": {"p": 0.0},
    "task": True,
    "shuffle": True, "shuffle_conf": {"seed": 0, "epoch": 0},
    "sort": True, "sort_conf": {"buffer": 500},
    "batch_conf": {"batch_type": "dynamic", "max_frames": 12000, "n": 16, "boundaries": [500, 1000], "sizes": [32, 16, 8], "job": None, "one_per_job": True, "max_words_per_epoch": -1, "max_words_per_batch": -1},
}
#: Of waves: off, but for framing. Each has its settings behind _conf.
WAVES: dict[str, Any] = {
    "resample": False, "resample_conf": {"rate": 16000},
    "speed": False, "speed_conf": {"speeds": (0.9, 1.0, 1.1)},
    "impulse": False, "impulse_conf": {"bank": None, "n": 0, "p": 0.2},
    "telephony": False, "telephony_conf": {"rate": 8000, "p": 0.2},
    "frames": True, "frames_conf": {"kind": "filter_bank"},
    "normalise": False, "normalise_conf": {"table": None},
    "substitute": False, "substitute_conf": {}, "mask": False, "mask_conf": {}, "trim": False, "trim_conf": {},
}
WAVE_ORDER = ("resample", "speed", "impulse", "telephony", "frames", "normalise", "substitute", "mask", "trim")
FRAMES = {"filter_bank": features.filter_bank, "mfcc": features.mfcc, "log_mel": features.log_mel_spectrogram}
RANDOM = ("skip_tagged", "shuffle", "speed", "impulse", "telephony", "substitute", "mask", "trim")
ORDER = ("special_tokens", "speakers", "language", "tokenize", "filter", "speech_rate", "skip_tagged", "category", "task", "bias", "sort", "batch", "collate")


def override(conf: dict[str, Any], *settings: str) -> dict[str, Any]:
    """conf with dotted settings such as ``batch_conf.n 32``; a value takes the old one's type, true and True are booleans."""
    out = copy.deepcopy(conf)
    for setting in settings:
        path, value = setting.split(" ", 1)
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at = at[p]
        old = at.get(last)
        at[last] = value in ("true", "True") if isinstance(old, bool) else type(old)(value) if old is not None else value
    return out


def preset(conf: dict[str, Any], name: str) -> dict[str, Any]:
    """eval: all bounds open and no random stage; cv: no random stage, and quota batches as plain dynamic ones; telephony and echo: cv with every wave at the rate of a telephone, or under an impulse response of the bank."""
    out = conf | {k: copy.deepcopy(v) for k, v in conf.items() if k.endswith("_conf") and not any(isinstance(x, DataFrame) for x in v.values())}
    for stage in RANDOM:
        out[stage] = False
    if name in ("telephony", "echo"):
        stage = "impulse" if name == "echo" else name
        out |= {stage: True, f"{stage}_conf": WAVES[f"{stage}_conf"] | out.get(f"{stage}_conf", {}) | {"p": 1.0}}
    if name == "eval":
        out["filter_conf"] = {"max_length": 1e9, "min_length": 0, "token_max_length": 1 << 30, "token_min_length": 0, "min_output_input_ratio": 0.0, "max_output_input_ratio": 1e9}
    if name != "eval" and out.get("batch_conf", {}).get("batch_type") == "distribute":
        out["batch_conf"]["batch_type"] = "dynamic"
    return out


def build_pipeline(conf: dict[str, Any], order: tuple[str, ...] = ORDER) -> Stage:
    """From (shard, pos, key, txt, n_frames) to the same with tokens, label and batch_id. Texts are cleaned before they are tokenised unless ``order`` says otherwise."""
    conf = DEFAULTS | conf

    def tokenize(df: DataFrame) -> DataFrame:
        c = DEFAULTS["tokenize_conf"] | conf["tokenize_conf"]
        if not c["symbols"] and c["vocab"].get("<unk>") is not None:  # a label a character: the filter needs no tokens, which it would make once more
            df = df.withColumn("_n_label", F.length(strip(F.col("txt"))))
        return df.withColumn("tokens", char_tokens(F.col("txt"), c["symbols"])).withColumn("label", vocab.encode(F.col("tokens"), c["vocab"]))

    def length_filter(df: DataFrame) -> DataFrame:
        n = F.col("_n_label") if "_n_label" in df.columns else F.size("label") if "label" in df.columns else F.lit(None).cast("int")
        return filters.length_filter(df, F.col("n_frames"), n, filters.Bounds(**conf["filter_conf"]))

    def sort(df: DataFrame) -> DataFrame:
        s = conf["shuffle_conf"]
        first = F.xxhash64("key", F.lit(s["seed"]), F.lit(s["epoch"])) if conf["shuffle"] else F.col("pos")
        ranked = ranking.sorted_blocks(df.withColumn("_o", first), ["shard"], ["_o", "key"], "n_frames", conf["sort_conf"]["buffer"])
        return ranked.drop("_o")

    def sort_and_batch(df: DataFrame) -> DataFrame:
        """sort, then dynamic batches: only places of rows are ordered and cut. Tokens and labels, if their texts are as they were, are made at the end alone."""
        before = names[: names.index("sort_and_batch")]
        late = "tokenize" in before and "special_tokens" not in before[before.index("tokenize") :]
        rows = materialise((df.drop("tokens", "label", "_n_label") if late else df).withColumn("_id", F.monotonically_increasing_id()), "pipeline-rows")
        ranked = materialise(sort(rows.select("_id", "shard", "pos", "key", "n_frames")).drop("pos"), "pipeline-ranks")
        kept = batching.dynamic_batch(ranked, "shard", ["block", "rank"], "key", "n_frames", (DEFAULTS["batch_conf"] | conf["batch_conf"])["max_frames"])
        placed = ranked.join(kept.filter("batch_id IS NOT NULL"), ["shard", "key"]).select("_id", "block", "rank", "batch_id")
        joined = rows.join(placed, "_id")
        return (tokenize(joined) if late else joined).select("shard", "key", *[c for c in df.columns if c not in ("shard", "key")], "block", "rank", "batch_id")

    def batch(df: DataFrame) -> DataFrame:
        c = DEFAULTS["batch_conf"] | conf["batch_conf"]
        by = ["block", "rank"] if "rank" in df.columns else ["pos"]
        if c["batch_type"] == "static":
            return batching.static_batch(df, ["shard"], by, c["n"])
        if c["batch_type"] == "bucket":
            return batching.bucket_batch(df, ["shard"], by, "n_frames", c["boundaries"], c["sizes"])
        if c["batch_type"] == "distribute":
            job = F.col(c["job"]) if c["job"] else F.lit(None).cast("string")
            kept = batching.distribute_batch(df.withColumn("_job", job), "shard", by, "key", "n_frames", "_job", "txt", c["max_frames"], c["one_per_job"] and bool(c["job"]), c["max_words_per_epoch"], c["max_words_per_batch"])
        else:
            kept = batching.dynamic_batch(df, "shard", by, "key", "n_frames", c["max_frames"])
        return df.join(kept.filter("batch_id IS NOT NULL"), ["shard", "key"])

    def of(name: str) -> dict[str, Any]:
        return DEFAULTS[f"{name}_conf"] | conf[f"{name}_conf"]

    def spoken(df: DataFrame) -> DataFrame:
        found = language.detect(df, of("language")["model"], "key", "txt").select("key", "language")
        return df.join(found, "key", "left")

    def category(df: DataFrame) -> DataFrame:
        c = of("category")
        return df.withColumn("category", filters.category_vector(F.col(c["column"]), c["ids"], c["n"], tuple(c["force"])))

    def phrases(df: DataFrame) -> DataFrame:
        c = of("bias")
        counts = materialise(bias.word_counts(df, "txt"), "word-counts")
        rare, common = bias.rare_words(counts, c["threshold"]), bias.common_words(counts, c["threshold"])
        return df.join(bias.bias_phrases(df, rare, n_order=c["n_order"], p_keep=c["p_keep"], common=common), "key", "left")

    stages: dict[str, Stage] = {
        "speakers": lambda df: filters.speaker_ids(df, of("speakers")["table"]), "language": spoken, "category": category, "bias": phrases,
        "collate": lambda df: batching.collate(df, ["shard", "batch_id"], "key", of("collate")["feats"], "label", more=tuple(of("collate")["more"]), padded=tuple(of("collate")["padded"])),
        "special_tokens": lambda df: filters.special_tokens(df, filters.SpecialTokens(**conf["special_tokens_conf"])),
        "tokenize": tokenize, "filter": length_filter,
        "speech_rate": lambda df: df.filter(filters.speech_rate_reason(F.col("txt"), F.col("n_frames") / 100).isNull()),
        "skip_tagged": lambda df: filters.skip_tagged(df, F.col("txt"), F.col("key"), conf["skip_tagged_conf"]["p"]),
        "task": filters.task, "sort": sort, "batch": batch, "sort_and_batch": sort_and_batch,
    }
    names = [name for name in order if conf.get(name, True)]
    if (DEFAULTS["batch_conf"] | conf["batch_conf"])["batch_type"] == "dynamic" and ("sort", "batch") in zip(names, names[1:], strict=False):
        at = names.index("sort")
        names[at : at + 2] = ["sort_and_batch"]

    def run(df: DataFrame) -> DataFrame:
        for name in names:
            df = df.transform(stages[name])
        return df.drop("_n_label")

    return run


def build_features(conf: dict[str, Any], order: tuple[str, ...] = WAVE_ORDER) -> Stage:
    """From waves (key, samples, sample_rate) to frames (key, frame_idx, feat), by the stages that conf switches on."""
    conf = WAVES | conf

    def of(name: str) -> dict[str, Any]:
        return WAVES[f"{name}_conf"] | conf.get(f"{name}_conf", {})

    def resample(df: DataFrame) -> DataFrame:
        rate = of("resample")["rate"]
        return features.change_waves(df, lambda x, r: features.resample(x, int(r), rate), "sample_rate").withColumn("sample_rate", F.lit(rate))

    def impulse(df: DataFrame) -> DataFrame:
        c = of("impulse")
        paired = vocab.random_partner(df, c["bank"], c["n"], p=c["p"])
        under = lambda x, h, r: x if h is None else features.convolve_impulse(x, np.asarray(h, dtype=np.float64), int(r))
        return features.change_waves(paired, under, "impulse", "sample_rate").drop("bank_id", "impulse")

    def telephony(df: DataFrame) -> DataFrame:
        c = of("telephony")
        thin = lambda x, r, on: features.resample(features.resample(x, int(r), c["rate"]), c["rate"], int(r)) if on else x
        marked = df.withColumn("_on", uniform("key", op="telephony") < c["p"])
        return features.change_waves(marked, thin, "sample_rate", "_on").drop("_on")

    def count(df: DataFrame, stage: Callable[[DataFrame, Any], DataFrame]) -> DataFrame:
        return stage(df.withColumn("_n", F.count("*").over(Window.partitionBy("key"))), F.col("_n")).drop("_n")

    stages: dict[str, Stage] = {
        "resample": resample, "impulse": impulse, "telephony": telephony,
        "speed": lambda df: features.speed(df, speeds=tuple(of("speed")["speeds"])).drop("speed"),
        "frames": lambda df: features.to_frames(df, FRAMES[of("frames")["kind"]]),
        "normalise": lambda df: features.normalise(df, of("normalise")["table"]),
        "substitute": lambda df: count(df, lambda x, n: features.substitute_earlier(x, n, **of("substitute"))),
        "mask": lambda df: count(df, lambda x, n: features.mask_features(x, n, **of("mask"))),
        "trim": lambda df: count(df, lambda x, n: features.trim_tail(x, n, **of("trim"))),
    }

    def run(df: DataFrame) -> DataFrame:
        for name in order:
            if conf[name]:
                df = df.transform(stages[name])
        return df

    return run


def read_corpus(spark: SparkSession, path: str | list[str], kind: str = "raw") -> DataFrame:
    """(shard, pos, key, txt, extras, wav, error) of JSON-line manifests (raw, with paths of waves that tasks open) or archives (shard)."""
    if kind == "shard":
        rows = archives.archives(spark, path).withColumn("shard", F.col("tar_file_name"))
    else:

        @F.pandas_udf("binary")
        def content(paths: pd.Series) -> pd.Series:
            out = []
            for p in paths:
                try:
                    with open_range(p) as f:
                        out.append(f.read())
                except (OSError, TypeError):
                    out.append(None)
            return pd.Series(out, dtype=object)

        rows = S.manifest(spark, path).withColumn("shard", F.col("file_name")).withColumn("wav", content("wav"))
    error = F.coalesce("error", F.when(F.col("wav").isNull(), "no wave").when(F.col("txt").isNull(), "no text"))
    return rows.select("shard", F.col("key").alias("pos"), "key", "txt", "extras", "wav", error.alias("error"))


def build_corpus(spark: SparkSession, conf: dict[str, Any], path: str | list[str], kind: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(what ``build_pipeline`` makes of a corpus of files, rows with an error). Waves are decoded once; feats has a key's frames in order, n_frames their number. Keys must be unique."""
    decoded = materialise(archives.waves(read_corpus(spark, path, kind)), "corpus")
    sound, bad = S.quarantine(decoded)
    frames = build_features(conf)(sound.select("key", "samples", "sample_rate"))
    feats = frames.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "feat"))).alias("_f"))
    feats = feats.select("key", F.transform("_f", lambda x: x["feat"]).alias("feats"), F.size("_f").alias("n_frames"))
    return build_pipeline(conf)(sound.drop("samples", "sample_rate").join(feats, "key")), bad.select("shard", "key", "error")
