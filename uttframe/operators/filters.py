"""Utterance filters and projections. Times are seconds, frames are 10 ms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..functions.text import SWITCH, bind, count_words, split_words, strip


@dataclass(frozen=True)
class Bounds:
    """All bounds keep what lies on them. Token bounds hold where there are tokens, ratios where there are frames."""

    max_length: float = 10240
    min_length: float = 10
    token_max_length: int = 200
    token_min_length: int = 1
    min_output_input_ratio: float = 0.0005
    max_output_input_ratio: float = 1


def n_frames(samples: Column, sample_rate: Column) -> Column:
    return samples / sample_rate * 100


def length_reason(frames: Column, n_tokens: Column, b: Bounds = Bounds()) -> Column:
    """The first bound that an utterance breaks, or null."""

    def reason(x: Column) -> Column:
        f, n, ratio = x["frames"], x["n"], x["n"] / F.when(x["frames"] != 0, x["frames"])
        has = n.isNotNull()
        return (
            F.when(f < b.min_length, "minlen").when(f > b.max_length, "maxlen")
            .when(has & (n < b.token_min_length), "lbl_minlen").when(has & (n > b.token_max_length), "lbl_maxlen")
            .when(has & (ratio < b.min_output_input_ratio), "min_ratio").when(has & (ratio > b.max_output_input_ratio), "max_ratio")
        )

    return bind(F.struct(frames.alias("frames"), n_tokens.alias("n")), reason)


def length_filter(df: DataFrame, frames: Column, n_tokens: Column, b: Bounds = Bounds()) -> DataFrame:
    return df.filter(length_reason(frames, n_tokens, b).isNull())


def reasons(df: DataFrame, reason: Column, *by: str) -> DataFrame:
    """Rows by reason, kept ones under ok."""
    return df.groupBy(*by, F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def language_tally(df: DataFrame, text: Column, key: Column, keep_untagged: float = 0.1, seed: int = 0) -> DataFrame:
    """Utterances by language tag in the text (en, es, fr, more than one: mixed); untagged ones are sampled by key."""
    tags = [(lang, text.contains(f"<{lang}>")) for lang in ("en", "es", "fr")]
    n = sum((F.when(t, 1).otherwise(0) for _, t in tags), F.lit(0))
    lang = F.when(n > 1, "mixed").when(tags[0][1], "en").when(tags[1][1], "es").when(tags[2][1], "fr").otherwise("untagged")
    kept = df.withColumn("_lang", lang).filter((F.col("_lang") != "untagged") | (uniform(key, op="untagged", seed=seed) < keep_untagged))
    return kept.groupBy(F.col("_lang").alias("language")).agg(F.count("*").alias("n"))


def speech_rate_reason(text: Column, seconds: Column) -> Column:
    """A reject code where words a second pass what the length allows, or null."""
    rate = count_words(F.replace(text, F.lit(f"{SWITCH} "), F.lit(" "))) / seconds

    def reason(x: Column) -> Column:
        s, r = x["s"], x["r"]
        return (
            F.when((s <= 1) & (r > 5), "reject_1").when((s > 1) & (s <= 2) & (r > 8), "reject_2")
            .when((s > 2) & (s <= 5) & (r > 6), "reject_5").when((s > 5) & (r > 5), "reject_9")
        )

    return bind(F.struct(seconds.alias("s"), rate.alias("r")), reason)


def long_single_word(text: Column, seconds: Column, too_long: float = 1.5, words: list[str] | None = None) -> Column:
    """Whether an utterance is one word (of the list, if given) that lasts too long."""
    one = (seconds >= too_long) & (count_words(text) == 1)
    return one & strip(text).isin(words) if words is not None else one


def single_word_tally(df: DataFrame, text: Column, seconds: Column, too_long: float = 1.5, words: list[str] | None = None) -> DataFrame:
    return df.filter(long_single_word(text, seconds, too_long, words)).groupBy(strip(text).alias("word")).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"))


def exclude(df: DataFrame, keys: DataFrame, on: str = "key") -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def skip_tagged(df: DataFrame, text: Column, key: Column, p: float, tag: str = SWITCH, seed: int = 0) -> DataFrame:
    """Drops rows whose text has the tag, with probability p."""
    return df.filter(~(text.contains(tag) & (uniform(key, op="skip_tagged", seed=seed) < p)))


@dataclass(frozen=True)
class SpecialTokens:
    reject_on: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    relabel: tuple[tuple[str, str], ...] = ()
    remove_trailing_dash: bool = False


def clean_special(text: Column, conf: SpecialTokens) -> Column:
    """The text with words relabelled and removed; null where a word rejects the utterance or nothing is left."""
    table = F.create_map(*[F.lit(x) for pair in conf.relabel for x in pair]) if conf.relabel else None

    def clean(words: Column) -> Column:
        bad = F.exists(words, lambda w: w.isin(*conf.reject_on)) if conf.reject_on else F.lit(False)
        kept = F.filter(words, lambda w: ~w.isin(*conf.remove)) if conf.remove else words
        if table is not None:
            kept = F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w))
        return bind(F.array_join(kept, " "), lambda out: F.when(~bad & (out != ""), out))

    words = split_words(text)
    if conf.remove_trailing_dash:
        words = F.transform(words, lambda w: F.when(w.endswith("-"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return bind(words, clean)


def special_tokens(df: DataFrame, conf: SpecialTokens, text: str = "txt") -> DataFrame:
    """df with cleaned text, the old one as otxt, without rejected or empty utterances."""
    # Exploded from an array of one or none, so that each text is cleaned once, whatever follows.
    cleaned = df.select("*", F.explode(F.array_compact(F.array(clean_special(F.col(text), conf)))).alias("_clean"))
    return cleaned.withColumn("otxt", F.col(text)).withColumn(text, F.col("_clean")).drop("_clean")


def speaker_ids(df: DataFrame, speakers: DataFrame, on: str = "speaker") -> DataFrame:
    """df with speaker_id from the table (speaker, id), 0 where it has none."""
    table = speakers.select(on, F.col("id").alias("_id")).dropDuplicates([on])
    return df.join(table, on, "left").withColumn("speaker_id", F.coalesce("_id", F.lit(0))).drop("_id")


def task(df: DataFrame, name: str | Column = "transcribe") -> DataFrame:
    """df with column task: one name, or a row's own."""
    return df.withColumn("task", F.lit(name))


def category_vector(labels: Column, ids: dict[str, int], n: int, force: tuple[int, ...] = (), extra: tuple[Column, float] | None = None) -> Column:
    """Space-separated labels as a vector that sums to 1; unknown labels are an error. extra: a key and the probability of a further random 1."""
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    at = F.transform(split_words(labels), lambda w: F.coalesce(F.try_element_at(table, w), F.raise_error(F.concat(F.lit("unknown label "), w)).cast("int")))
    on = F.array_union(at, F.array(*[F.lit(i) for i in force]).cast("array<int>"))
    if extra is not None:
        more = F.when(uniform(extra[0], op="multi_hot") < extra[1], F.array(F.pmod(F.xxhash64(extra[0]), F.lit(n)).cast("int"))).otherwise(F.array().cast("array<int>"))
        on = F.array_union(on, more)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.array_contains(on, i), 1.0 / F.size(F.filter(on, lambda x: x < n))).otherwise(0.0))


def append_category(feat: Column, vector: Column) -> Column:
    """A frame's features with the utterance's category vector behind."""
    return F.concat(feat, F.transform(vector, lambda x: x.cast("float")))


# How many input frames an output frame of each input layer stands for.
SUBSAMPLING = {"linear": 1, "conv2d": 4, "conv2d6": 6, "conv2d8": 8}


def output_frame_ms(layer: Column, frame_shift_ms: int = 10) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUBSAMPLING.items() for x in pair])
    return frame_shift_ms * F.coalesce(F.try_element_at(table, layer), F.lit(4))


def verbatimicity(v: Column | float = 1.0) -> Column:
    v = v if isinstance(v, Column) else F.lit(float(v))
    return F.array(v, 1 - v)
