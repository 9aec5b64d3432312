"""Frames to tokens to timed words: run-length, neighbour and chunk operators over (key, frame_idx) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE, is_special, starts_word


def _by(keys: list[str], order: str) -> object:
    return Window.partitionBy(*keys).orderBy(order)


def ctc_collapse(frames: DataFrame, keys: list[str], order: str = "frame_idx", token: str = "token", blank: object = 0) -> DataFrame:
    """Frames that open a run of a token other than blank; their times are the tokens' peaks."""
    prev = F.lag(token).over(_by(keys, order))
    return frames.withColumn("_prev", prev).filter((F.col(token) != blank) & ~F.col(token).eqNullSafe(F.col("_prev"))).drop("_prev")


def collapse_array(tokens: Column, blank: int = 0) -> Column:
    """The same for one array of frame tokens."""
    return F.filter(tokens, lambda t, i: (t != blank) & ((i == 0) | (F.get(tokens, i - 1) != t)))


def repeats_to_blank(frames: DataFrame, keys: list[str], order: str = "frame_idx", token: str = "token", blank: object = 0) -> DataFrame:
    prev = F.lag(token).over(_by(keys, order))
    return frames.withColumn(token, F.when(F.col(token).eqNullSafe(prev) & (F.col(token) != blank), F.lit(blank)).otherwise(F.col(token)))


def peak_times(frames: DataFrame, keys: list[str], order: str = "frame_idx", token: str = "token", blank: object = 0) -> DataFrame:
    return ctc_collapse(frames, keys, order, token, blank).select(*keys, F.col(order).alias("peak"), token)


def intervals_from_peaks(peaks: DataFrame, keys: list[str], max_duration: Column | float, frame_rate: float = 0.04, max_token: float = 1.0) -> DataFrame:
    """peaks (keys, peak) with start and end in seconds: midpoints to the neighbours, half a longest token at most."""
    w, t = _by(keys, "peak"), F.col("peak") * frame_rate
    prev, next_ = F.lag("peak").over(w) * frame_rate, F.lead("peak").over(w) * frame_rate
    last = max_duration if isinstance(max_duration, Column) else F.lit(float(max_duration))
    start = F.greatest((prev + t) / 2, t - max_token / 2)
    end = F.least((next_ + t) / 2, t + max_token / 2)
    return peaks.withColumns({
        "start": F.when(prev.isNull(), F.greatest(t - max_token / 2, F.lit(0.0))).otherwise(start),
        "end": F.when(next_.isNull(), F.least(t + max_token / 2, last)).otherwise(end),
    })


def intervals_from_fires(peaks: DataFrame, keys: list[str], num_frames: str, frame_rate: float = 0.02, longest: int = 14, tail: int = 5) -> DataFrame:
    """(keys, idx, start, end) of firing peaks: from half a frame before one to the next, at most ``longest`` frames.

    The last peak closes at the end; if more than ``tail`` frames are left, the interval before it ends half way and one
    more interval takes the rest. A single peak gives one interval.
    """
    w, whole = _by(keys, "peak"), Window.partitionBy(*keys)
    rows = peaks.select(*keys, F.col(num_frames).cast("double").alias("_frames"), (F.col("peak") - 0.5).alias("_fire"), F.row_number().over(w).alias("idx"), F.count("*").over(whole).alias("_n"))
    rows = rows.withColumns({"_next": F.lead("_fire").over(Window.partitionBy(*keys).orderBy("idx")), "_last": F.max("_fire").over(whole)})
    rows = rows.withColumn("_mid", F.when(F.col("_frames") - F.col("_last") > tail, (F.col("_frames") + F.col("_last")) / 2))
    single, before_last = F.col("_n") == 1, F.col("idx") < F.col("_n") - 1
    end = F.when(single, F.col("_frames")).when(before_last, F.least("_next", F.col("_fire") + longest)).otherwise(F.coalesce("_mid", "_frames"))
    body = rows.filter((F.col("idx") < F.col("_n")) | single).select(*keys, "idx", (F.col("_fire") * frame_rate).alias("start"), (end * frame_rate).alias("end"))
    rest = rows.filter((F.col("idx") == F.col("_n")) & ~single & F.col("_mid").isNotNull()).select(*keys, "idx", (F.col("_mid") * frame_rate).alias("start"), (F.col("_frames") * frame_rate).alias("end"))
    return body.unionByName(rest)


def tokens_to_words(tokens: DataFrame, keys: list[str], frame_ms: int, gap_ms: int = 100, shift_ms: Column | int = 0) -> DataFrame:
    """(keys, idx, token, unit, time, confidence) to timed words.

    A word starts at a marked token or where nothing is open; a special token is a word by itself. Starts lie gap_ms
    before the first token and ends at the last, or half way to the neighbour where that is closer than gap_ms. Words
    that are empty after the mark is taken off are left out. unit_id is a special token's id, else -1.
    """
    w = _by(keys, "idx")
    t, prev, next_ = F.col("time"), F.lag("time").over(w), F.lead("time").over(w)
    special = is_special(F.col("token"))
    opens = starts_word(F.col("token")) | special | F.coalesce(F.lag(special).over(w), F.lit(True))
    half = lambda a, b: F.floor((a + b) / 2) * frame_ms
    rows = tokens.withColumns({
        "_open": F.when(opens, 1).otherwise(0), "_special": special,
        "_start": F.when((t - prev) * frame_ms < gap_ms, half(prev, t)).otherwise(F.greatest(t * frame_ms - gap_ms, F.lit(0))),
        "_end": F.when((next_ - t) * frame_ms < gap_ms, half(t, next_)).otherwise(t * frame_ms),
    }).withColumn("_word", F.sum("_open").over(w))
    parts = F.array_sort(F.collect_list(F.struct("idx", F.regexp_replace("token", f"^{SPACE}", "").alias("piece"), "unit")))
    words = rows.groupBy(*keys, "_word").agg(
        parts.alias("_parts"), F.min_by("_start", "idx").alias("_s"), F.max_by("_end", "idx").alias("_e"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"), F.max("_special").alias("_special"))
    shift = shift_ms if isinstance(shift_ms, Column) else F.lit(shift_ms)
    text = F.array_join(F.transform("_parts", lambda p: p["piece"]), "")
    units = F.transform("_parts", lambda p: p["unit"])
    out = words.select(*keys, F.get(F.transform("_parts", lambda p: p["idx"]), F.lit(0)).alias("first_idx"), text.alias("word"), F.when(F.col("_special"), F.get(units, F.lit(0))).otherwise(-1).alias("unit_id"),
                       (F.col("_s") + shift).cast("long").alias("start_ms"), (F.col("_e") + shift).cast("long").alias("end_ms"), "confidence", units.alias("unit_ids"))
    return out.filter("word <> ''")


def offset_words(words: DataFrame, keys: list[str], order: str = "start_ms", adjustment: int = 230) -> DataFrame:
    """Each word moved left by at most the adjustment, and by no more than the silence before it allows: the least of the adjustment and the sum of all gaps so far."""
    w = _by(keys, order)
    gap = F.col("start_ms") - F.coalesce(F.lag("end_ms").over(w), F.lit(0))
    shift = F.least(F.lit(adjustment), F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    moved = words.withColumn("_gap", gap).withColumn("_shift", shift)
    return moved.withColumns({"start_ms": F.col("start_ms") - F.col("_shift"), "end_ms": F.col("end_ms") - F.col("_shift")}).drop("_gap", "_shift")


def chunk_shift(words: DataFrame, chunk: str = "chunk_idx", chunk_size: int = 2051, frame_shift_ms: int = 10) -> DataFrame:
    by = F.col(chunk) * chunk_size * frame_shift_ms
    return words.withColumns({"start_ms": F.col("start_ms") + by, "end_ms": F.col("end_ms") + by})


def token_spans(frames: DataFrame, keys: list[str], blank_logp: str, token_logp: str, threshold: float = 0.0, blank: int = 0) -> DataFrame:
    """(keys, span, token, start_frame, end_frame) of frame labels: a run of a token with the blanks before it. Leading frames are kept from where the blank is likely enough or the token too unlikely for the last time."""
    w = _by(keys, "frame_idx")
    prev = F.lag("token").over(w)
    # A span closes with the last frame of a run.
    ends = (F.col("token") != blank) & ~F.col("token").eqNullSafe(F.lead("token").over(w))
    rows = frames.withColumn("_closed", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_prev", prev)
    blocked = (F.col(blank_logp) >= threshold) & (F.col(token_logp) <= threshold)
    spans = rows.groupBy(*keys, F.col("_closed").alias("span")).agg(
        F.max(F.when(F.col("token") != blank, F.col("token"))).alias("token"), F.min("frame_idx").alias("_first"), F.max("frame_idx").alias("end_frame"),
        F.min(F.when(F.col("token") != blank, F.col("frame_idx"))).alias("_run"), F.max(F.when((F.col("token") == blank) & blocked, F.col("frame_idx"))).alias("_stop"))
    return spans.filter("token IS NOT NULL").select(*keys, "span", "token", F.coalesce(F.col("_stop") + 1, "_first").alias("start_frame"), "end_frame")


def left_context(frames: DataFrame, keys: list[str], value: Column, chunk: int, left: int = -1) -> DataFrame:
    """frames with chunk_idx, the first visible frame, and the visible frames' values added up: a frame sees its chunk and ``left`` chunks before it, all of them if negative."""
    out = frames.withColumn("chunk_idx", F.floor(F.col("frame_idx") / chunk))
    w = Window.partitionBy(*keys).orderBy("chunk_idx").rangeBetween(Window.unboundedPreceding if left < 0 else -left, 0)
    return out.withColumns({"first_frame": F.min("frame_idx").over(w), "n_visible": F.count("*").over(w), "context": F.sum(value).over(w)})


def chunked(frames: DataFrame, keys: list[str], value: str, pad: object, chunk: int = 2051) -> DataFrame:
    """(keys, chunk_idx, length, values): the last chunk padded to full size."""
    grouped = frames.groupBy(*keys, F.floor(F.col("frame_idx") / chunk).alias("chunk_idx")).agg(F.count("*").alias("length"), F.array_sort(F.collect_list(F.struct("frame_idx", value))).alias("_x"))
    values = F.transform("_x", lambda x: x[value])
    return grouped.select(*keys, "chunk_idx", "length", F.concat(values, F.array_repeat(F.lit(pad), (chunk - F.col("length")).cast("int"))).alias("values"))


def argmax(scores: Column) -> Column:
    """The place of the largest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def greedy_decode(frames: DataFrame, keys: list[str], scores: str = "logp", length: str | None = None, blank: int = 0) -> DataFrame:
    """(keys, frame_idx, token) of the best path without repeats and blanks; frames from length on count as blank."""
    token = argmax(F.col(scores))
    if length:
        token = F.when(F.col("frame_idx") >= F.col(length), blank).otherwise(token)
    return ctc_collapse(frames.select(*keys, "frame_idx", token.alias("token")), keys, blank=blank)


def nonblank_frames(frames: DataFrame, keys: list[str], scores: str = "logp", blank: int = 0) -> DataFrame:
    """Frames whose best token isn't blank, numbered anew."""
    kept = frames.withColumn("token", argmax(F.col(scores))).filter(F.col("token") != blank)
    return kept.withColumn("new_idx", F.row_number().over(_by(keys, "frame_idx")) - 1)


def decode_with_peaks(tokens: DataFrame, fires: DataFrame, key: str, threshold: float = 1 - 1e-4) -> DataFrame:
    """tokens (key, i, token, logp) joined to the i-th frame whose peak passes the threshold; confidences by token and by key."""
    fired = fires.filter(F.col("peak") > threshold).select(key, "frame_idx", (F.row_number().over(Window.partitionBy(key).orderBy("frame_idx")) - 1).alias("i"))
    conf = F.exp("logp")
    return tokens.join(fired, [key, "i"], "left").withColumns({"token_confidence": conf, "confidence": F.avg(conf).over(Window.partitionBy(key))})


def sequence_confidence(logp: Column) -> Column:
    return F.exp(F.avg(logp))
