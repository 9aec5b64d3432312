"""Feature tables (key, frame_idx, feat): statistics, normalisation, masks, and features of waveforms in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import below, uniform

FLOOR = 1e-20


def statistics(frames: DataFrame, feat: str = "feat", *by: str) -> DataFrame:
    """(by, dim, n, total, squares) of feature vectors: a row a dimension, map-side combined."""
    each = frames.select(*by, F.posexplode(feat).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy(*by, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def normaliser(stats: DataFrame, *by: str, extra_dims: int = 0) -> DataFrame:
    """(by, mean, istd): arrays by dimension; category dimensions behind them stay as they are."""
    mean = F.col("total") / F.col("n")
    istd = 1 / F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(FLOOR)))
    rows = stats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", mean.alias("m"), istd.alias("s")))).alias("x"))
    more = lambda v: F.array_repeat(F.lit(v), extra_dims)
    return rows.select(*by, F.concat(F.transform("x", lambda r: r["m"]), more(0.0)).alias("mean"), F.concat(F.transform("x", lambda r: r["s"]), more(1.0)).alias("istd"))


def normalise(frames: DataFrame, table: DataFrame, feat: str = "feat") -> DataFrame:
    """frames against the one row of a normaliser."""
    return frames.crossJoin(F.broadcast(table.limit(1))).withColumn(feat, F.zip_with(F.zip_with(feat, "mean", lambda x, m: x - m), "istd", lambda x, s: x * s)).drop("mean", "istd")


def mask_features(frames: DataFrame, n_frames: Column, key: str = "key", feat: str = "feat", n_time: int = 2, longest: int = 50, n_bins: int = 2, widest: int = 10, seed: int = 0) -> DataFrame:
    """Spans of frames and bins set to 0, drawn by key."""
    def span(total: Column, most: int, i: int, what: str) -> tuple[Column, Column]:
        start = below(total, key, op=f"{what}_start{i}", seed=seed)
        return start, F.least(start + 1 + below(most, key, op=f"{what}_length{i}", seed=seed), total)

    times = [span(n_frames, longest, i, "time") for i in range(n_time)]
    bins = [span(F.size(feat), widest, i, "bin") for i in range(n_bins)]
    inside = lambda x, spans: sum((((x >= a) & (x < b)).cast("int") for a, b in spans), F.lit(0)) > 0
    return frames.withColumn(feat, F.transform(feat, lambda x, i: F.when(inside(F.col("frame_idx"), times) | inside(i, bins), F.lit(0).cast("float")).otherwise(x)))


def substitute_earlier(frames: DataFrame, n_frames: Column, key: str = "key", feat: str = "feat", n: int = 3, longest: int = 20, seed: int = 0) -> DataFrame:
    """Spans of frames replaced by those some places earlier, always from the original."""
    source = F.col("frame_idx")
    for i in range(n):
        start = below(n_frames, key, op=f"sub_start{i}", seed=seed)
        end = F.least(start + 1 + below(longest, key, op=f"sub_length{i}", seed=seed), n_frames)
        back = below(start + 1, key, op=f"sub_back{i}", seed=seed)
        source = F.when((F.col("frame_idx") >= start) & (F.col("frame_idx") < end), F.col("frame_idx") - back).otherwise(source)
    wanted = frames.withColumn("_from", source.cast(frames.schema["frame_idx"].dataType)).drop(feat)
    return wanted.join(frames.select(key, F.col("frame_idx").alias("_from"), feat), [key, "_from"]).drop("_from").select(*frames.columns)


def trim_tail(frames: DataFrame, n_frames: Column, key: str = "key", longest: int = 20, seed: int = 0, share: float = 0.5) -> DataFrame:
    """Up to ``longest`` last frames taken off, where that is less than ``share`` of them."""
    cut = 1 + below(longest, key, op="trim", seed=seed)
    return frames.filter(F.col("frame_idx") < n_frames - F.when(cut < n_frames * share, cut).otherwise(0))


@cache
def mel_bank(n_mels: int, n_fft: int, rate: int, low: float = 0.0, high: float | None = None, slaney: bool = True) -> np.ndarray:
    """Triangular filters, n_mels by n_fft // 2 + 1; by area with slaney, by height without."""
    high = high or rate / 2
    if slaney:  # linear up to 1 kHz, then logarithmic
        to = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))
        back = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    else:
        to, back = (lambda f: 1127 * np.log1p(f / 700)), (lambda m: 700 * np.expm1(m / 1127))
    edges = np.linspace(to(np.float64(low)), to(np.float64(high)), n_mels + 2)
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    at, edges = (bins, back(edges)) if slaney else (to(bins), edges)
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))
    return bank * (2 / (edges[2:] - edges[:-2]))[:, None] if slaney else bank


def log_mel_spectrogram(x: np.ndarray, rate: int = 16000, n_fft: int = 400, hop: int = 160, n_mels: int = 80) -> np.ndarray:
    half = n_fft // 2
    padded = np.pad(x.astype(np.float64), half, mode="reflect") if len(x) > half else np.pad(x.astype(np.float64), half)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][:-1]  # the last frame is dropped
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window)) ** 2
    logs = np.log10(np.maximum(power @ mel_bank(n_mels, n_fft, rate).T, 1e-10))
    return (np.maximum(logs, logs.max(initial=-10) - 8) + 4) / 4


def filter_bank(x: np.ndarray, rate: int = 16000, n_mels: int = 23, window_ms: float = 25, hop_ms: float = 10, low: float = 20.0) -> np.ndarray:
    """Log mel energies of pre-emphasised frames of samples scaled to 16 bits, without dither."""
    size, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    if len(x) < size:
        return np.zeros((0, n_mels))
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float64) * (1 << 15), size)[::hop]
    frames = frames - frames.mean(axis=1, keepdims=True)
    frames = frames - 0.97 * np.concatenate((frames[:, :1], frames[:, :-1]), axis=1)
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    n_fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames * window, n_fft)) ** 2
    return np.log(np.maximum(power @ mel_bank(n_mels, n_fft, rate, low, slaney=False).T, np.finfo(np.float32).eps))


def mfcc(x: np.ndarray, rate: int = 16000, n_mels: int = 40, n_ceps: int = 40, low: float = 20.0) -> np.ndarray:
    banks = filter_bank(x, rate, n_mels, low=low)
    k, i = np.arange(n_ceps)[:, None], np.arange(n_mels)
    dct = np.cos(np.pi * k * (i + 0.5) / n_mels) * np.sqrt(2 / n_mels)
    dct[0] = np.sqrt(1 / n_mels)
    lifter = 1 + 11 * np.sin(np.pi * np.arange(n_ceps) / 22)
    return banks @ dct.T * lifter


def convolve_impulse(x: np.ndarray, impulse: np.ndarray, rate: int = 16000) -> np.ndarray:
    """x under a room's response: cut from 1.01 to 1.3 s, of unit norm."""
    cut = impulse[int(rate * 1.01) : int(rate * 1.3)].astype(np.float64)
    norm = np.linalg.norm(cut)
    return np.convolve(x, cut / norm)[: len(x)] if norm else x


def resample(x: np.ndarray, source: int, target: int, width: int = 16) -> np.ndarray:
    """Windowed-sinc interpolation."""
    if source == target:
        return x
    at = np.arange(int(len(x) * target / source)) * source / target
    cutoff = min(1.0, target / source)
    left = np.floor(at).astype(np.int64)[:, None] + np.arange(-width + 1, width + 1)
    d = at[:, None] - left
    weight = cutoff * np.sinc(cutoff * d) * np.where(np.abs(d) < width, 0.5 + 0.5 * np.cos(np.pi * d / width), 0)
    inside = (left >= 0) & (left < len(x))
    return (np.where(inside, x[np.clip(left, 0, len(x) - 1)], 0) * weight).sum(axis=1)


def to_frames(waves: DataFrame, how: Callable[[np.ndarray, int], np.ndarray], key: str = "key", samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    """(key, frame_idx, feat) of waveforms; a wave a row, so only frames leave the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, x, r in zip(pdf[key], pdf[samples], pdf[rate], strict=True):
                feats = how(np.asarray(x, dtype=np.float64), int(r)).astype(np.float32)
                if len(feats):
                    yield pd.DataFrame({key: k, "frame_idx": np.arange(len(feats), dtype=np.int32), "feat": list(feats)})

    return waves.select(key, samples, rate).mapInPandas(run, f"{key} {waves.schema[key].dataType.simpleString()}, frame_idx int, feat array<float>")


def change_waves(waves: DataFrame, how: Callable[..., np.ndarray], *more: str, samples: str = "samples") -> DataFrame:
    """waves with how(samples, more...) for samples."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([how(np.asarray(row[0], dtype=np.float64), *row[1:]).astype(np.float32) for row in zip(x, *rest, strict=True)])

    return waves.withColumn(samples, run(samples, *more))


def speed(waves: DataFrame, key: str = "key", speeds: tuple[float, ...] = (0.9, 1.0, 1.1), seed: int = 0) -> DataFrame:
    """waves played at a speed drawn by key."""
    chosen = F.element_at(F.array(*[F.lit(s) for s in speeds]), below(len(speeds), key, op="speed", seed=seed) + 1)
    return change_waves(waves.withColumn("speed", chosen), lambda x, s: resample(x, round(1000 * s), 1000), "speed")


def draw(key: str, p: float, op: str, seed: int = 0) -> Column:
    """True with probability p, by key."""
    return uniform(key, op=op, seed=seed) < p
