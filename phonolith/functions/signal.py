"""Signal operators: chunks, spectra, mel features, foreground test. Spectra run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import arrays as A, scalar as N
from .text import imul, let


def tiled(x: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(x, times))


def chunks(x: Column, length: int, overlap: int) -> Column:
    """frames() whose neighbours share overlap samples."""
    if not 0 <= overlap < length:
        raise ValueError("an overlap is at least 0 and less than the length")
    return A.frames(x, length, length - overlap)


def nearest(choices: list[int], wanted: Column) -> Column:
    """The choice nearest to wanted; the first of equals."""
    ranked = F.array(*[F.struct(F.abs(F.lit(c) - wanted).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(choices)])
    return F.array_min(ranked)["c"]


def foreground(x: Column, window: int, onset: int, noise_db: Column, least_db: float, onset_db: float, long_db: float = 0.0, is_short: bool = True, is_long: bool = False) -> Column:
    """Levels of windows, 90th percentiles over the noise floor, and the verdict of the first threshold missed."""
    levels = F.transform(A.frames(x, window, window), lambda f: N.dbfs(A.rms(f["samples"])))
    seg = A.percentile_rank(levels, 0.9) - noise_db
    first = A.percentile_rank(F.slice(levels, 1, max(1, onset // window)), 0.9) - noise_db
    reason = F.when(seg < least_db, "foreground-too-quiet")
    reason = reason.when(F.lit(is_short) & (first < onset_db), "short-onset-too-quiet").when(F.lit(is_long) & (seg < long_db), "long-quiet-background").otherwise("accepted")
    return F.struct(seg.alias("foreground_db"), first.alias("onset_db"), reason.alias("reason"), (reason == "accepted").alias("accepted"))


def power_spectrum(size: int):
    """A pandas UDF: power of each bin of a zero-padded real transform."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def spectrum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: (np.abs(np.fft.rfft(np.asarray(x, float), size)) ** 2).tolist())

    return spectrum


def _hz_to_mel(hz, style: str):
    if style == "kaldi":
        return 1127 * np.log(1 + np.asarray(hz) / 700)
    return np.where(np.asarray(hz) >= 1000, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4), np.asarray(hz) * 3 / 200)


def _mel_to_hz(mel, style: str):
    if style == "kaldi":
        return 700 * (np.exp(np.asarray(mel) / 1127) - 1)
    return np.where(np.asarray(mel) >= 15, 1000 * np.exp((np.asarray(mel) - 15) * np.log(6.4) / 27), np.asarray(mel) * 200 / 3)


@lru_cache(maxsize=8)
def mel_filterbank(rate: int, size: int, mels: int, style: str = "slaney", low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles over the bins of a transform: Slaney's of equal area, Kaldi's of equal height, linear in mel."""
    high = rate / 2 if high is None else high
    edges = np.linspace(_hz_to_mel(low, style), _hz_to_mel(high, style), mels + 2)
    bins = np.arange(size // 2 + 1) * rate / size
    at, edges = (_hz_to_mel(bins, style), edges) if style == "kaldi" else (bins, _mel_to_hz(edges, style))
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))
    return bank if style == "kaldi" else bank * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_frames(x: np.ndarray, rate: int = 16000, mels: int = 80, style: str = "centred", size: int = 512, window: int = 400, hop: int = 160) -> tuple[np.ndarray, int]:
    """Log-mel features (frames, mels) and how many frames are valid."""
    if style == "centred":
        x = np.append(x[:1], x[1:] - np.float32(0.97) * x[:-1]).astype(np.float32)
        n, padded = len(x), np.pad(x.astype(float), size // 2)
        hann = np.pad(np.hanning(window), ((size - window) // 2, size - window - (size - window) // 2))
        count, guard, valid = n // hop + 1, lambda p: np.log(p + 2.0**-24), n // hop
        bank = mel_filterbank(rate, size, mels)
    else:
        count = 1 + (len(x) - window) // hop if len(x) >= window else 0
        padded, hann = np.pad(x.astype(float), (0, size)), np.pad(np.hanning(window), (0, size - window))
        guard, valid = lambda p: np.log(np.maximum(p, 1e-5)), count
        bank = mel_filterbank(rate, size, mels, "kaldi", 125.0, 7500.0)
    if not count:
        return np.zeros((0, mels)), 0
    at = np.arange(count)[:, None] * hop + np.arange(size)
    power = np.abs(np.fft.rfft(padded[at] * hann, size)) ** 2
    return guard(power @ bank.T), valid


def mel_more(before: np.ndarray, x: np.ndarray, edge: int = 3, **shape) -> tuple[np.ndarray, int, int]:
    """Features of x, of which those of a prefix are known: rows of before but its last `edge` are taken over.

    Returns the features and how many were kept and made. Equal to mel_frames() of the whole.
    """
    hop, size = shape.get("hop", 160), shape.get("size", 512)
    keep = max(0, len(before) - edge)
    back = size // hop + 2  # frames that a cut's padding and pre-emphasis can reach
    begin = max(0, keep - back)
    part, _ = mel_frames(x[begin * hop :], **shape)
    rows = np.concatenate([before[:keep], part[keep - begin :]]) if keep else mel_frames(x, **shape)[0]
    return rows, keep, len(rows) - keep


def log_mel(audio: DataFrame, style: str = "centred", **shape) -> DataFrame:
    """(key, frame, mel, valid) of audio(key, samples): one row a frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, samples in zip(pdf["key"], pdf["samples"]):
                rows, valid = mel_frames(np.asarray(samples, np.float32), style=style, **shape)
                yield pd.DataFrame({"key": key, "frame": np.arange(len(rows), dtype=np.int32), "mel": list(rows), "valid": np.int32(valid)})

    return audio.select("key", "samples").mapInPandas(run, f"key {dict(audio.dtypes)['key']}, frame int, mel array<double>, valid int")


def normalize_features(df: DataFrame, utterance: str, feature: str, value: str) -> DataFrame:
    """df with `normal`: value less its mean over the utterance's frames, by its deviation; 0 of one frame."""
    w = Window.partitionBy(utterance, feature)
    x = F.col(value).cast("double")
    return df.withColumn("normal", (x - F.avg(x).over(w)) / (F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)) + 1e-5))


#: Fixed values of the key: Murmur3's 32-bit constants, and how a long signal is sampled.
MIX_A, MIX_B, MIX_C, END_A, END_B = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
WHOLE, EDGE, POINTS = 1_000_000, 1024, 131_072


def _turned(x: Column, bits: int) -> Column:
    """An unsigned 32-bit number, rotated left."""
    return F.shiftleft(x, bits).bitwiseOR(F.shiftright(x, 32 - bits)).bitwiseAND(F.lit(0xFFFFFFFF))


def sampled(n: Column, whole: int = WHOLE, edge: int = EDGE, points: int = POINTS) -> Column:
    """The places of n samples that a key reads: all of a signal of up to `whole`, else both edges and a strided middle."""
    stride = F.greatest(F.lit(1), F.floor((n - 2 * edge) / (points - 2 * edge)).cast("int"))
    long = F.concat(F.sequence(F.lit(0), F.lit(edge - 1)), F.sequence(F.lit(edge), n - edge - 1, stride), F.sequence(n - edge, n - 1))
    return F.when(n <= whole, F.sequence(F.lit(0), n - 1)).otherwise(long)


def audio_key(x: Column, whole: int = WHOLE, edge: int = EDGE, points: int = POINTS) -> Column:
    """`count_hash` of samples as 16-bit integers, mixed in order by Murmur3's steps; samples that aren't finite are 0.

    Equal audio has an equal key. A signal longer than `whole` is read at its edges and at strides between them.
    """
    n = F.size(x)

    def mixed(state: Column, place: Column) -> Column:
        v = F.get(x, place).cast("double")
        finite = F.when(F.abs(v) < float("inf"), v).otherwise(0.0)
        unit = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(finite * 32768 + 0.5))).bitwiseAND(F.lit(0xFFFF))
        key = let(imul(unit, MIX_A), lambda k: imul(_turned(k, 15), MIX_B))
        after = let(state.bitwiseXOR(key), lambda s: _turned(s, 13))
        return (imul(after, 5) + MIX_C).bitwiseAND(F.lit(0xFFFFFFFF))

    def ended(state: Column) -> Column:
        once = let(state, lambda s: imul(s.bitwiseXOR(F.shiftright(s, 16)), END_A))
        twice = let(once, lambda s: imul(s.bitwiseXOR(F.shiftright(s, 13)), END_B))
        return let(twice, lambda s: s.bitwiseXOR(F.shiftright(s, 16)))

    hashed = F.aggregate(sampled(n, whole, edge, points), n.cast("long"), mixed, ended)
    return F.when(n == 0, "0_0").otherwise(F.concat_ws("_", n.cast("string"), hashed.cast("string")))


def content_key(x: Column) -> Column:
    """A 64-bit key of all samples as 16-bit integers, for joins; cheaper than audio_key()."""
    quantised = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))) * 32767).cast("int"))
    return F.lower(F.hex(F.xxhash64(quantised, F.size(x))))
