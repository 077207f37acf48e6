"""Signals and logits held as arrays. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def indices(n: Column) -> Column:
    """0 to n - 1; none where n isn't positive."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def at(x: Column, i: Column) -> Column:
    """Element i from 0; null beyond."""
    return F.get(x, i.cast("int"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def deinterleave(data: Column, channels: int, scale: float = 1.0) -> Column:
    """Planar channels of interleaved samples; a partial last frame is dropped."""
    frames = F.floor(F.size(data) / channels)
    plane = lambda c: F.transform(indices(frames), lambda i: at(data, i * channels + c) * scale)
    return F.array(*map(plane, range(channels)))


def downmix(planes: Column, channels: int) -> Column:
    """Mean over channels."""
    return F.transform(indices(F.size(F.get(planes, F.lit(0)))), lambda i: sum((at(F.get(planes, F.lit(c)), i).cast("double") for c in range(1, channels)), at(F.get(planes, F.lit(0)), i).cast("double")) / channels)


def slice_frames(x: Column, start: Column, end: Column) -> Column:
    """From floor(start) to before ceil(end), inside the array; empty where they cross."""
    a = F.greatest(F.lit(0), F.least(F.size(x), F.floor(start).cast("int")))
    b = F.greatest(F.lit(0), F.least(F.size(x), F.ceil(end).cast("int")))
    return F.slice(x, a + 1, F.greatest(F.lit(0), b - a))


def resample(x: Column, rate_in: float, rate_out: float) -> Column:
    """Linear interpolation to another rate; at least one sample of a non-empty input."""
    n = F.size(x)
    m = F.greatest(F.lit(1), F.floor(n * (rate_out / rate_in) + 0.5))

    def one(i: Column) -> Column:
        p = i * (rate_in / rate_out)
        left = F.least(F.floor(p), n - 1)
        a, b = at(x, left).cast("double"), at(x, F.least(left + 1, n - 1)).cast("double")
        return a + (b - a) * (p - left)

    return F.transform(indices(F.when(n > 0, m).otherwise(0)), one)


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x))).otherwise(0.0)


def pre_emphasis(x: Column, factor: float = 0.97) -> Column:
    return F.transform(x, lambda v, i: F.when(i == 0, v.cast("double")).otherwise(v.cast("double") - factor * at(x, i - 1).cast("double")))


def hann(n: int, size: int) -> Column:
    """A symmetric Hann window of n in the middle of size."""
    before = (size - n) // 2
    inside = lambda i: 0.5 - 0.5 * F.cos(2 * F.pi() * (i - before) / (n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when((i >= before) & (i < before + n), inside(i)).otherwise(0.0))


def argmax(x: Column) -> Column:
    """Place from 0 of the first largest element; NaN never wins."""
    clean = F.transform(x, lambda v: F.nanvl(v.cast("double"), F.lit(float("-inf"))))
    return F.array_position(clean, F.array_max(clean)) - 1


def log_softmax_at(x: Column, i: Column) -> Column:
    top = F.array_max(x).cast("double")
    return at(x, i).cast("double") - top - F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top)))


def frames(x: Column, length: int, hop: int) -> Column:
    """(sequence, start, frame, is_last) every hop samples; the first frame that reaches the end is the last."""
    n = F.size(x)
    starts = F.filter(F.transform(indices(F.ceil(n / hop)), lambda k: k * hop), lambda s: (s == 0) | (s - hop + length < n))
    return F.transform(starts, lambda s, k: F.struct(k.alias("sequence"), s.alias("start"), F.slice(x, s + 1, F.lit(length)).alias("samples"), (s + length >= n).alias("is_last")))


def evenly(x: Column, points: int) -> Column:
    """points elements at evenly spaced, rounded places."""
    n = F.size(x)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: at(x, F.floor(i * (n - 1) / max(1, points - 1) + 0.5)))


def min_max(x: Column, points: int) -> Column:
    """(low, high) of each of at least 8 buckets; the last takes the remainder, an empty one is 0."""
    points = max(8, points)
    n = F.greatest(F.lit(1), F.size(x))
    step = F.greatest(F.lit(1), F.floor(n / points)).cast("int")

    def one(i: Column) -> Column:
        begin = i * step
        end = F.when(i == points - 1, F.size(x)).otherwise(F.least(F.size(x), begin + step))
        part = F.slice(x, begin + 1, F.greatest(F.lit(0), end - begin))
        some = F.size(part) > 0
        return F.struct(i.alias("bucket"), F.when(some, F.array_min(part).cast("double")).otherwise(0.0).alias("low"), F.when(some, F.array_max(part).cast("double")).otherwise(0.0).alias("high"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), one)


def percentile_rank(x: Column, q: float) -> Column:
    """Nearest-rank percentile of an array's elements; null if empty."""
    n = F.size(x)
    return F.when(n > 0, at(F.array_sort(x), F.greatest(F.lit(0), F.least(n - 1, F.ceil(n * q) - 1))))


def trimmed_low_mean(x: Column, share: float = 0.6) -> Column:
    """Mean of the lowest share of elements, at least one."""
    k = F.greatest(F.lit(1), F.floor(F.size(x) * share)).cast("int")
    low = F.slice(F.array_sort(x), F.lit(1), k)
    return F.when(F.size(x) > 0, total(low) / F.size(low))
