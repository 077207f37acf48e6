"""Numbers: rounding, levels, time grids, throughput. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FLOOR_DB = -100.0
#: The fixed time grid of streaming: milliseconds of a chunk, and its frames where a rate is unusable.
CHUNK_MS, CHUNK_FRAMES = 16, 256


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(v: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    d = v.cast("double")
    return F.coalesce(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def round_half_up(v: Column, digits: int = 3) -> Column:
    """Halves go up, also below zero."""
    k = float(10**digits)
    return F.floor(v * k + 0.5) / k


def safe_number(text: Column) -> Column:
    """A string's number; null and blank are 0, what isn't a finite number is null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    d = t.try_cast("double")
    return F.when(t == "", F.lit(0.0)).when(finite(d), d)


def clamp_unit(v: Column) -> Column:
    """Probabilities: null, NaN, infinite and negative are 0, above 1 is 1."""
    return F.when(finite(v) & (v > 0), F.least(v, F.lit(1.0))).otherwise(0.0)


def dbfs(amplitude: Column, floor: float = FLOOR_DB) -> Column:
    level = 20 * F.log10(amplitude)
    return F.when(finite(amplitude) & (amplitude > 0), F.greatest(F.lit(floor), level)).otherwise(floor)


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def rtfx(seconds: Column, ms: Column) -> Column:
    """Seconds of audio per second of work; null unless both are positive."""
    return F.when(finite(seconds) & finite(ms) & (seconds > 0) & (ms > 0), seconds * 1000 / ms)


def rtf(seconds: Column, ms: Column) -> Column:
    """Seconds of work per second of audio, to 4 digits; 0 without audio."""
    return F.when(seconds > 0, round_half_up(ms / (seconds * 1000), 4)).otherwise(0.0)


def remaining_ms(elapsed: Column, progress: Column) -> Column:
    return F.when((progress > 0) & (progress < 1), elapsed / progress * (1 - progress))


def chunk_frames(rate: Column, chunk_ms=CHUNK_MS) -> Column:
    """Frames of a chunk, at least one."""
    ms = col(chunk_ms)
    ms = F.when(finite(ms) & (ms > 0), F.greatest(F.lit(1.0), F.floor(ms + 0.5))).otherwise(float(CHUNK_MS))
    return F.when(finite(rate) & (rate > 0), F.greatest(F.lit(1), F.floor(ms / 1000 * rate + 0.5))).otherwise(CHUNK_FRAMES).cast("long")


def align(value: Column, grid: Column, mode: str = "round") -> Column:
    """value on a grid of positive steps, at least one step."""
    steps = {"floor": F.floor, "ceil": F.ceil, "round": lambda x: F.floor(x + 0.5)}[mode](value / grid)
    return F.when(finite(value) & (value > 0), F.greatest(grid, steps * grid)).otherwise(grid)


def frames_to_ms(frames: Column, rate: Column) -> Column:
    return F.when(finite(frames) & finite(rate) & (rate > 0), frames / rate * 1000).otherwise(0.0)


def seconds_per_frame(duration: Column, in_frames: Column, hop: Column, out_frames: Column) -> Column:
    """Seconds of an output frame: from the duration, else from input frames, else 0."""
    by_input = F.when(finite(in_frames) & (in_frames > 0) & finite(hop) & (hop > 0), in_frames * hop / out_frames)
    by_duration = F.when(finite(duration) & (duration > 0), duration / out_frames)
    return F.when(finite(out_frames) & (out_frames > 0), F.coalesce(by_duration, by_input, F.lit(0.0))).otherwise(0.0)


def hz_to_mel(hz: Column) -> Column:
    """Slaney's scale: linear below 1 kHz, logarithmic above."""
    step = 200.0 / 3
    return F.when(hz >= 1000, 1000 / step + F.log(hz / 1000) * 27 / F.log(F.lit(6.4))).otherwise(hz / step)


def mel_to_hz(mel: Column) -> Column:
    step = 200.0 / 3
    knee = 1000 / step
    return F.when(mel >= knee, 1000 * F.exp((mel - knee) * F.log(F.lit(6.4)) / 27)).otherwise(mel * step)


def hz_to_mel_kaldi(hz: Column) -> Column:
    return 1127 * F.log(1 + hz / 700)


def mel_to_hz_kaldi(mel: Column) -> Column:
    return 700 * (F.exp(mel / 1127) - 1)


def max_new_tokens(wanted: Column, positions: Column, prompt: Column) -> Column:
    left = F.greatest(F.lit(1), positions - prompt)
    asked = F.when(finite(wanted), F.when(wanted < 0, F.ceil(wanted)).otherwise(F.floor(wanted))).otherwise(left)
    return F.greatest(F.lit(1), F.least(asked, left)).cast("long")


def release_ms(confirm: Column, silence: Column, hangover: Column) -> Column:
    """The longest of three windows; null if one isn't known."""
    return F.when(finite(confirm) & finite(silence) & finite(hangover), F.greatest(confirm, silence, hangover))


def foreground_threshold(enabled: Column, noise_db: Column, min_db: Column) -> Column:
    return F.when(enabled & finite(noise_db) & finite(min_db), noise_db + min_db)


def overlap_cost(total: Column, window: Column, overlap: Column) -> tuple[Column, Column, Column]:
    """Steps, seconds processed and share of overhead when overlapping windows cover total seconds."""
    steps = F.greatest(F.lit(1), F.ceil((total - overlap) / (window - overlap)))
    done = steps * window
    return steps, done, (done - total) / total


def vignette(i: Column, n: Column) -> Column:
    """Gaussian weight of place i of n about the middle; a quarter of n is one standard deviation."""
    mid, sigma = (n - 1) / 2, n * 0.25
    return F.exp(-F.pow(i - mid, F.lit(2.0)) / (2 * sigma * sigma))


def display_gain(low: Column, high: Column, target: float, most: float) -> Column:
    peak = F.greatest(F.abs(low), F.abs(high))
    return F.when(peak > 0, F.least(F.lit(most), F.greatest(F.lit(1.0), target / peak))).otherwise(1.0)
