"""Quality rules: base rules, then a calibrated n-gram classifier (operator 6).

Words, word pairs and character n-grams of a text are hashed into buckets; a logistic regression over them is fitted to labelled
rows and calibrated by Platt's method on held-out ones. All texts are then scored in Arrow batches, whole, against
a fixed threshold. The model, of a fixed size, travels in the task's closure.

Training reads a bounded sample: the `sample` labelled rows whose hashed ids are smallest. Statistics and scores
cover every row.

Defined results: a null text has no words, so it fails the base rules; null and repeated doc_ids give a row each;
labels that are null or belong to no document don't count, and of a document's labels the lowest holds; if one
class is missing among the labelled rows, the method keeps whatever passes the base rules; further columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

ROWS = 128
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUT = [*STATS, "base_failed", "p_good", "kept"]


@dataclass(frozen=True)
class Settings:
    sample: int = 1200
    buckets: int = 1 << 15
    window: int = 5
    least_words: int = 10
    most_repeated: int = 20  # of 100 words
    threshold: float = 0.5
    epochs: int = 60
    rate: float = 0.5
    ridge: float = 1e-4


def repeated(words: list[bytes], window: int) -> int:
    """Words that lie in a window of words found twice or more."""
    if len(words) <= window:
        return 0
    runs = list(zip(*(words[i:] for i in range(window))))
    if len(set(runs)) == len(runs):
        return 0
    counts, out, upto = Counter(runs), 0, 0
    for i, run in enumerate(runs):
        if counts[run] > 1:
            out += i + window - max(i, upto)
            upto = i + window
    return out


def stats(text: bytes, s: Settings) -> tuple[int, int, int, int, int]:
    """STATS of a text in UTF-8."""
    words = text.split()  # bytes: splits at ASCII white space only
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words, s.window)


_WORD, _PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(4095, _PRIME)), dtype=np.uint64)


def _white(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def _gap(c: np.ndarray, at: int) -> int:
    """The first white space from at on, or the end."""
    for begin in range(at, len(c), 4096):
        hit = np.flatnonzero(_white(c[begin : begin + 4096]))
        if len(hit):
            return begin + int(hit[0])
    return len(c)


def features(text: bytes, buckets: int, step: int = 1 << 18) -> Iterator[np.ndarray]:
    """Buckets of a text's words, word pairs and character 3-grams and 4-grams, with repeats.

    A long text is taken by steps, which bounds memory and changes nothing: a step ends at white space, n-grams
    reach back into the one before, and its last word is carried to the next.
    """
    shift = np.uint64(64 - buckets.bit_length() + 1)
    fold = lambda h, salt: ((h + np.uint64(salt)) * _WORD >> shift).astype(np.int32)
    c, at, last = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4"), 0, np.empty(0, np.uint64)
    while at < len(c):
        end = _gap(c, at + step)
        for n, salt in ((3, 1), (4, 2)):
            wide = c[max(0, at - n + 1) : end].astype(np.uint64)
            if len(wide) >= n:
                gram = wide[: len(wide) - n + 1]
                for i in range(1, n):
                    gram = gram * _PRIME + wide[i : len(wide) - n + 1 + i]
                yield fold(gram, salt)
        b = c[at:end]
        white = _white(b)
        begins = np.flatnonzero(~white & np.append(True, white[:-1]))
        if len(begins):
            ends = np.flatnonzero(~white & np.append(white[1:], True)) + 1
            place = np.arange(len(b)) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(b)]])))
            terms = np.where(white, np.uint64(0), (b.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095])
            word = np.add.reduceat(terms, begins) + (ends - begins).astype(np.uint64)
            yield fold(word, 3)
            both = np.append(last, word)
            yield fold(both[:-1] * np.uint64(31) + both[1:], 4)
            last = word[-1:]
        at = end


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    scale: float
    shift: float

    def score(self, text: bytes, buckets: int) -> float:
        """Calibrated probability of good quality."""
        total = n = 0
        for f in features(text, buckets):
            total, n = total + self.weights[f].sum(), n + len(f)
        margin = total / n * 1000 if n else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -50, 50))))


def _sampled(docs: DataFrame, labels: DataFrame, s: Settings, key: str, text: str) -> DataFrame:
    label = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
    picked = label.orderBy(F.xxhash64(key), key).limit(s.sample)
    return docs.select(key, F.col(text).alias("text")).join(F.broadcast(picked), key)  # at most s.sample rows


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model | None:
    """Fits a model to the labelled rows of docs; None if a class is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, quality, body in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                counts = np.zeros(s.buckets, np.int64)
                for f in features(body or b"", s.buckets):
                    counts += np.bincount(f, minlength=s.buckets)
                ids = np.flatnonzero(counts)
                n = counts[ids]
                row = [pa.array([key.as_py()], pa.int64()), pa.array([int(quality)], pa.int32()), pa.array([ids.astype("<i4").tobytes()]), pa.array([(n / max(1, n.sum())).astype("<f4").tobytes()])]
                yield pa.RecordBatch.from_arrays(row, ["doc_id", "quality", "ids", "shares"])

    picked = _sampled(docs, labels, s, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")
    rows = picked.mapInArrow(run, "doc_id long, quality int, ids binary, shares binary").orderBy(F.xxhash64("doc_id"), "doc_id", "ids").limit(s.sample).collect()
    good = np.array([r["quality"] > 0 for r in rows], float)
    if len(set(good)) < 2:
        return None
    # A row's buckets and shares stay as they came; sums go row by row, so the driver holds the rows once.
    cols = [np.frombuffer(r["ids"], "<i4") for r in rows]
    vals = [np.frombuffer(r["shares"], "<f4") * np.float32(1000) for r in rows]
    margins = lambda w: np.array([v @ w[c] for c, v in zip(cols, vals)])
    del rows
    held = np.arange(len(good)) % 4 == 0  # rows come in the order of a hash
    weigh = np.where(good > 0, 0.5 / good.sum(), 0.5 / (1 - good).sum())  # both classes count the same
    w, past, fit = np.zeros(s.buckets), np.full(s.buckets, 1e-6), ~held
    b = 0.0
    for _ in range(s.epochs):
        error = np.where(fit, weigh * (1 / (1 + np.exp(-np.clip(margins(w) + b, -50, 50))) - good), 0.0)
        grad = s.ridge * w
        for i in np.flatnonzero(error):
            grad[cols[i]] += vals[i] * error[i]  # a row's buckets are distinct
        past += grad * grad
        w -= s.rate * grad / np.sqrt(past) / 10
        b -= s.rate * error.sum()
    margin = margins(w)
    scale, shift = platt(margin[held], good[held]) if len(set(good[held])) == 2 else (1.0, b)
    return Model(w, scale, shift)


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the sigmoid that fits margins to outcomes, with Platt's smoothed targets, by Newton's method."""
    many, few = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (many + 1) / (many + 2), 1 / (few + 2))
    unit = max(1e-9, float(np.abs(margin).mean()))
    x = np.stack([margin / unit, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / unit), float(theta[1])


def judge(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with STATS, base_failed, the calibrated probability of good quality, and kept, which replace columns of these names."""
    ship(docs.sparkSession)
    model = train(docs, labels, s, key, text)
    return scored(docs, model, s, text)


def keep(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with docs' columns, whatever their names."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in OUT}
    out = judge(docs.withColumnsRenamed(aside), labels, s, key, text).filter("kept")
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def scored(docs: DataFrame, model: Model | None, s: Settings, text: str = "text") -> DataFrame:
    out = [*[f"{c} long" for c in STATS], "base_failed boolean", "p_good double", "kept boolean"]
    names = [x.split()[0] for x in out]
    rest = [c for c in docs.columns if c not in names]
    read = docs.select(rest)
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
                found = [stats(t, s) for t in texts]
                failed = [x[0] < s.least_words or 100 * x[4] > s.most_repeated * x[0] for x in found]
                good = [None if f or model is None else model.score(t, s.buckets) for f, t in zip(failed, texts)]
                kept = [not f and (p is None or p >= s.threshold) for f, p in zip(failed, good)]
                numbers = [pa.array(x, pa.int64()) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, pa.array(failed), pa.array(good, pa.float64()), pa.array(kept)], [*batch.schema.names, *names])

    from pyspark.sql.types import StructType

    schema = StructType([*read.schema.fields, *StructType.fromDDL(", ".join(out)).fields])
    return read.mapInArrow(run, schema)
