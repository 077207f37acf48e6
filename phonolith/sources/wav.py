"""WAV files: bytes to mono samples and back, in Arrow batches."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Layout:
    """Where a WAV file's samples lie and how they are written."""

    code: int  # 1: PCM, 3: float
    channels: int
    rate: int
    bits: int
    begin: int  # of the samples, in bytes
    size: int  # of the samples, in bytes, as the header has it

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def layout(f: BinaryIO) -> Layout:
    """Of a seekable RIFF file, by its chunks; the samples aren't read."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while form is None or body is None:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("a WAV file without format or data")
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            fields = f.read(16)
            if len(fields) < 16:
                raise ValueError("a WAV file whose format is cut off")
            form = struct.unpack("<HHIIHH", fields)
        elif name == b"data":
            body = at + 8, size
        at += 8 + size + size % 2  # chunks are padded to even sizes
    return Layout(form[0], form[1], form[2], form[5], *body)


def mono(body: bytes, form: Layout) -> np.ndarray:
    """Samples of whole frames: PCM of 8, 16, 24, 32 bits or float of 32, 64; channels averaged."""
    body, bits = body[: len(body) // form.frame * form.frame], form.bits
    if form.code == 3:
        x = np.frombuffer(body, {32: "<f4", 64: "<f8"}[bits]).astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608
    else:
        x = np.frombuffer(body, {16: "<i2", 32: "<i4"}[bits]).astype(np.float64) / 2.0 ** (bits - 1)
    return x.reshape(-1, form.channels).mean(1).astype(np.float32)


def parse(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples of a RIFF file."""
    form = layout(io.BytesIO(data))
    return form.rate, mono(data[form.begin : form.begin + form.size], form)


def build(x: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM; samples are clamped, negative ones scaled by 32768, others by 32767."""
    x = np.clip(np.asarray(x, float), -1, 1)
    body = np.trunc(np.where(x < 0, x * 32768, x * 32767)).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(body))
    return head + body


def decode(files: DataFrame) -> DataFrame:
    """(key, sample_rate, samples) of files(key, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"key": pdf["key"], "sample_rate": [r for r, _ in got], "samples": [x for _, x in got]})

    return files.select("key", "content").mapInPandas(run, f"key {dict(files.dtypes)['key']}, sample_rate int, samples array<float>")


def encode(audio: DataFrame, rate: int) -> DataFrame:
    """(key, content) of audio(key, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "content": [build(np.asarray(x), rate) for x in pdf["samples"]]})

    return audio.select("key", "samples").mapInPandas(run, f"key {dict(audio.dtypes)['key']}, content binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Mono samples of all WAV files under path, by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return decode(files.select(F.element_at(F.split("path", "/"), -1).alias("key"), "content"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """The fields of all JSON files of a folder, with their stem."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.option("multiLine", True).json(f"{path}/*.json").select("*", stem.alias("stem"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """WAV files with the fields of the JSON files of the same stem; files without a partner are left out."""
    return read(spark, path).withColumn("stem", F.regexp_replace("key", r"\.[^.]*$", "")).join(labels(spark, path), "stem")
