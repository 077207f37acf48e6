"""Spark data sources of this engine: WAV files read in ranges, as a stream of chunks and written; ordered CSV; JSON reports.

    register(spark)
    spark.read.format("wav").load(folder)                       # a row for each range of samples
    spark.readStream.format("wav").option("size", 1600).load(folder)  # chunks of recordings that grow
    df.write.format("wav").mode("append").save(folder)          # a file for each row(key, sample_rate, samples)
    df.write.format("named_files").mode("append").save(folder)  # a file for each row(name, content)
    df.write.format("ordered_csv").mode("append").save(folder)  # part files in the rows' order, one header
    df.write.format("json_report").mode("append").save(folder)  # a bounded result as one JSON file

Paths are those of pyarrow's file systems: local, HDFS, S3 and the like; sources.wav.read() takes stores that only Spark
knows. Writers write each task's files beside the target under names of their own attempt. The driver moves the files
of the attempts that Spark committed and deletes the folder of the job, so that attempts which failed, ran twice or
were aborted leave nothing.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from phonolith.session import ship

from . import wav


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its place there; a path without a scheme is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def listed(path: str, suffix: str) -> list[pafs.FileInfo]:
    """Files of a folder, or the one file, by name; hidden ones and those of running writes aside."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.path.endswith(suffix) and posixpath.basename(f.path)[0] not in "._"), key=lambda f: f.path)


def stem(path: str) -> str:
    return posixpath.basename(path).rpartition(".")[0]


@dataclass
class Range(InputPartition):
    """Bytes of some files' samples, whole frames."""

    parts: list[tuple[str, int, int]]  # path, first frame, frames


def _range(f: pa.NativeFile, form: wav.Layout, first: int, count: int) -> np.ndarray:
    f.seek(form.begin + first * form.frame)
    return wav.mono(f.read(count * form.frame), form)


def _samples(fs: pafs.FileSystem, path: str, first: int, count: int) -> tuple[wav.Layout, np.ndarray]:
    with fs.open_input_file(path) as f:
        form = wav.layout(f)
        return form, _range(f, form, first, count)


def _there(form: wav.Layout, size: int) -> tuple[int, bool]:
    """Frames that a file of `size` bytes holds by now, and whether it is complete."""
    got = max(0, size - form.begin)
    return min(got, form.size) // form.frame, got >= form.size


HEAD = "key string, sample_rate int, channels int, bits int, frames long"
FULL = f"{HEAD}, first_frame long, samples array<float>"
#: Bytes of a partition, at most but for a longer row; tasks that small files are dealt to.
SHARE, TASKS = 8 << 20, 200


def _layout(fs: pafs.FileSystem, path: str) -> wav.Layout:
    with fs.open_input_file(path) as f:
        return wav.layout(f)


class WavReader(DataSourceReader):
    """option split: bytes of samples in a row, at most. Rows share partitions of SHARE bytes, or so that TASKS are enough."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.split, self.heads = options["path"], int(options.get("split", SHARE)), "samples" not in schema.names

    def partitions(self) -> list[InputPartition]:
        fs, files, rows = opened(self.path)[0], listed(self.path, ".wav"), []
        if self.heads:
            rows = [(f.path, 0, 0, 4096) for f in files]
        else:
            with ThreadPoolExecutor(16) as pool:
                forms = pool.map(lambda f: _layout(fs, f.path), files)
                for f, form in zip(files, forms):
                    n, step = _there(form, f.size)[0], max(1, self.split // form.frame)
                    rows += [(f.path, at, min(step, n - at), min(step, n - at) * form.frame) for at in range(0, max(n, 1), step)]
        share = max(self.split, min(SHARE, sum(r[3] for r in rows) // TASKS))
        out, now, weight = [], [], 0
        for path, at, count, size in rows:
            if now and weight + size > share:
                out.append(Range(now))
                now, weight = [], 0
            now.append((path, at, count))
            weight += size
        return out + ([Range(now)] if now else [Range([])] if not out else [])

    def read(self, partition: Range) -> Iterator[tuple]:
        fs = opened(self.path)[0]
        for path, parts in groupby(partition.parts, lambda p: p[0]):
            with fs.open_input_file(path) as f:
                form = wav.layout(f)
                head = (stem(path), form.rate, form.channels, form.bits, _there(form, f.size())[0])
                for _, first, count in parts:
                    yield head if self.heads else (*head, first, _range(f, form, first, count).tolist())


@dataclass
class Chunks(InputPartition):
    path: str
    begin: int
    end: int


CHUNK = "key string, sequence long, first_frame long, sample_rate int, samples array<float>"


class WavStream(DataSourceStreamReader):
    """Recordings that grow, as chunks of `size` frames at `rate` (their own if unset), with the frames they begin at.

    An offset has, for each file, how many chunks are out. Files are only appended to, so that the same offsets give
    the same rows again. Resampled frames lie between two of the recording, both of which have to be there; the last
    chunk of a recording that is complete may be short.
    """

    def __init__(self, options: dict):
        self.path, self.size, self.rate = options["path"], int(options.get("size", 1600)), int(options.get("rate", 0))

    def _ratio(self, form: wav.Layout) -> float:
        return form.rate / (self.rate or form.rate)

    def _frames(self, form: wav.Layout, n: int) -> int:
        ratio = self._ratio(form)
        return n if ratio == 1 else math.ceil(max(0, n - 1) / ratio)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, out = opened(self.path)[0], {}
        for info in listed(self.path, ".wav"):
            try:
                with fs.open_input_file(info.path) as f:
                    form = wav.layout(f)
                    n, complete = _there(form, f.size())
            except ValueError:
                continue  # its header isn't there yet
            frames = self._frames(form, n)
            out[info.path] = -(-frames // self.size) if complete else frames // self.size
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Chunks(path, start.get(path, 0), n) for path, n in sorted(end.items()) if n > start.get(path, 0)]

    def read(self, partition: Chunks) -> Iterator[tuple]:
        fs = opened(self.path)[0]
        with fs.open_input_file(partition.path) as f:
            form = wav.layout(f)
            n = _there(form, f.size())[0]
        ratio, total = self._ratio(form), self._frames(form, n)
        for k in range(partition.begin, partition.end):
            at = np.arange(k * self.size, min(total, (k + 1) * self.size)) * ratio
            low = np.floor(at).astype(np.int64)
            x = _samples(fs, partition.path, int(low[0]), int(low[-1] - low[0]) + 2)[1].astype(np.float64)
            here = x[low - low[0]]
            out = here if ratio == 1 else here + (x[low - low[0] + 1] - here) * (at - low)
            yield stem(partition.path), k, k * self.size, self.rate or form.rate, out.astype(np.float32).tolist()


@dataclass
class Written(WriterCommitMessage):
    """Files of a task as (staged name, final name), and its rows where the driver needs them."""

    files: list[tuple[str, str]]
    rows: list


class Staged(DataSourceWriter):
    """Tasks write under a folder of the job; the driver moves what was committed and deletes the rest."""

    own: tuple[str, ...] = ()  # files that the driver writes

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.options, self.path, self.overwrite = schema, options, options["path"], overwrite
        self.stage = f"_writing-{uuid.uuid4().hex}"

    def place(self, *names: str) -> str:
        return posixpath.join(opened(self.path)[1], *names)

    def stream(self, name: str):
        """An open file of this attempt and its staged name."""
        fs, own = opened(self.path)[0], f"{self.stage}/{uuid.uuid4().hex}"
        fs.create_dir(self.place(own), recursive=True)
        return fs.open_output_stream(self.place(own, name)), f"{own}/{name}"

    def extra(self, messages: list[Written]) -> None:
        """What the driver writes itself."""

    def commit(self, messages: list[Written | None]) -> None:
        fs, done = opened(self.path)[0], [m for m in messages if m is not None]
        names = [to for m in done for _, to in m.files]
        fs.create_dir(self.place(), recursive=True)
        there = set() if self.overwrite else {posixpath.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(self.place()))}
        if len(set(names)) < len(names) or there & {*names, *self.own}:
            self.abort(messages)
            raise ValueError(f"several rows would write one file, or it is there already: {max(names, key=names.count, default='')}")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(self.place())):
                if f.is_file:
                    fs.delete_file(f.path)
        for m in done:
            for name, to in m.files:
                fs.move(self.place(name), self.place(to))
        self.extra(done)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs = opened(self.path)[0]
        if fs.get_file_info(self.place(self.stage)).type != pafs.FileType.NotFound:
            fs.delete_dir(self.place(self.stage))


class NamedWriter(Staged):
    """A file for each row(name, content): text or bytes."""

    def write(self, rows: Iterator[Row]) -> Written:
        files = []
        for row in rows:
            name, content = str(row["name"]), row["content"]
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"not a file name: {name!r}")
            out, staged = self.stream(name)
            with out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
            files.append((staged, name))
        return Written(files, [])


class WavWriter(NamedWriter):
    """A file key.wav for each row: mono 16-bit PCM."""

    def write(self, rows: Iterator[Row]) -> Written:
        return super().write({"name": f"{r['key']}.wav", "content": wav.build(np.asarray(r["samples"], float), r["sample_rate"])} for r in rows)


class CsvWriter(Staged):
    """Part files in the order of partitions, so of sorted rows; the first has the header. Quotes only where needed."""

    own = ("part-00000000.csv",)

    def text(self, values: list) -> str:
        def field(v) -> str:
            t = "" if v is None else "true" if v is True else "false" if v is False else str(v)
            return f'"{t.replace(chr(34), chr(34) * 2)}"' if any(c in t for c in '",\n') else t

        return ",".join(map(field, values)) + "\n"

    def write(self, rows: Iterator[Row]) -> Written:
        part, out = TaskContext.get().partitionId(), None
        for row in rows:
            if out is None:
                out, name = self.stream("part.csv")
            out.write(self.text(list(row)).encode())
        if out is None:
            return Written([], [])
        out.close()
        return Written([(name, f"part-{part + 1:08d}.csv")], [])

    def extra(self, messages: list[Written]) -> None:
        with opened(self.path)[0].open_output_stream(self.place("part-00000000.csv")) as out:
            out.write(self.text(self.schema.names).encode())


class ReportWriter(Staged):
    """report.json: a list of the rows, by partition. At most `rows` of them (1000), a report isn't a table."""

    own = ("report.json",)

    def write(self, rows: Iterator[Row]) -> Written:
        most, got = int(self.options.get("rows", 1000)), []
        for row in rows:
            got.append(row.asDict(True))
            if len(got) > most:
                raise ValueError(f"a report of more than {most} rows")
        return Written([], [(TaskContext.get().partitionId(), got)])

    def extra(self, messages: list[Written]) -> None:
        rows = [r for _, part in sorted((x for m in messages for x in m.rows), key=lambda x: x[0]) for r in part]
        if len(rows) > int(self.options.get("rows", 1000)):
            raise ValueError("too many rows for a report")
        with opened(self.path)[0].open_output_stream(self.place("report.json")) as out:
            out.write(json.dumps(rows, ensure_ascii=False, indent=1, default=str).encode())


class Wav(DataSource):
    """option header=true: without samples, only headers are read."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEAD if str(self.options.get("header", "false")).lower() == "true" else CHUNK if "size" in self.options else FULL

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(schema, self.options)

    def streamReader(self, schema: StructType) -> WavStream:  # noqa: N802
        return WavStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(schema, self.options, overwrite)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(schema, self.options, overwrite)


class OrderedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_csv"

    def writer(self, schema: StructType, overwrite: bool) -> CsvWriter:
        return CsvWriter(schema, self.options, overwrite)


class JsonReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to a session."""
    ship(spark)
    for source in (Wav, NamedFiles, OrderedCsv, JsonReport):
        spark.dataSource.register(source)
    return spark
