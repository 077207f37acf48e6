"""Data sources: ranges of WAV files, streams that grow and start again, writers that leave nothing half done."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.sources import files, wav


@pytest.fixture(scope="module")
def known(spark):
    return files.register(spark)


def audio(n, rate=8000, phase=0.0):
    return wav.build(np.sin(np.arange(n) * 0.05 + phase) * 0.9, rate)


def test_ranges_of_files(known, tmp_path):
    """Whatever the range, the samples are those of the whole file; small files share a partition."""
    rng = np.random.default_rng(1)
    for k, (code, channels, bits) in enumerate([(1, 1, 16), (1, 2, 16), (1, 3, 24), (1, 1, 8), (3, 2, 32), (3, 1, 64), (1, 1, 32)]):
        body = rng.normal(0, 0.1, 700 * channels).astype("<f4" if bits == 32 else "<f8").tobytes() if code == 3 else rng.integers(0, 256, 700 * channels * bits // 8, np.uint8).tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 0, b"WAVE", b"fmt ", 16, code, channels, 8000, 0, 0, bits)
        (tmp_path / f"f{k}.wav").write_bytes(head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body)
    (tmp_path / "none.wav").write_bytes(audio(0))
    whole = {f"f{k}": wav.parse((tmp_path / f"f{k}.wav").read_bytes())[1] for k in range(7)}
    for split in (64, 999, 1 << 20):
        df = known.read.format("wav").option("split", split).load(str(tmp_path))
        parts = {}
        for r in sorted(df.collect(), key=lambda r: (r["key"], r["first_frame"])):
            assert r["first_frame"] == len(parts.get(r["key"], []))
            parts.setdefault(r["key"], []).extend(r["samples"])
        assert parts.pop("none") == [] and parts.keys() == whole.keys() and all(np.array_equal(parts[k], whole[k]) for k in whole)
    assert df.rdd.getNumPartitions() == 1
    heads = known.read.format("wav").option("header", "true").load(f"file://{tmp_path}")
    assert "samples" not in heads.columns and {r["key"]: (r["channels"], r["bits"], r["frames"]) for r in heads.collect()}["f2"] == (3, 24, 700)
    assert known.read.format("wav").load(str(tmp_path / "nothing")).collect() == []


def test_labels(known, tmp_path):
    for k, n in (("a", 10), ("b", 20), ("c", 30)):
        (tmp_path / f"{k}.wav").write_bytes(audio(n))
    for k in "bc":
        (tmp_path / f"{k}.json").write_text(json.dumps({"transcription": f"{k}!"}))
    (tmp_path / "d.json").write_text("{}")
    heads = known.read.format("wav").option("header", "true").load(str(tmp_path))
    got = heads.join(wav.labels(known, str(tmp_path)).withColumnRenamed("stem", "key"), "key").collect()
    assert {(r["key"], r["frames"], r["transcription"]) for r in got} == {("b", 20, "b!"), ("c", 30, "c!")}


def chunks(known, folder, at, name, rate=0):
    df = known.readStream.format("wav").option("size", 100).option("rate", rate).load(str(folder))
    df.writeStream.format("parquet").option("path", str(at / name)).option("checkpointLocation", str(at / f"{name}-offsets")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["key"], r["sequence"], r["first_frame"], r["samples"]) for r in known.read.parquet(str(at / name)).collect())


@pytest.mark.parametrize("rate", [0, 16000, 5000])
def test_stream_starts_again(known, tmp_path, rate):
    """A recording grows between runs of a stream; its chunks are those of the whole, once each, and can be replayed."""
    folder, whole = tmp_path / "in", audio(1050)
    folder.mkdir()
    for size in (30, 44 + 2 * 330, 44 + 2 * 331 + 1, len(whole)):
        (folder / "mic.wav").write_bytes(whole[:size])
        got = chunks(known, folder, tmp_path, "out", rate)
        if size == len(whole):
            continue
        assert [r[1] for r in got] == list(range(len(got)))
    (folder / "next.wav").write_bytes(audio(130, phase=1.0))
    got = chunks(known, folder, tmp_path, "out", rate)
    assert got == chunks(known, folder, tmp_path, "again", rate)
    x = wav.parse(whole)[1].astype(float)
    ratio = 8000 / rate if rate else 1
    at = np.arange(len(x)) if ratio == 1 else np.arange(0, len(x) * 4) * ratio
    at = at if ratio == 1 else at[at + 1 < len(x)]
    want = np.interp(at, np.arange(len(x)), x)
    mic = [r for r in got if r[0] == "mic"]
    assert [r[2] for r in mic] == [100 * k for k in range(-(-len(want) // 100))]
    assert np.allclose(np.concatenate([r[3] for r in mic]), want, atol=1e-6) and any(r[0] == "next" for r in got)


def test_ordered_csv(known, tmp_path):
    """Part files in the rows' order, the header first and once."""
    df = known.range(500).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit('q"'), "id", F.lit(",\n"))).alias("t"), (F.col("id") % 2 == 0).alias("even"))
    df.repartition(7).repartitionByRange(5, F.desc("id")).sortWithinPartitions(F.desc("id")).write.format("ordered_csv").mode("append").save(str(tmp_path / "c"))
    parts = sorted((tmp_path / "c").iterdir())
    text = "".join(p.read_text() for p in parts)
    want = "id,t,even\n" + "".join(f'{i},{chr(34) + "q" + chr(34) * 2 + str(i) + "," + chr(10) + chr(34) if i % 3 == 0 else ""},{str(i % 2 == 0).lower()}\n' for i in range(499, -1, -1))
    assert text == want and len(parts) == 6
    with pytest.raises(Exception, match="there already"):
        df.write.format("ordered_csv").mode("append").save(str(tmp_path / "c"))
    assert sorted((tmp_path / "c").iterdir()) == parts
    df.limit(0).write.format("ordered_csv").mode("overwrite").save(str(tmp_path / "c"))
    assert [p.read_text() for p in (tmp_path / "c").iterdir()] == ["id,t,even\n"]


def test_failed_writes_leave_nothing(known, tmp_path):
    bad = known.range(6).select(F.concat(F.lit("r"), "id").alias("key"), F.lit(8000).alias("sample_rate"), F.array(F.when(F.col("id") == 5, F.raise_error(F.lit("no"))).otherwise(0.5).cast("double")).alias("samples"))
    with pytest.raises(Exception, match="no"):
        bad.repartition(3).write.format("wav").mode("append").save(str(tmp_path / "w"))
    twice = known.range(4).select(F.lit("same").alias("name"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="several rows"):
        twice.write.format("named_files").mode("append").save(str(tmp_path / "w"))
    with pytest.raises(Exception, match="not a file name"):
        twice.withColumn("name", F.lit("../x")).write.format("named_files").mode("append").save(str(tmp_path / "w"))
    with pytest.raises(Exception, match="more than 3"):
        twice.coalesce(1).write.format("json_report").option("rows", 3).mode("append").save(str(tmp_path / "w"))
    assert not (tmp_path / "w").exists() or list((tmp_path / "w").iterdir()) == []
    twice.limit(2).write.format("json_report").mode("append").save(str(tmp_path / "w"))
    assert json.loads((tmp_path / "w" / "report.json").read_text()) == [{"name": "same", "content": "x"}] * 2


def test_small_ranges_share_partitions(tmp_path):
    """Rows of few bytes don't make a task each; every range is there once, in order."""
    from pyspark.sql.types import StructType

    for k in range(40):
        (tmp_path / f"a{k:02d}.wav").write_bytes(wav.build(np.zeros(1000 + k), 16000))
    made = files.WavReader(StructType().add("samples", "string"), {"path": str(tmp_path), "split": "64"}).partitions()
    parts = [p for m in made for p in m.parts]
    assert 100 < len(made) < 2 * files.TASKS < len(parts) and len(set(parts)) == len(parts)
    assert sum(n for _, _, n in parts) == sum(1000 + k for k in range(40)) and parts == sorted(parts)
