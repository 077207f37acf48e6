"""State machines: known values, and the same results in batch and in streaming."""

import math

import pytest
from pyspark.sql import functions as F

from phonolith.operators import catalog, islands
from phonolith.operators.plugins import PluginError, Plugins
from phonolith.streaming import folds, mergers
from phonolith.streaming.runner import fold_batch, fold_stream, sessions, windowed


def run(fold, rows):
    return [o for r in rows for o in fold.step(r)]


def test_noise_floor_adapts():
    f = folds.NoiseFloor()
    quiet = [f.observe(0.001, 0.1) for _ in range(50)]
    assert quiet[-1] < f.start and all(a >= b for a, b in zip(quiet, quiet[1:]))
    before = f.floor
    assert f.observe(0.2, 0.1, rejected=True) >= before and f.silence == 0
    assert f.observe(math.nan, 0.1) == f.floor and f.observe(0.1, 0) == f.floor
    assert len(f.quiet) <= 64


def test_hysteresis():
    probs = [0.6, 0.6, 0.4, 0.1, 0.1, 0.1, 0.4, 0.1, 0.1, 0.1, 0.1]
    got = [o["speaking"] for o in run(folds.Hysteresis(), [{"prob": p} for p in probs])]
    assert got == [False, True, True, True, True, True, True, True, True, True, False]


def test_hysteresis_by_windows_equals_fold(spark):
    values = [None, math.nan, 0.0, 0.35, 0.36, 0.5, 0.9]
    rows = [(k, n, values[(n * n * (k + 3) + n // 7) % 7] if k else 0.9) for k in range(5) for n in range(200)]
    d = spark.createDataFrame(rows, "k int, n int, prob double")
    for shape in ({}, {"enter": 1, "leave": 1}, {"enter": 3, "leave": 2, "offset": 0.0}):
        want = {(k, n): o["speaking"] for k in range(5) for f in [folds.Hysteresis(**shape)] for _, n, p in [r for r in rows if r[0] == k] for o in f.step({"prob": p})}
        got = islands.hysteresis(d, ["k"], ["n"], F.col("prob"), **shape)
        assert got.columns == ["k", "n", "prob", "speaking"] and {(r["k"], r["n"]): r["speaking"] for r in got.collect()} == want
    assert islands.hysteresis(d.filter("false"), ["k"], ["n"], F.col("prob")).count() == 0


def test_gate_and_detector():
    levels = [0.0005] * 10 + [0.002, 0.02] + [0.2] * 10 + [0.0005] * 30
    gate = folds.RoughGate()
    rows = run(gate, [{"rms": x} for x in levels])
    starts, ends = [r for r in rows if r["start"]], [r for r in rows if r["end"]]
    assert len(starts) == len(ends) == 1 and starts[0]["onset"] < starts[0]["frame"] < ends[0]["frame"]
    segments = run(folds.GatedDetector(), [{"rms": x} for x in levels])
    assert [s["reason"] for s in segments] == ["silence"] and segments[0]["start_frame"] >= 0
    long = run(folds.GatedDetector(), [{"rms": x} for x in [0.0005] * 5 + [0.2] * 100])
    assert len(long) >= 2 and {s["reason"] for s in long} == {"max-duration"}
    assert all(a["end_frame"] <= b["start_frame"] for a, b in zip(long, long[1:]))


def test_windows():
    b = folds.WindowBuilder(rate=4)
    assert b.build(0, 4) is None and b.build(0, 6) == (0, 6)
    b = folds.WindowBuilder(rate=4, least_s=2.0)
    b.mature(4)
    assert b.build(0, 12) == (4, 12)
    assert b.build(0, 20, lambda a, e: 5) == (5, 20)
    w = folds.RollingWindow(most=3.0, overlap=1.0)
    assert [r["first"] for r in run(w, [{"sequence": i, "seconds": 1.0} for i in range(6)])] == [0, 0, 0, 1, 2, 3]


def test_utterances():
    words = [("Hello", 0.0, 0.4), ("world.", 0.4, 0.8), ("This", 0.9, 1.0), ("is", 1.0, 1.1), ("still", 1.1, 1.3), ("running", 1.3, 1.6)]
    m = mergers.Utterances()
    s = m.process(words)
    assert (s["settled"], s["preview"], s["cursor"]) == ("Hello world.", "This is still running", 0.8)
    again = m.process(words)
    assert again["settled"] == "" and again["revision"] == 2
    assert m.finalize()["settled"] == "This is still running" and m.finalize() == {"revision": 3, "settled": "", "preview": "", "cursor": 1.6}
    far = [("Hello", 9.0, 9.4), ("world.", 9.4, 9.8), ("x", None, None)]
    assert m.process(far)["settled"] == "Hello world."  # at another time it is said anew


def test_utterances_state_is_bounded():
    m = mergers.Utterances(memory=8)
    out = [m.process([(f"s{i}.", i, i + 0.5), ("open", i + 0.5, i + 0.9)]) for i in range(500)]
    assert [o["settled"] for o in out] == [f"s{i}." for i in range(500)] and len(m.tail) == 8


def aligned(f, ids, frames, start, overlap):
    return f.step({"ids": ids, "frames": frames, "start": start, "overlap": overlap})[0]


def test_token_mergers():
    a = mergers.Aligned(frame_s=1.0, near_s=0.2)
    assert aligned(a, [1, 2, 3], [0, 1, 2], 0.0, 0.0)["pending"] == [1, 2, 3]
    assert aligned(a, [2, 3, 4], [0, 1, 2], 1.0, 2.0) == {"anchors": 2, "settled": [1], "pending": [4]}
    assert aligned(a, [3, 4, 5], [0, 1, 2], 2.0, 2.0) == {"anchors": 1, "settled": [3], "pending": [5]}  # 3 is seen twice
    assert aligned(a, [9], [0], 300.0, 0.0)["settled"] == [] and not a.settled.of and not a.votes  # what can't come again is forgotten


def test_votes_round_half_up():
    a = mergers.Aligned(frame_s=0.25, stable=1)
    aligned(a, [7], [1], 0.0, 0.0)
    aligned(a, [7], [1], 0.0, 1.0)
    assert list(a.votes) == [(7, 3)]


def common(f, ids, start, overlap, p=None):
    return f.step({"ids": ids, "frames": list(range(len(ids))), "log_probs": p or [-1] * len(ids), "start": start, "overlap": overlap})[0]


def test_common_run():
    c = mergers.CommonRun(frame_s=1.0)
    common(c, [1, 2, 3, 4], 0.0, 0.0)
    assert common(c, [2, 3, 4, 5], 1.0, 3.0) == {"run": 3, "settled": [1, 2, 3, 4], "pending": [5]}
    assert mergers.longest_run([1, 2, 3, 9, 2, 3], [0, 2, 3]) == (1, 1, 2) and mergers.longest_run([1], [2]) == (0, 0, 0)
    c = mergers.CommonRun(frame_s=1.0)
    out = [common(c, ids, start, overlap) for ids, start, overlap in (([1, 2, 3], 0.0, 0.0), ([2, 3], 1.0, 9.0), ([7, 8, 9], 5.0, 0.0), ([9, 10], 7.0, 1.0))]
    assert [o["settled"] for o in out] == [[], [1, 2, 3], [], [7, 8, 9]] and out[-1]["pending"] == [10]  # an empty state begins anew
    for p, kept in (([0, 0], "mine"), ([-1, -1], "mine"), ([5.0, 5.0], "theirs")):  # without likelihoods the pending side stays
        c = mergers.CommonRun(frame_s=1.0)
        common(c, [1, 2], 0.0, 0.0, [0, 0] if p == [0, 0] else [-0.5, -0.5])
        c.step({"ids": [1, 2], "frames": [3, 4], "log_probs": p, "start": 0.0, "overlap": 9.0})
        mine = mergers.CommonRun(frame_s=1.0)
        mine.pending = [(1, 0.0, 0.0), (2, 1.0, 0.0)]
        _, got = mine._agreed([(1, 3.0, p[0]), (2, 4.0, p[1])])
        assert [t[1] for t in got] == ([0.0, 1.0] if kept == "mine" else [3.0, 4.0])


def test_voice_detector():
    probs = [0.1] * 10 + [0.9] * 6 + [0.1] * 8 + [0.9] * 2 + [0.1] * 5
    d = folds.VoiceDetector(hop=16, rate=1000, preroll_ms=32.0, enter=3, leave=5)
    got = run(d, [{"prob": p} for p in probs])
    assert got == [{"start_frame": 128, "end_frame": 336, "reason": "vad-silence"}] and d.phase == "listening"
    long = run(folds.VoiceDetector(hop=16, rate=1000, preroll_ms=0.0, most_ms=160.0), [{"prob": 0.9}] * 30)
    assert [x["reason"] for x in long] == ["max-duration"] * len(long) and all(a["end_frame"] == b["start_frame"] for a, b in zip(long, long[1:]))
    assert run(folds.VoiceDetector(), [{"prob": None}, {"prob": math.nan}] * 20) == []


def test_hops_adapter():
    f = folds.Hops(len, 4)
    assert [f.step({"samples": [0] * n}) for n in (3, 6, 1)] == [[], [{"frame": 0, "prob": 1.0}, {"frame": 4, "prob": 1.0}], []] and len(f.held) == 2


def test_decoders():
    hot = lambda i, n: [8.0 if j == i else -8.0 for j in range(n)]
    got = mergers.decode_durations([hot(1, 3) + hot(2, 3), hot(2, 3) + hot(1, 3), hot(0, 3) + hot(0, 3), hot(2, 3) + hot(1, 3)], 3)
    assert [(t["id"], t["frame"], t["end_s"]) for t in got] == [(1, 0, 0.16), (2, 3, 0.32)]
    assert len(mergers.decode_durations([hot(1, 2) + hot(0, 2)], 2, cap=3)) == 3
    assert [t["id"] for t in mergers.decode_transducer([[hot(1, 3), hot(2, 3), hot(0, 3)], [hot(0, 3)]])] == [1, 2]
    assert mergers.decode_attention([hot(2, 4), hot(3, 4), hot(1, 4)], end=3, budget=5) == ([2], False)
    assert mergers.decode_attention([hot(2, 4)] * 5, end=3, budget=2) == ([2, 2], True)
    assert mergers.best([math.nan, 1.0, 1.0]) == 1


@pytest.mark.parametrize(("make", "schema", "columns"), [(folds.Hysteresis, "speaking boolean", ["prob"]), (folds.NoiseFloor, "floor double", ["energy", "seconds"])])
def test_stream_equals_batch(spark, tmp_path, make, schema, columns):
    d = spark.range(600).select((F.col("id") % 5).alias("k"), F.col("id").alias("n"), F.abs(F.sin("id")).alias("prob"), F.abs(F.cos("id")).alias("energy"), F.lit(0.1).alias("seconds"))
    d = d.select("k", "n", *columns)
    for part in range(3):  # in order from file to file
        d.filter((F.col("n") >= part * 200) & (F.col("n") < part * 200 + 200)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, fold_batch(d, "k", ["n"], make, schema).collect()))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{make.__name__}"
    q = fold_stream(stream, "k", ["n"], make, schema).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == want


def test_event_time(spark):
    d = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("t"), (F.col("id") % 2).alias("k"))
    assert windowed(d, "t", "1 hour", "10 minutes", None, ["k"], F.count("*").alias("n")).agg(F.sum("n")).first()[0] == 100
    assert sessions(d, "t", "1 hour", "5 minutes", ["k"], F.count("*").alias("n")).count() == 2


def test_backend_selection(spark):
    row = ("b", True, False, ["fp16"], ["gpu"], False, True, 1, ["node"], 1)
    schema = "id string, available boolean, experimental boolean, precisions array<string>, acceleration array<string>, shared_buffer boolean, fallback boolean, priority int, environments array<string>, reg int"
    b = spark.createDataFrame([row, ("a", *row[1:9], 2)], schema)
    assert catalog.select(b, catalog.Criteria(precision="fp16"), []) == "b" and catalog.select(b, catalog.Criteria(), ["a"]) == "a"
    for frame, said in ((b.filter("false"), "registered"), (b.withColumn("available", F.lit(False)), "available"), (b, "fits")):
        with pytest.raises(catalog.BackendError, match=said):
            catalog.select(frame, catalog.Criteria(precision="int4"), [])


def test_plugins():
    p = Plugins()
    p.register("transcribe", "x", len)
    assert p.get("transcribe", "x") is len and p.names("transcribe") == ["x"]
    for call in (lambda: p.register("transcribe", "x", len), lambda: p.register("other", "y", len), lambda: p.get("activity", "x")):
        with pytest.raises(PluginError):
            call()


def test_recognition(spark):
    from pyspark.sql import functions as F

    from phonolith.operators.plugins import Normalizer, mean_confidence, spread_words

    p = Plugins()
    p.register("rate_policy", "two", lambda x: F.lit(2))
    p.register("transcribe", "counts", lambda x, rate: F.when(F.size(x) > 0, F.repeat(F.lit("ab c "), F.size(x))).otherwise(F.lit("")))
    p.register("tokenizer", "none", lambda text: F.expr("cast(array() as array<int>)"))
    p.register("timestamps", "spread", spread_words)
    p.register("confidence", "mean", mean_confidence)
    hooks = {"rate_policy": "two", "transcribe": "counts", "tokenizer": "none", "timestamps": "spread", "confidence": "mean"}
    p.register("family", "f", lambda: hooks)
    p.register("family", "half", lambda: {"transcribe": "counts"})
    p.register("preset", "p", lambda: ("f", {}))
    p.register("preset", "bad", lambda: ("half", {}))
    p.register("preset", "lost", lambda: ("f", {"confidence": "other"}))
    d = spark.createDataFrame([(1, [0.5, 0.5], "kept"), (2, [], "kept")], "id long, x array<double>, native string").drop("native")
    rows = p.recognise(d, "p", F.col("x")).select("id", *[Normalizer("n").to_envelope(F.col("native"), level).alias(level) for level in ("text", "segments", "words")]).orderBy("id").collect()
    words = rows[0]["words"]["canonical"]
    assert [(w["text"], w["start_s"], w["end_s"], w["confidence"]) for w in words["words"]] == [("ab", 0, 0.25, 0.5), ("c", 0.25, 0.5, 1), ("ab", 0.5, 0.75, 0.5), ("c", 0.75, 1, 1)]
    assert words["segments"][0].asDict() == {"text": "ab c ab c", "start_s": 0, "end_s": 1, "confidence": 0.75} and words["family"] == "f" and words["normalizer"] == "n"
    assert rows[0]["words"]["native"]["text"] == "ab c ab c " and rows[0]["segments"]["canonical"]["words"] is None and rows[0]["segments"]["canonical"]["segments"] and rows[0]["text"]["canonical"]["segments"] is None
    empty = rows[1]["words"]["canonical"]
    assert (empty["text"], empty["words"], empty["segments"], empty["confidence"]["words"]) == ("", None, None, None)
    for preset in ("bad", "lost", "unknown"):
        with pytest.raises(PluginError):
            p.recognise(d, preset, F.col("x"))


def test_plugin_contracts(spark):
    p, d = Plugins(), spark.createDataFrame([([0.5, 1.5],)], "x array<double>")
    p.register("activity", "first", lambda x: F.get(x, F.lit(0)))
    p.register("activity", "text", lambda x: F.lit("loud"))
    p.register("preset", "any", dict)
    assert p.apply(d, "activity", "first", "p", F.col("x")).first()["p"] == 0.5
    for kind, name in (("activity", "text"), ("activity", "none"), ("preset", "any")):
        with pytest.raises(PluginError):
            p.apply(d, kind, name, "p", F.col("x"))


def test_null_keys_are_one_stream(spark):
    d = spark.createDataFrame([(None, 1, 0.6), (None, 2, 0.6), (4, 1, 0.6), (4, 2, 0.6)], "k long, at int, prob double")
    both = fold_batch(d, "k", ["at"], folds.Hysteresis, "speaking boolean")
    assert sorted(map(tuple, both.collect()), key=str) == [(4, False), (4, True), (None, False), (None, True)]
    assert fold_batch(d.filter("false"), "k", ["at"], folds.Hysteresis, "speaking boolean").collect() == []
