"""Operators that no task or row may hold a group for, against plain Python; skewed keys and long texts."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phonolith.functions import edits, text as T
from phonolith.operators import merging, selection, stats, transcript, windows
from phonolith.streaming import folds, mergers, session
from phonolith.streaming.runner import coalesced


def test_selection(spark):
    """Ranks of groups of any shape equal those of sorted lists; a key with most rows, ties, outliers, nulls."""
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 30), 5.0])) for _ in range(20_000)] + [("ties", float(i % 3)) for i in range(100)]
    rows += [(None, -1.5), ("one", 1e300), ("none", None), ("two", 1.0), ("two", 3.0), ("big", -1e308), ("big", 1e308)] + [("hot", None)] * 50
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    groups = defaultdict(list)
    for k, v in rows:
        groups[k] += [v] if v is not None else []
    for accuracy in (100_000, 100):
        ranks = [*selection.MIDDLE, *[selection.nearest(f"p{i}", q) for i, q in enumerate((0.0, 0.001, 0.1, 0.9, 0.999, 1.0))]]
        got = {r["k"]: r for r in selection.select(df, ["k"], "v", ranks, accuracy).collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            x, n = sorted(values), len(values)
            if not n:
                assert set(got[k].asDict().values()) == {k, None}
                continue
            assert (got[k]["_low"], got[k]["_high"]) == (x[(n - 1) // 2], x[n // 2])
            assert [got[k][f"p{i}"] for i in range(6)] == [x[max(1, math.ceil(round(q * n, 6))) - 1] for q in (0.0, 0.001, 0.1, 0.9, 0.999, 1.0)]
    every = selection.select(df, [], "v", [selection.nearest("p", 0.5)]).collect()
    x = sorted(v for _, v in rows if v is not None)
    assert [r["p"] for r in every] == [x[math.ceil(len(x) / 2) - 1]]
    assert selection.select(df.filter("false"), ["k"], "v", ranks).collect() == []


def test_coarse_summary(spark):
    rows = [("a" if i % 3 else "b", float(i * i % 1001)) for i in range(3000)] + [("c", float("nan")), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    plain, coarse = (sorted(stats.summary(df, ["k"], "v", coarse=c).collect()) for c in (False, True))
    assert plain == coarse


def run_by_hand(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    return best if best[2] else None


def test_common_run(spark):
    rng = random.Random(4)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(40))], [rng.choice("abcd") for _ in range(rng.randrange(40))]) for _ in range(150)]
    pairs += [([], []), (["x"], ["x"]), (["x"], ["y"]), (["x"] * 7, ["x"] * 5), (list("abcabc"), list("bcabca"))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", T.common_run(F.col("a"), F.col("b")).alias("r")).collect()}
    assert {i: tuple(r) if r else None for i, r in got.items()} == {i: run_by_hand(*p) for i, p in enumerate(pairs)}


def test_common_run_of_equal_words(spark):
    """100,000 equal words on both sides are no more work than other words."""
    same = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.lit("w"))
    began = time.monotonic()
    r = spark.range(1).select(T.common_run(same, F.concat(F.array(F.lit("z")), F.slice(same, 1, 99_000))).alias("r")).first()["r"]
    assert tuple(r) == (0, 1, 99_000) and time.monotonic() - began < 90


def test_prefix_lengths(spark):
    rng = random.Random(5)
    texts = [[rng.choice(["▁a", "bc", "▁", "▁▁d", ".", "▁,", "<blank>", "<eou>", "", "e▁", " f ", "\t", "é😀"]) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(k, i, p) for k, t in enumerate(texts) for i, p in enumerate(t)], "k int, i int, p string")
    whole = spark.createDataFrame([(k, i, t[: i + 1]) for k, t in enumerate(texts) for i in range(len(t))], "k int, i int, t array<string>")
    want = {(r["k"], r["i"]): r["n"] for r in whole.select("k", "i", F.length(T.decode_pieces(F.col("t"))).alias("n")).collect()}
    assert {(r["k"], r["i"]): r["n"] for r in transcript.prefix_lengths(df, ["k"], "i", "p").collect()} == want


def test_pieces_of_a_hot_key(spark):
    """A key with a third of all rows comes as pieces of bounded size; put together they are its joined text."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id", F.when(F.col("id") % 50 != 0, F.repeat(F.lit("x"), (F.col("id") % 30).cast("int"))).alias("t"))
    rows = transcript.joined_pieces(df, ["k"], ["id"], "t", "; ", 500).collect()
    hot = sorted((r["piece"], r["begin"], r["text"]) for r in rows if r["k"] == 0)
    text = "; ".join("x" * (i % 30) if i % 50 else "" for i in range(0, 6000, 3))
    assert "".join(t for _, _, t in hot) == text and all(len(t) < 600 for _, _, t in hot) and len(hot) > 50
    at = 0
    for _, begin, t in hot:
        assert begin == at
        at += len(t)


@pytest.mark.parametrize("steps", [1, 3])
def test_coalesced_stream(spark, tmp_path, steps):
    """In update mode the last row of each slot is what a batch gives; other events come once."""
    rng = random.Random(6)
    events = sorted((1_700_000_000_000 + rng.randrange(3000), i, rng.choice(["metrics", "metrics", "start", "end"]), i % 2, rng.random()) for i in range(200))
    schema = "ms long, id int, kind string, user int, level double"
    late = lambda d: d.select(F.timestamp_millis("ms").alias("ts"), "id", "kind", "user", "level")
    batch = coalesced(late(spark.createDataFrame(events, schema)), "ts", "1 second", "33 milliseconds", "user", "kind", "metrics", ["id"])
    want = sorted((r["user"], r["kind"], r["ts"], r["last"]["id"], r["last"]["level"]) for r in batch.collect())
    slots = {}
    for ms, i, kind, user, level in events:
        slots[(user, kind, ms // 33) if kind == "metrics" else i] = (user, kind, i, level)
    assert sorted((u, k, i, v) for u, k, _, i, v in want) == sorted(slots.values())
    for n in range(steps):
        spark.createDataFrame(events[n * 200 // steps : (n + 1) * 200 // steps], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = late(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out, seen = coalesced(stream, "ts", "1 second", "33 milliseconds", "user", "kind", "metrics", ["id"]), {}

    def take(df, _):
        for r in df.collect():
            slot = (r["user"], "m", int(r["ts"].timestamp() * 1000 + 0.5) // 33) if r["kind"] == "metrics" else r["last"]["id"]
            assert r["kind"] == "metrics" or slot not in seen
            seen[slot] = (r["user"], r["kind"], r["ts"], r["last"]["id"], r["last"]["level"])

    out.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen.values()) == want


@pytest.mark.parametrize("timed", [False, True])
def test_repeats_far_back(spark, timed):
    """A sentence that comes again after 300 others is dropped; with times, only near its first end."""
    rng = random.Random(10)
    rows = [(0, i, [f"word{i % 301}", f"s{i % 301}.", "and", "open"], [t, t + 0.1, t + 0.2, None], i == 699) for i in range(700) for t in [round(i % 301 + (0.0 if i < 301 else rng.choice([0.0, 0.1, 0.2, 0.4])), 1)]]
    rows += [(1, 0, [], [], False), (1, 1, ["a."], [1.0], True), (2, 0, ["x.", "X.", "x.", "y"], [None, 5.0, 9.0, 9.5], True)]
    df = spark.createDataFrame(rows, "k int, n int, w array<string>, e array<double>, final boolean")
    got = merging.settled(df, "k", "n", "w", "e" if timed else None, "final").collect()
    want = []
    for k in (0, 1, 2):
        one = mergers.Utterances(memory=10**9)
        for _, n, words, ends, final in (r for r in rows if r[0] == k):
            *done, last = mergers.cut_sentences([(w, None, e if timed else None) for w, e in zip(words, ends)]) or [[]]
            for s in done + ([last] if final and last else []):
                want += [(k, n, t) for t in one._settle([s])]
    assert sorted((r["k"], r["n"], r["text"]) for r in got) == sorted(want)
    if not timed:
        assert sum(r["k"] == 0 for r in got) == 302


def edits_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(now[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = now
    return row[-1]


def test_edits(spark):
    rng = random.Random(7)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abé😀"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(14))) for _ in "ab")
        assert edits.distance(a, b) == edits_by_hand(a, b)
    rows = [(" ".join(rng.choice(["one", "two", "three", str(i)]) for i in range(rng.randrange(150))), " ".join(rng.choice(["one", "two", "four", str(i)]) for i in range(rng.randrange(150)))) for _ in range(25)] + [("", ""), ("", "a b"), (None, "a"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"wa": T.words(F.col("a")), "wb": T.words(F.col("b"))})
    for r in df.select("a", "b", edits.char_edits("a", "b").alias("c"), edits.item_edits("wa", "wb").alias("w")).collect():
        known, a, b = r["a"] is not None and r["b"] is not None, r["a"] or "", r["b"] or ""  # words of null are none
        assert r["c"] == (edits_by_hand(a, b) if known else None) and r["w"] == edits_by_hand(a.split(), b.split())


def test_edits_of_long_texts(spark):
    """Two unlike texts of 30,000 characters, and 20,000 words of as many kinds: whole, in seconds."""
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(30_000)) for _ in "ab")
    began = time.monotonic()
    got = spark.createDataFrame([(a, b)], "a string, b string").select(edits.char_edits("a", "b"), F.levenshtein("a", "b")).first()
    assert got[0] == got[1]
    words = [str(i) for i in range(20_000)]
    assert edits.distance(words, words[5:] + ["x"]) == 6 and edits.distance(words, words[::-1]) <= 20_000
    assert time.monotonic() - began < 90


def test_batch_plans_equal_folds(spark):
    """What streams carry from row to row, as windows in batch: stretches, resampled chunks, rings, accumulated texts."""
    rng = random.Random(11)
    rows, pushes = [], []
    for k in range(12):
        end = cursor = 0
        for n in range(60):
            end += rng.randrange(4000, 40000)
            cursor = max(cursor, rng.choice([0, 0, end - rng.randrange(20000)]) if k % 3 else 0)
            rows.append((k, n, max(0, end - 900_000), end, rng.choice([None, cursor]) if k % 2 else cursor or None, rng.choice([None, None, end - rng.randrange(9000)]) if k % 4 else None))
            pushes.append((k, n, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 7, 200]))], rng.choice([" a ", "b\n", "", None]), rng.random() < 0.4))
    want = []
    for k in range(12):
        builder = folds.WindowBuilder()
        for r in (r for r in rows if r[0] == k):
            builder.mature(r[4] or 0, r[5])
            got = builder.build(r[2], r[3])
            want += [(k, r[1], *got)] if got else []
    df = spark.createDataFrame(rows, "k int, n int, base long, end long, cursor long, sentence_end long")
    assert sorted((r["k"], r["n"], r["start"], r["stop"]) for r in windows.stretches(df, "k", ["n"]).collect()) == want
    df = spark.createDataFrame(pushes, "k int, n int, x array<double>, t string, f boolean")
    for ratio in (1.5, 0.4, 3.0):
        got, made = defaultdict(dict), defaultdict(list)
        for r in windows.resampled(df, "k", ["n"], "x", ratio, 16).collect():
            got[r["k"]][r["frame"]] = r["v"]
        for k in range(12):
            fold = session.Resampler(ratio, 16)
            for r in (r for r in pushes if r[0] == k):
                made[k] += [v for c in fold.step({"samples": r[2]}) for v in c["samples"]]
            assert sorted(got[k]) == list(range(len(made[k]))) and all(abs(got[k][i] - v) < 1e-9 for i, v in enumerate(made[k]))
    rings = {(r["k"], r["n"]): (r["base"], r["end"]) for r in windows.ring(df, "k", ["n"], F.size("x"), 100).collect()}
    texts = {(r["k"], r["n"]): (r["revision"], r["settled"], r["preview"]) for r in windows.accumulated(df, "k", ["n"], "t", "f").collect()}
    for k in range(12):
        ring, heard = session.Ring(100), folds.Accumulator()
        for _, n, x, t, f in (r for r in pushes if r[0] == k):
            ring.write(x)
            assert rings[k, n] == (ring.base, ring.end) and texts[k, n] == tuple(heard.step({"text": t, "final": f})[0].values())


def test_resampled_edges(spark, tmp_path):
    """Streams that end with a chunk's last frame, null samples, nulls and repeated pushes: as the query's SQL has it."""
    import duckdb

    from phonolith import plans

    rng = random.Random(30)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(k * 50 + i, vector()) for k, n in enumerate([6, 12, 7, 36, 50]) for i in range(n)]
    rows += [(300 + i, [None if j == 9 * i else v for j, v in enumerate(vector())]) for i in range(8)] + [(350 + i, None if i == 3 else vector()) for i in range(9)]
    rows += [(400 + i // 2, [i // 2 / 8 + j for j in range(64)]) for i in range(14)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = plans.QUERIES["r030_chunk_resampler"](spark, str(tmp_path)).select("stream", "frame", "v").collect()
    want = con.execute(f"select stream, frame, v from ({plans.ORACLES['r030_chunk_resampler']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(r[2] is None for r in want)


def test_sliding_windows_edges(spark, tmp_path):
    """Times within half a millisecond of a slot's end, before 1970 and missing: as the query's SQL has them."""
    import duckdb

    from phonolith import plans

    con = duckdb.connect()
    near = "unnest([-1000000, -501, -500, -499, -1, 0, 1, 499, 500, 599999500])"
    con.execute(f"copy (select 1 as user_id, make_timestamp(({near} + unnest([-9000, -1200, 0, 600, 1704067200]) * 1000000::bigint)::bigint) as ts union all select i % 3, make_timestamp((i * 600000000::bigint + {near})::bigint) from range(-9, 9) t(i) union all select null, timestamp '2024-01-01 00:59:59.9996' union all select 2, null) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got = plans.QUERIES["r186_sliding_windows"](spark, str(tmp_path)).select("user_id", "window_s", "n").collect()
    want = con.execute(f"select user_id, window_s, n from ({plans.ORACLES['r186_sliding_windows']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 50


def test_edit_distance_steps_by_the_shorter_side(monkeypatch):
    """A long text against a short one takes as many steps as the short one has elements; any number of kinds."""

    def by_hand(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    class Read(str):
        reads = 0

        def __getitem__(self, i):
            Read.reads += 1
            return str.__getitem__(self, i)

    long, short = "x" + "ab" * 20_000 + "y", "c" * 30
    Read.reads = 0
    assert edits.distance(Read(long), Read(short)) == edits.distance(short, long) == len(long) and Read.reads < 500
    rng = random.Random(122)
    monkeypatch.setattr(edits, "TIDY", 3)
    for kept in (1, 1 << 24):
        monkeypatch.setattr(edits, "KEPT", kept)
        for kinds in (2, 9, 500):
            for _ in range(40):
                a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(70))] for _ in range(2))
                assert edits.distance(a, b) == by_hand(a, b)


def test_selection_meets_no_group(spark):
    """Rows meet their brackets where they are, whatever Spark takes the brackets' size for."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = selection.select(df, ["k"], "v", selection.MIDDLE)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["k"], r["_low"], r["_high"]) for r in out.collect()) == [(0, 498.0, 501.0), (1, 499.0, 499.0), (2, 500.0, 500.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_rows_are_python_objects_at_once(spark):
    """A fold's rows become Python objects by slices of an Arrow batch; a controller's words come as texts."""
    from phonolith import plans
    from phonolith.streaming.runner import fold_batch

    class Alive:
        n = 0

        def step(self, row):
            import gc

            self.n += 1
            rows = sum(type(o) is dict and o.keys() == {"n", "words"} for o in gc.get_objects()) if self.n % 999 == 0 else 0
            return [{"alive": rows, "at": row["n"]}]

    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.array(F.lit("a"), F.lit("b")).alias("words"))
    got = fold_batch(df, "k", ["n"], Alive, "alive long, at long").collect()
    assert [r["at"] for r in got] == list(range(5000)) and 0 < max(r["alive"] for r in got) < 2000
    said = plans.folds.Spoken().step({"turn": 2, "base": 0, "end": 480_000, "words": ["One.", "two"], "silence_s": 0.0})
    assert [(r["settled"], r["preview"], r["cursor"]) for r in said] == [("One.", "two", 60 * 0.3 + 0.25)]
