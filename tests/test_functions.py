"""Known values of the scalar, text and array functions."""

import random
import re
import math

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from phonolith.functions import arrays as A, nested, scalar as N, signal, text as T
from phonolith.operators import stats
from phonolith.sources import datasets, vocabulary, wav
from phonolith.streaming import folds


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lits(*values):
    return F.array(*map(F.lit, values))


def test_text(spark):
    assert list(one(spark, T.normalize(F.lit("Hello,   World!")), T.similarity(F.lit("Hello world"), F.lit("hello, world!")), F.levenshtein(F.lit("kitten"), F.lit("sitting")))) == ["hello world", 1.0, 3]
    assert list(one(spark, T.similarity(F.lit(None).cast("string"), F.lit("")), T.reference_text(F.lit("A PARAGRAPH B NEWLINE C")))) == [1.0, "A\nB\nC"]
    assert one(spark, T.sentences(F.lit("One. Two!  Three")))[0] == ["One.", "Two!", "Three"]
    assert one(spark, T.decode_pieces(lits("▁hel", "lo", "▁", ".", "<eou>", "<blank>")))[0] == "hello."
    assert list(one(spark, T.csv_field(F.lit('a"b')), T.csv_field(F.lit(None)), T.csv_field(F.lit("x")))) == ['"a""b"', "", "x"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits(spark):
    many = [f"w{i}" for i in range(70_000)]  # beyond one private plane
    for a, b in ((["a", "b", "c"], ["a", "x", "c", "d"]), ([], []), ([], ["a"]), (["a"], []), (["é", "b"], ["b", "é", "é"])):
        d = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        assert d.select(T.word_edits(F.col("a"), F.col("b"))).first()[0] == edits(a, b)
    d = spark.createDataFrame([(many, many[1:5])], "a array<string>, b array<string>")
    assert d.select(T.word_edits(F.col("a"), F.col("b"))).first()[0] == len(many) - 4


def test_error_rates_of_whole_turns(spark):
    """The queries on word edits, counted by hand over the whole table."""
    from conftest import DATA
    from phonolith import plans

    norm = lambda t: " ".join(re.sub(r"[^a-z0-9\s]", " ", (t or "").lower()).split())
    rows = {(r["conv_id"], r["turn"]): (norm(r["text"]), r["role"]) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    pairs = {k: (rows[k][0].split(), rows[k[0], k[1] + 1][0].split(), rows[k][1]) for k in rows if (k[0], k[1] + 1) in rows}
    got = {(r["conv_id"], r["turn"]): r["edits"] for r in plans.QUERIES["r121_word_edits_any"](spark, DATA).collect()}
    want = {k: edits(a, b) for k, (a, b, _) in pairs.items()}
    assert got == want
    wer = {(r["conv_id"], r["turn"]): r["wer"] for r in plans.QUERIES["r121_cer_wer"](spark, DATA).collect()}
    assert all(abs(wer[k] - (want[k] / len(a) if a else 0)) < 1e-9 for k, (a, _, _) in pairs.items())
    for r in plans.QUERIES["r122_corpus_error_rates"](spark, DATA).collect():
        own = [k for k in pairs if pairs[k][2] == r["role"]]
        assert abs(r["corpus_wer"] - sum(want[k] for k in own) / sum(len(pairs[k][0]) for k in own)) < 1e-9


def test_sample_of_a_wide_table(spark):
    """Every drawn offset is found once, over many partitions."""
    d = spark.range(100_000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 512).alias("wide")).repartition(7)
    got = datasets.sample(d, "k", 300, "fixed-seed").orderBy("ord").collect()
    drawn = datasets.offsets(100_000, 300, "fixed-seed")
    assert len(got) == 300 and [r["k"] for r in got] == [drawn[i] for i in sorted(range(300), key=lambda i: (drawn[i] // datasets.PAGE, i))]


URLS = {'{"src": "a"}': "a", '[{"path": "b"}]': "b", '"c"': "c", "d": "d", '{"x": 1}': None, "": None, None: None, '[[{"src":"a"}]]': "a", '{"src":{"url":"a"}}': "a", '[null, 0, [], {}, [[["z"]]]]': "z", '{"src": null, "url": "u", "path": "p"}': "u", '["", "e"]': "e", "[1, 2": None, '{"url": "q\\"]["}': 'q"][', "[[[[[[[[[[]]]]]]]]]]": None}
KEYS = {'{"b":1,"a":{"d":[{"z":1,"y":2}],"c":null}}': '{"a":{"c":null,"d":[{"y":2,"z":1}]},"b":1}', "[3,1,2]": "[3,1,2]", '{"10":1,"9":2,"-1":3,"01":4}': '{"9":2,"10":1,"-1":3,"01":4}', "1.50": "1.5", "1e3": "1000", "1e21": "1e+21", "1.5e-7": "1.5e-7", "0.000001": "0.000001", "123456789012345680000": "123456789012345680000", "-0.0": "0", "-2.5e30": "-2.5e+30", '"x\\n"': '"x\\n"', "{": None, None: None, '{"a":{}}': '{"a":{}}', '{"𐀀":1,"\uffee":2}': '{"𐀀":1,"\uffee":2}', "true": "true"}


def test_nested_values(spark):
    """Nested JSON, walked as deep as it goes."""
    for table, f in ((URLS, nested.audio_url), (KEYS, nested.canonical)):
        df = spark.createDataFrame([(k, v) for k, v in table.items()], "json string, want string")
        rows = df.select("json", "want", f(F.col("json"), nested.deepest(df, F.col("json"))).alias("got")).collect()
        assert {r["json"]: r["got"] for r in rows} == table
    df = spark.createDataFrame([("[" * 40 + "]" * 40,)], "json string")
    with pytest.raises(nested.TooDeep):
        nested.deepest(df, F.col("json"))
    with pytest.raises(Exception, match="deeper"):
        df.select(nested.audio_url(F.col("json"), 3)).collect()


def test_audio_key(spark):
    """Against plain integers; samples beyond the range and those that aren't finite; edges and a strided middle."""

    def by_hand(x, whole=1_000_000, edge=1024, points=131_072):
        n, rot = len(x), lambda v, b: (v << b | v >> 32 - b) & 0xFFFFFFFF
        at = range(n) if n <= whole else [*range(edge), *range(edge, n - edge, max(1, (n - 2 * edge) // (points - 2 * edge))), *range(n - edge, n)]
        s = n
        for i in at:
            v = x[i] if x[i] is not None and math.isfinite(x[i]) else 0
            k = max(-32768, min(32767, math.floor(v * 32768 + 0.5))) & 0xFFFF
            s = (rot(s ^ rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        s = (s ^ s >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        s = (s ^ s >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return f"{n}_{s ^ s >> 16}" if n else "0_0"

    rows = [[], [0.5], [-1.0, 1.0, 2.0, -3.0], [float("nan"), float("inf"), None, 0.25], [math.sin(i) for i in range(3000)]]
    df = spark.createDataFrame([(x,) for x in rows], "x array<double>")
    for s in ({}, {"whole": 3, "edge": 1, "points": 8}, {"whole": 2000, "edge": 64, "points": 500}):
        fit = [x for x in rows if not (s and s["whole"] < len(x) < 2 * s["edge"])]
        got = [r[0] for r in df.select(signal.audio_key(F.col("x"), **s)).collect()]
        assert [g for g, x in zip(got, rows) if x in fit or x is rows[3]] == [by_hand(x, **s) for x in rows if x in fit or x is rows[3]]
    assert one(spark, T.fnv1a(F.lit("")), T.fnv1a(F.lit("a")), T.fnv1a(F.lit("foobar")))[:] == (None, 0xE40C292C, 0xBF9CF968)


def test_draws(spark):
    for seed in (0, 1, 0x9E3779B9, 0xFFFFFFFF):
        draw = datasets.random_numbers(seed)
        assert one(spark, T.draws(F.lit(seed).cast("long"), 20))[0] == [next(draw) for _ in range(20)]


def test_onset_by_its_rule(spark):
    """From the newest candidate walk back; a rise moves the onset; stop past the look-back or near the noise floor."""
    rng = random.Random(8)
    for _ in range(3000):
        gate = folds.RoughGate(snr_db=rng.choice([None, 6.0]), least_snr_db=rng.choice([3.0, 6.0]))
        rows = [(i * 1280, rng.choice([0.1, 0.105, 0.11, 0.2, 0.4]), rng.uniform(-1, 12)) for i in range(rng.randrange(1, 25))]
        gate.history.extend(rows)
        at = newest = len(rows) - 1
        want = None
        while at > 0:
            at -= 1
            if rows[at + 1][1] > rows[at][1] * 1.08:
                want = at
            if newest - at > 6 or gate.snr_db and rows[at][2] < gate.least_snr_db / 2:
                break
        if want is None and gate.snr_db:
            below = [i for i, r in enumerate(rows) if r[2] < gate.least_snr_db]
            want = min(newest, below[-1] + 1) if below else None
        assert gate.onset() == 1280 * (max(0, newest - 4) if want is None else want)


def test_numbers(spark):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    assert list(one(spark, N.round_half_up(F.lit(-2.5), 0), N.safe_number(F.lit("")), N.safe_number(F.lit("x")), N.safe_number(F.lit("1e999")), N.clamp_unit(inf), N.clamp_unit(nan), N.clamp_unit(F.lit(2.0)))) == [-2.0, 0.0, None, None, 0.0, 0.0, 1.0]
    assert list(one(spark, N.rtfx(F.lit(10.0), F.lit(2000.0)), N.rtfx(F.lit(0.0), F.lit(5.0)), N.dbfs(F.lit(0.0)), N.dbfs(F.lit(1.0)), N.chunk_frames(F.lit(-1.0)), N.chunk_frames(F.lit(16000.0)))) == [5.0, None, -100.0, 0.0, 256, 256]
    for window, steps, done in ((80, 73, 5840), (60, 100, 6000), (90, 65, 5850)):
        got = one(spark, *N.overlap_cost(F.lit(5400.0), F.lit(float(window)), F.lit(6.0)))
        assert got[:2] == (steps, done) and math.isclose(got[2], (done - 5400) / 5400)


def test_summary(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 6)] + [("b", 7.0), ("c", float("nan"))], "k string, v double")
    got = {r["k"]: r for r in stats.summary(df, ["k"], "v").collect()}
    assert (got["a"]["mean"], got["a"]["median"], got["a"]["p90"], got["b"]["stddev"]) == (3.0, 3.0, 5.0, 0.0)
    assert got["c"]["count"] == 0 and got["c"]["stddev"] is None


def test_arrays(spark):
    x = lits(*[float(v) for v in range(8)])
    assert one(spark, A.argmax(lits(1.0, 5.0, 5.0)), A.argmax(lits(float("nan"), 2.0)))[:] == (1, 1)
    assert one(spark, F.size(A.frames(F.array().cast("array<double>"), 4, 2)))[0] == 0
    assert [(f["start"], len(f["samples"]), f["is_last"]) for f in one(spark, A.frames(x, 4, 3))[0]] == [(0, 4, False), (3, 4, False), (6, 2, True)]
    assert one(spark, A.evenly(lits(*[i / 7 * 1.75 for i in range(8)]), 5))[0][0] == 0
    assert one(spark, A.deinterleave(lits(1, 2, 3, 4, 5), 2))[0] == [[1.0, 3.0], [2.0, 4.0]]
    assert one(spark, A.slice_frames(x, F.lit(1.5), F.lit(3.2)), A.slice_frames(x, F.lit(9), F.lit(12)))[:] == ([1.0, 2.0, 3.0], [])
    with pytest.raises(ValueError, match="overlap"):
        signal.chunks(x, 4, 4)


def test_mel(spark):
    t = np.arange(16000) / 16000
    rows, valid = signal.mel_frames(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert rows.shape == (101, 80) and valid == 100 and np.isfinite(rows).all()
    bank = signal.mel_filterbank(16000, 512, 80)
    assert abs(int(rows[50].argmax()) - int(bank[:, round(440 * 512 / 16000)].argmax())) <= 1
    kaldi, n = signal.mel_frames(np.zeros(100, np.float32), style="kaldi")
    assert kaldi.shape == (0, 80) and n == 0


def test_wav():
    x = np.array([0, 0.5, -0.5, 1.5, -1.5], np.float32)
    rate, got = wav.parse(wav.build(x, 8000))
    assert rate == 8000 and np.allclose(got, np.clip(x, -1, 1), atol=1e-4)
    with pytest.raises(ValueError, match="WAV"):
        wav.parse(b"nothing")


def test_wav_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.build(np.zeros(4), 16000))
    (tmp_path / "a.json").write_text('{"transcription": "hm"}')
    (tmp_path / "b.wav").write_bytes(wav.build(np.zeros(2), 16000))
    rows = wav.read_labelled(spark, str(tmp_path)).collect()
    assert [(r["key"], r["transcription"], len(r["samples"])) for r in rows] == [("a.wav", "hm", 4)]


def test_sampling(spark):
    assert datasets.seed_number("") is None and datasets.seed_number("fixed-seed") == datasets.seed_number("fixed-seed")
    drawn = datasets.offsets(300, 40, "fixed-seed")
    assert len(set(drawn)) == 40 and all(0 <= o < 300 for o in drawn)
    got = datasets.sample(spark.range(300).withColumnRenamed("id", "k"), "k", 40, "fixed-seed").orderBy("ord").collect()
    assert [r["k"] for r in got] == [drawn[i] for i in sorted(range(40), key=lambda i: (drawn[i] // 100, i))]


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text("<blank> 0\n▁the 1\ns 5\n")
    assert [(r["id"], r["piece"]) for r in vocabulary.read(spark, str(tmp_path / "v.txt")).collect()] == [(0, "<blank>"), (1, "▁the"), (5, "s")]


def test_keep_last(spark):
    df = spark.createDataFrame([Row(k=1, v="a", o=1), Row(k=1, v="b", o=2)])
    assert stats.keep_last(df, ["k"], "o").select("v").collect() == [Row(v="b")]


def test_audio_key(spark):
    """Equal 16-bit audio has an equal key; a differing sample anywhere, a length or the order of samples shows."""
    long = [((i * 37) % 200 - 100) / 128 for i in range(5000)]
    audio = [long, [x + 1e-7 for x in long], long[:2500] + [0.9] + long[2501:], long[:-1], long[::-1], [2.0, -3.0], [1.0, -1.0], []]
    rows = spark.createDataFrame(list(enumerate(audio)), "i int, x array<double>").select("i", signal.audio_key(F.col("x")).alias("key"))
    key = {r["i"]: r["key"] for r in rows.collect()}
    assert key[0] == key[1] and key[5] == key[6] and len({key[i] for i in (0, 2, 3, 4, 5, 7)}) == 6
