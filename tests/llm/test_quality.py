"""Base quality rules against plain Python; held-out accuracy of the classifier."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA
from helpers import awkward, clashing, documents

from phonolith.llm import quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(runs)
    covered = {j for i, r in enumerate(runs) if seen[r] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {}
    for key, text in docs:
        n = plain(text)
        want[key] = (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])
    rows = queries.op6_quality(spark, DATA).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows} == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_repeats():
    assert quality.repeated(b"a a a a a a".split(), 5) == 6 and quality.repeated(b"a b c d e".split(), 5) == 0
    text = b"a b c d e f a b c d e"
    assert quality.repeated(text.split(), 5) == 10 == plain(text.decode())[4]


def test_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(clashing(docs), labels).collect()
    assert Counter((r["doc_id"], *[r[c] for c in quality.STATS]) for r in got) == Counter((r["doc_id"], *plain(r["text"])) for r in docs.collect())
    assert quality.judge(docs.filter("false"), labels).collect() == []
    kept = quality.keep(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and {r["kept"] for r in kept.collect()} <= {"clash"}
    one_class = quality.judge(docs, labels.filter("quality = 1")).filter("kept").collect()
    assert {r["doc_id"] for r in one_class} == set() or all(r["n_words"] >= 10 for r in one_class)


def test_held_out_accuracy(spark):
    """Junk against prose, on rows that training didn't see."""
    rng = np.random.default_rng(2)
    syllables = ["the", "an", "tion", "er", "of", "re", "in", "st", "ed", "or"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    prose = [" ".join(word() for _ in range(60)).capitalize() + "." for _ in range(220)]
    junk = [" ".join(word() + rng.choice(["###", "%%%", "&&&", "$$$"]) for _ in range(60)) for _ in range(220)]
    docs = documents(spark, enumerate(x for pair in zip(prose, junk) for x in pair))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["kept"], r["p_good"]) for r in quality.judge(docs, labels).collect()}
    held = [i for i in range(240, 440)]
    assert sum(got[i][0] == (i % 2 == 0) for i in held) >= 0.97 * len(held)
    sure = [got[i][1] for i in held if i % 2 == 0]
    assert np.mean(sure) > 0.85  # calibrated: sure where it is right


def test_platt():
    margin = np.array([-2.0, -1.0, -0.5, 0.5, 1.0, 2.0] * 20)
    good = (margin > 0).astype(float)
    scale, shift = quality.platt(margin, good)
    assert scale > 0 and abs(shift) < 1


def test_features_ignore_position():
    of = lambda t: np.concatenate([np.empty(0, np.int32), *quality.features(t, 1 << 15)])
    assert len(of(b"")) == 0 and np.isin(of(b"alpha"), of(b"x alpha beta y")).all() and len(of(b"alpha beta")) < len(of(b"x alpha beta y"))


def plain_buckets(text, bits=15):
    """Buckets of words, word pairs and character n-grams, one by one."""
    prime, mask = 0x100000001B3, (1 << 64) - 1
    fold = lambda h, salt: (h + salt) * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - bits
    out = Counter()
    for n, salt in ((3, 1), (4, 2)):
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * prime + ord(c)) & mask
            out[fold(h, salt)] += 1
    words = []
    for w in WORD.findall(text):
        words.append((sum((ord(c) + 1) * pow(prime, i & 4095, 1 << 64) for i, c in enumerate(w)) + len(w)) & mask)
    out.update(fold(w, 3) for w in words)
    out.update(fold((a * 31 + b) & mask, 4) for a, b in zip(words, words[1:]))
    return out


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 18])
def test_features_whatever_the_step(step):
    texts = ["", "ab", "abc", "día de ñandú 😀 x", " lead  and\ttrail ", "word " * 300 + "é" * 500 + " end", "日本語 の テキスト です"]
    for t in texts:
        got = Counter(np.concatenate([np.empty(0, np.int32), *quality.features(t.encode(), 1 << 15, step)]).tolist())
        assert got == plain_buckets(t)


def test_text_longer_than_a_step():
    text = "alpha beta gamma " * 40000 + "é" * 300000 + " tail"
    count = lambda step: Counter(np.concatenate(list(quality.features(text.encode(), 1 << 15, step))).tolist())
    assert count(1 << 18) == count(1 << 22)


def test_verdicts_against_plain_training(spark):
    """The method's verdicts, from features, fit and calibration written anew over dense rows."""
    s = quality.Settings(buckets=1 << 12, epochs=25)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r["doc_id"]: (r["text"] or "")[:1500] for r in docs.collect()}
    docs = documents(spark, texts.items())
    label = {}
    for r in labels.collect():
        if r["quality"] is not None and r["doc_id"] in texts:
            label[r["doc_id"]] = min(label.get(r["doc_id"], 9), r["quality"])
    signed = lambda i: xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) - (1 << 64) * (xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) >> 63)
    ids = sorted(label, key=lambda i: (signed(i), i))
    dense = {}
    for i, t in texts.items():
        x = np.zeros(s.buckets)
        for k, n in plain_buckets(t, 12).items():
            x[k] = n
        dense[i] = x / max(1, x.sum()) * 1000
    x, y = np.array([dense[i] for i in ids]), np.array([float(label[i] > 0) for i in ids])
    fit = np.array([k % 4 != 0 for k in range(len(ids))])
    weigh = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b, past = np.zeros(s.buckets), 0.0, np.full(s.buckets, 1e-6)
    for _ in range(s.epochs):
        error = fit * weigh * (1 / (1 + np.exp(-(x @ w + b))) - y)
        grad = x.T @ error + s.ridge * w
        past += grad**2
        w, b = w - s.rate / 10 * grad / np.sqrt(past), b - s.rate * error.sum()
    scale, shift = quality.platt((x @ w)[~fit], y[~fit]) if len(set(y[~fit])) == 2 else (1.0, b)
    got = {r["doc_id"]: r for r in quality.judge(docs, labels, s).collect()}
    for i in texts:
        if not got[i]["base_failed"]:
            p = 1 / (1 + np.exp(-(scale * (dense[i] @ w) + shift)))
            assert abs(got[i]["p_good"] - p) < 0.01 and (abs(p - 0.5) < 0.01 or got[i]["kept"] == (p >= 0.5))
