"""Operators 11 to 13 against SQL on the supplied tables and against plain Python on awkward ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, clashing
from pyspark.sql import functions as F

from phonolith.llm import exact, negatives, queries, repair, sql
from phonolith.llm.common import Tables


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_hard_negatives", "op13_conversation_repair"])
def test_agrees_with_sql(name, same):
    same(queries.queries()[name], sql.ORACLES[name])


# --- exact dedup


def exact_by_hand(rows):
    groups = defaultdict(list)
    for at, (key, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append((key is None, key or 0, at, key))
    out = []
    for text, members in groups.items():
        first = min(members)
        out += [(m[3], first[3], len(members), m is first, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return Counter(out)


@pytest.mark.parametrize("s", [exact.Settings(), exact.Settings(most=0), exact.Settings(bits=1)])
def test_exact_awkward(spark, s):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = exact.mark(clashing(docs), s)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == exact_by_hand(rows)
    kept = exact.keep(clashing(docs), s)
    assert kept.columns == clashing(docs).columns
    want = Counter(k for k, _, _, stays, _ in exact_by_hand(rows).elements() if stays)
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert exact.mark(docs.filter("false"), s).collect() == [] and exact.keep(docs.filter("false"), s).collect() == []


def test_exact_hot_group(spark):
    """A third of all rows are equal but for white space; one row stays, and rows without an equal pass the filter by."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a \t"), F.repeat(F.lit("\n"), (F.col("id") % 7).cast("int")), F.lit("b"))).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.mark(docs).collect()
    assert sum(r["kept"] for r in got) == 2001 and {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] % 3 == 0} == {(0, 1000)}
    s = exact.Settings()
    rows = docs.select("doc_id", exact.digest(F.col("text")).alias("sha"))
    words = exact.words_for(3000, s)
    tested = exact.possible(rows, "sha", words, exact.repeated_bits(rows, "sha", words, s, Tables(spark, "t")), s)
    again = {r["doc_id"] for r in tested.filter("_again").collect()}
    assert again >= set(range(0, 3000, 3)) and len(again) < 1200


# --- hard negatives


def negatives_by_hand(rows, s=negatives.Settings()):
    """rows: (id, label, list of whole numbers)."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for at, (anchor, label, a) in enumerate(rows):
        if anchor % 100:
            continue
        others = [(-score(a, v), key, x, mark == label) for x, (key, mark, v) in enumerate(rows) if x != at and len(v) == len(a)]
        for p, positive, _, _ in sorted(o for o in others if o[3])[: s.positives]:
            fits = sorted(o for o in others if not o[3] and 30 * -p <= 100 * -o[0] <= 90 * -p)
            out += [(anchor, positive, rank + 1, key, -p, -n) for rank, (n, key, _, _) in enumerate(fits[: s.negatives])]
    return Counter(out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def whole(rows):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    return [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows if i is not None and label is not None and ok(v)]


@pytest.mark.parametrize("s", [negatives.Settings(), negatives.Settings(anchors=2, rows=64, pairs=16, sparse=1), negatives.Settings(sparse=1 << 30)])
def test_negatives_awkward(spark, s):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(6)], rng.randrange(3)) for i in range(300)]
    rows += [(i, rows[0][1], rng.randrange(3)) for i in range(300, 420)]  # copies: ties
    rows += [(500 + i, [rng.gauss(0, 30) for _ in range(3)], i % 2) for i in range(60)]  # another length
    rows += [(100, rows[100][1], rows[100][2])] * 2 + [(200, rows[7][1], 1)]  # repeated rows, a repeated key
    rows += [(700, [0.0] * 6, 0), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (900, [float("nan")] * 6, 1), (1000, [float("inf")] * 6, 2), (1100, None, 1), (1200, [1.0] * 6, None), (None, [1.0] * 6, 1), (1300, [], 1), (1400, [], 2), (1500, [3.0e5, -2.0e5], 0), (1501, [2.9e5, 1.0e5], 0), (1502, [1.0e5, 1.0e3], 1)]
    df = vectors_of(spark, rows).withColumns({c: F.lit("clash") for c in ("rid", "id", "vec", "anchor", "score", "k", "a", "c")})
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, s)
    assert Counter(map(tuple, got.collect())) == negatives_by_hand(whole(rows))
    assert negatives.mine(df.filter("false"), F.col("vec_id") % 100 == 0, s).collect() == []
    assert negatives.mine(df, F.lit(False), s).collect() == []


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for most in (1, 200, 1 << 14, 1 << 24):
        a, v = rng.integers(-most, most + 1, (9, 5)), rng.integers(-most, most + 1, (300, 5))
        score = a @ v.T
        low, high = np.quantile(score, 0.6, 1).astype(np.int64), np.quantile(score, 0.8, 1).astype(np.int64)
        for sparse in (1, 32, 1 << 30):
            i, j, x = negatives.within(a, v, low, high, negatives.Settings(sparse=sparse))
            assert set(zip(i, j)) == set(zip(*np.nonzero((score >= low[:, None]) & (score <= high[:, None])))) and (score[i, j] == x).all()


# --- conversation repair


def damaged(rows):
    out = []
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(turns):
    """Counts, cost, audit and digest of one conversation by search over all edits of each prefix."""
    turns = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2].encode(), hashlib.sha256(t[3].encode()).digest()))
    counts, seen, faults = Counter(), set(), []
    for _, _, role, text in turns:
        bare = re.sub("[\x20\x09-\x0d]+", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    numbers = [t[1] for t in turns if t[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def relax(states, state, role, cost, letter, line):
        for now, (c, audit, lines) in list(state.items()):
            if (now, role) in go:
                new, to = (c + cost, audit + letter, lines + (line,)), go[now, role]
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new

    def inserts(states):
        for _ in range(3):
            for role, name in (("u", "user"), ("a", "assistant")):
                relax(states, states, role, 5, "I", f"{name}:")

    inserts(best)
    for (_, _, role, text), fault in zip(turns, faults):
        after = {s: (c + 2, audit + "D", lines) for s, (c, audit, lines) in best.items()}
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            relax(after, best, role[:1], more, "K", f"{role}:{text}")
            for r, name in (("u", "user"), ("a", "assistant")):
                relax(after, best, r, more + 1, "R", f"{name}:{text}")
        inserts(after)
        best = after
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha


def repaired_by_hand(rows, every):
    groups = {c: [] for c in every}
    for r in rows:
        groups[r[0]].append(r)
    return Counter((c, *repaired(g)) for c, g in groups.items())


TURN = "conv_id long, turn long, role string, text string"


def conversation_rows(seed=2):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "assistant", "user", "tool", "", None], ["Yes.", "No!", "and then", "", " \t", "Why? \n", None, "é."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(9))]
    rows += [(None, t, "user", f"{t}.") for t in (None, 3, 3, 9)] + [(200, None, "user", "x.")] + [(201, 4, "user", "a."), (201, 4, "assistant", "b."), (201, 4, "user", "a.")]
    return rows + [(202, 1, "user", "a. " * 100000), (203, 10**18, "user", "a."), (203, -(10**18), "assistant", "b.")]


def test_repair_awkward(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, TURN).withColumns({c: F.lit("clash") for c in ("conv", "rid", "rep", "pos", "range", "sub", "best", "parts")})
    got = repair.repair(repair.damage(df), df.select(F.col("conv_id").alias("conv"))).collect()
    assert Counter(map(tuple, got)) == repaired_by_hand(damaged(rows), {r[0] for r in rows})
    assert repair.repair(repair.damage(df.filter("false")), df.filter("false").select(F.col("conv_id").alias("conv"))).collect() == []


def test_repair_in_chunks(spark, monkeypatch):
    """Small chunks: conversations, and runs of one turn number, that span many of them."""
    monkeypatch.setattr(repair, "CHUNK", 3)
    rng = random.Random(4)
    rows = conversation_rows(6) + [(300, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!", f"{t}?"])) for t in range(200)]
    rows += [(301, 7, rng.choice(["user", "assistant"]), f"{t}.") for t in range(40)] + [(302, None, "assistant", f"{t % 5}.") for t in range(20)]
    df = spark.createDataFrame(rows, TURN)
    got = repair.repair(repair.damage(df), df.select(F.col("conv_id").alias("conv"))).collect()
    assert Counter(map(tuple, got)) == repaired_by_hand(damaged(rows), {r[0] for r in rows})


def test_repairs_are_cheapest():
    """The search by states against all edits of up to four turns with up to two inserts a gap."""
    roles = {"s": "system", "u": "user", "a": "assistant"}
    for turns in itertools.product("sua", repeat=3):
        rows = [(1, i, roles[r], f"{i}.") for i, r in enumerate(turns)]
        found = []
        for letters in itertools.product("DKua", repeat=3):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=4):
                out, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * sum(map(len, gaps))
                for x, r, gap in zip(letters, turns, gaps[1:]):
                    out += ("" if x == "D" else r if x == "K" else x) + gap
                    audit += ("R" if x in "ua" else x) + "I" * len(gap)
                    cost += {"D": 2, "K": 0}.get(x, 1)
                if re.fullmatch("(s?(ua)+)?", out):
                    found.append((cost, audit))
        assert min(found) == repaired(rows)[5:7]
