"""SimHash and vector near-dedup against brute force; connected components; skewed joins."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA
from helpers import awkward, clashing, documents
from pyspark.sql import functions as F

from phonolith.llm import queries, simhash, vectors
from phonolith.llm.common import Tables, components, heavy_join

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(near):
    """Smallest index that each row reaches."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        low = np.where(near, label[None, :], len(near)).min(1)
        if (low == label).all():
            return label
        label = low


def by_brute_force(docs):
    prints = np.array([print_of(t) for _, t in docs], np.uint64)
    group = labels(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    low = {}
    for (key, _), g in zip(docs, group):
        low[g] = min((k for k in (low.get(g), key) if k is not None), default=None)
    return Counter((key, f"{p:016x}", low[g]) for (key, _), p, g in zip(docs, prints, group))


def test_simhash(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op10_simhash(spark, DATA).collect())) == by_brute_force(docs)


def test_simhash_awkward(spark):
    docs = awkward(spark)
    got = simhash.dedup(clashing(docs)).select("doc_id", simhash.hexed(F.col("fp")), "component_id").collect()
    assert Counter(map(tuple, got)) == by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert simhash.dedup(docs.filter("false")).collect() == []


def test_keep_one(spark):
    docs = awkward(spark)
    groups = by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    rows = kept.collect()
    assert len(rows) == len({p for _, p, _ in groups}) and simhash.keep_one(docs.filter("false")).collect() == []
    assert {r["doc_id"] for r in rows} >= {1, 4, 5, 8}  # 1: nulls and blanks, with the row that has no id


def hard_prints(n=900, seed=3):
    """Distinct fingerprints: balls around few centres, so that links and top nodes are dense."""
    rng, out = random.Random(seed), set()
    centres = [rng.getrandbits(64) for _ in range(6)]
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.choice(range(0, 64, 3))
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("leafy", [4, 64, 4096])
def test_links_are_whole(spark, leafy):
    prints = np.array(hard_prints(), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    tables = Tables(spark, "test")
    roots = {r["id"]: r["root"] for r in components(spark, simhash.links(df, tables, leafy=leafy), tables).collect()}
    want = labels(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    got = [roots.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(got)) == len(set(want)) and len({*zip(got, want.tolist())}) == len(set(want))


def test_linked_locally():
    gray = lambda x: x ^ x >> 1
    prints = np.array(sorted({gray(i * 37 % 5000) for i in range(2000)}, key=lambda f: [f, f ^ f >> 1]), np.uint64)
    want = labels(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    assert (simhash.linked(prints, 2) == want).all() and (simhash.linked(prints[:1], 2) == [0]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 80)] + [(500, 501), (501, 500), (7, 7)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(chain, "a long, b long"), Tables(spark, "test")).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 80)} == {1} and got[501] == 500


def test_heavy_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b", "c", None, "z"])], "k string, v int")
    right = spark.createDataFrame([("a", 1, 50), ("b", 2, 1), (None, 3, 1), ("c", 4, 1)], "k string, x int, w int")
    got = Counter((r["k"], r["x"]) for r in heavy_join(left, right, "k", "w", heavy=1).collect())
    assert got == Counter({("a", 1): 50, ("b", 2): 1, ("c", 4): 1, (None, 3): 1, ("z", None): 1})


def cosine_links(rows):
    sound = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = np.zeros((len(rows), len(rows)), bool)
    for i in sound:
        for j in sound:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                near[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    return near


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, key = [], 0
    for size, noise in ((150, 0.01), (40, 0.1), (1, 0), (3, 0.2), (60, 0.0)):
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((key, [float(np.float32(x)) for x in centre + noise * rng.standard_normal(16)]))
            key += 1
    rows += [(1000 + i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(100)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] * 16), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, [3.0, 6.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = vectors.dedup(df, vectors.Settings(window=8, block=32)).collect()
    near = cosine_links(rows)
    found, true = sum(r["n_links"] for r in got), near.sum()
    assert 0.9 * true <= found <= true  # recall, and no false links
    by = {r["vec_id"]: r for r in got}
    assert all(by[k]["n_links"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in range(2000, 2006))
    assert by[2007]["component_id"] == 2006 and by[2007]["n_links"] == 2 and not by[2007]["kept"] and by[None]["component_id"] == 2006
    assert [by[i]["component_id"] for i in range(150)] == [0] * 150 and [by[i]["n_links"] for i in range(150)] == near[:150].sum(1).tolist()
    assert vectors.dedup(df.filter("false")).collect() == []


def test_query(spark):
    """The query on its whole table against brute force."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = {r["vec_id"]: r for r in queries.op7_vectors(spark, DATA).collect()}
    near = cosine_links(rows)
    group = labels(near)
    found, true = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert len(got) == len(rows) and 0.9 * true <= found <= true
    low = {}
    for (key, _), g in zip(rows, group):
        low[g] = min(low.get(g, key), key)
    same = sum(got[key]["component_id"] == low[g] for (key, _), g in zip(rows, group))
    assert same >= 0.9 * len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_repeated_ids_and_long_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(5000).tolist()
    rows = [(1, v), (1, v), (1, (rng.standard_normal(5000)).tolist()), (2, v), (None, v)]
    got = vectors.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter({(1, 3, 1): 2, (1, 0, 1): 1, (2, 3, 1): 1, (None, 3, 1): 1})


def test_passes_grow_with_the_table():
    s = vectors.Settings()
    n = [vectors.passes(10**k, s) for k in range(0, 13)]
    assert n == sorted(n) and n[0] == s.least and n[-1] < 1000


@pytest.mark.parametrize("block, zone", [(32, 1), (64, 8), (1024, 8)])
def test_counts_of_large_groups(spark, block, zone):
    """Every vector of groups that outgrow their windows has its exact count, whether angles settle its pairs or not."""
    rng = np.random.default_rng(13)
    groups = []
    for size, noise in ((220, 0.02), (220, 0.31), (180, 0.25), (30, 0.28)):
        centre = rng.standard_normal(24)
        groups.append(centre / np.linalg.norm(centre) * 5 + 5 * noise * rng.standard_normal((size, 24)) / 24**0.5)
    fan = np.linspace(0, 3.1, 240)  # a chain of links around half a circle
    groups.append(np.concatenate([np.stack([np.cos(fan), np.sin(fan)], 1), np.zeros((240, 22))], 1))
    v = np.concatenate(groups).astype(np.float32).astype(float)
    v = np.concatenate([v, v[:7]])
    s = vectors.Settings(window=4, block=block, zone=zone)
    got = {r["vec_id"]: r for r in vectors.dedup(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>"), s).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    true = near.sum(1) - 1
    assert [got[i]["component_id"] for i in range(len(v))] == labels(near).tolist()
    n = np.array([got[i]["n_links"] for i in range(len(v))])
    whole = np.arange(len(v)) // 220 != 1  # groups of pairs well above the threshold: every window is full
    assert (n <= true).all() and n.sum() >= 0.95 * true.sum() and (n[:220] == true[:220]).all() and (n[650:890] == true[650:890]).all()
    assert (n == true)[whole].mean() > 0.9


def test_needed_pairs_connect():
    rng = np.random.default_rng(2)
    for density in (0.2, 0.6, 1):
        i, j = np.nonzero(np.triu(rng.random((60, 60)) < density, 1) & ~np.triu(np.ones((60, 60), bool), 9))
        a, b, full = vectors._needed(i, j, j - i == 8)
        whole, kept = np.zeros((60, 60), bool), np.zeros((60, 60), bool)
        whole[i, j] = whole[j, i] = kept[a, b] = kept[b, a] = True
        ends = {*i[j - i == 8], *j[j - i == 8]}
        assert (labels(whole) == labels(kept)).all() and ends <= {*a[full], *b[full]}
        assert all(kept[x].sum() == whole[x].sum() for x in range(60) if x not in ends)
    assert len(a) < len(i) / 4


def test_one_bad_component(spark):
    """A single null or NaN component keeps a vector out of all links."""
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [1.0, None, 3.0]), (3, [1.0, float("nan"), 3.0]), (4, [1.0, 2.0, float("-inf")]), (5, v)]
    got = vectors.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(1, 1, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 1)}


def test_recall(spark):
    """Against brute force on vectors near the threshold."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.standard_normal((400, 64))
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rng.uniform(0.9, 0.97, 400)[:, None]
    both = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * other]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(both.astype(float).tolist())], "vec_id long, embedding array<float>")
    unit = both.astype(float) / np.linalg.norm(both.astype(float), axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum() - len(unit)
    found = sum(r["n_links"] for r in vectors.dedup(df).collect())
    assert 0.9 * true <= found <= true
