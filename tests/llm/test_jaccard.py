"""The pipeline's near-dedup stage against brute force over whole shingle sets."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import DATA
from helpers import awkward, clashing, documents
from pyspark.sql import Window, functions as F
from test_dedup import UPPER, labels

from phonolith.llm import jaccard


def shingled(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    sets = [shingled(t) for t in texts]
    near = np.array([[a == b or 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    return labels(near).tolist(), near


def kept_by_brute_force(docs):
    low = {}
    for (key, _), g in zip(docs, groups([t for _, t in docs])[0]):
        low[g] = min(low.get(g, key), key)
    return sorted(low.values())


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(9999)) if rng.random() < share else w for w in words)


def planted(seed=5, n=40):
    """Texts of 60 to 900 words, each with copies in which up to a twentieth of the words are others."""
    rng, docs = random.Random(seed), []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 900))]
        docs += [(len(docs) + k, edited(rng, words, share)) for k, share in enumerate((0, 0.005, 0.01, 0.02, 0.03, 0.05))]
    return docs


def test_planted_copies(spark):
    docs = planted()
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, docs), DATA).collect())
    assert kept == kept_by_brute_force(docs) and len(kept) < len(docs) - 80


@pytest.mark.parametrize("block", [1, 7, 512])
def test_every_pair_of_a_bucket_once(spark, block):
    """Blocks meet so that each pair comes once, in the first bucket that both share."""
    bands = {i: [i % 2, 10 + i % 3, 20] for i in range(40)}
    rows = [(v, i, 1, i, [0], b) for i, b in bands.items() for v in b]
    df = spark.createDataFrame(rows, "value long, rid long, n long, c long, sketch array<long>, bands array<long>")
    df = df.withColumn("m", F.count("*").over(Window.partitionBy("value")))
    got = Counter((r["rid"], r["o"], r["value"]) for r in jaccard._met_all(df, jaccard.Settings(block=block)).collect())
    assert got == Counter((i, j, next(x for x, y in zip(bands[i], bands[j]) if x == y)) for i in bands for j in bands if i > j)
    hubs = jaccard._met_hubs(df, 1).collect()
    assert len(hubs) == len(rows) and len({(r["value"], r["o"]) for r in hubs}) == 6 and all(r["value"] in bands[r["o"]] for r in hubs)


@pytest.mark.parametrize("block", [16, 512])
def test_large_group(spark, block):
    """Copies of one text that are not all similar to each other; hubs alone would leave components apart."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, edited(rng, words, 0.025)) for i in range(150)]
    _, near = groups([t for _, t in docs])
    assert not near.all()
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(documents(spark, docs), jaccard.Settings(hubs=1, block=block)).collect())
    assert kept == kept_by_brute_force(docs)


def test_supplied(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect())
    assert kept == kept_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward(spark):
    docs = awkward(spark)
    kept = jaccard.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 8}
    assert kept.count() == len(set(groups([r["text"] for r in docs.collect()])[0])) and jaccard.keep_one(docs.filter("false")).collect() == []
