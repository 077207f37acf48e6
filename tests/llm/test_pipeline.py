"""The corpus pipeline, stage by stage on each stage's own input, against brute force."""

import sys
from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest
from conftest import DATA
from helpers import awkward, clashing, documents
from test_jaccard import groups
from test_quality import plain
from test_spans import PII, spans
from test_tokens import check_packing

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from phonolith.llm import pii, quality  # noqa: E402
from phonolith.llm.common import Tables  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    docs, tables = spark.read.parquet(f"{DATA}/documents.parquet"), Tables(spark, "test")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(tables.keep(stage(spark, out[-1], DATA)))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns(stages):
    assert [s.columns for s in stages[1:-1]] == [stages[0].columns] * 3


def test_quality(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    model = quality.train(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    for r in stages[0].collect():
        n = plain(r["text"])
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        good = not failed and model.score((r["text"] or "").encode(), quality.Settings().buckets) >= quality.Settings().threshold
        assert (r["doc_id"] in kept) == good


def test_near_dedup(stages):
    """One row of each group of five-word Jaccard 0.8 or more stays: that of the smallest id."""
    before = [tuple(r) for r in stages[1].collect()]
    low = {}
    for r, g in zip(before, groups([r[1] for r in before])[0]):
        low[g] = min(low.get(g, r), r, key=lambda x: x[0])
    assert rows(stages[2]) == sorted(low.values())


def test_awkward_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, and an empty table."""
    prose = [(100 + i, f"A plain sentence number {i} about rivers, towns and the weather of spring, with some more words to read.") for i in range(30)]
    for name, docs in (("odd", clashing(awkward(spark).union(documents(spark, prose)))), ("none", awkward(spark).filter("false"))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(100 + i, i % 2, 0) for i in range(30)] + [(None, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out) and (out == []) == (name == "none")


def test_pii(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[2].collect():
        want, at = [], 0
        for s in filter(None, spans(r["text"], PII).split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                want += [r["text"][at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        assert texts[r["doc_id"]] == "".join([*want, r["text"][at:]])
    assert pii.redact(stages[3]).count() == stages[3].count()


def test_packing(stages):
    assert check_packing(stages[4].collect(), [(r["doc_id"], r["text"]) for r in stages[3].collect()]) < 0.01
    assert P.path("byte_bpe_50k.json")


def test_run(spark, stages):
    total = lambda df: Counter({r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()})
    assert total(corpus_pipeline.run(spark, DATA)) == total(stages[-1]) and corpus_pipeline.ORACLE_SQL is None
