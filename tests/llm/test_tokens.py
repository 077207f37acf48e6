"""Encoding, decoding and packing against public tokenizer libraries."""

import hashlib
import random
import zlib
from functools import partial
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import DATA
from helpers import awkward, clashing, documents
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from phonolith.llm import bpe, packing, queries

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.PerfectHash(bpe.read_ranks(MULTI)), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_perfect_hash():
    ranks = bpe.read_ranks(MULTI)
    table = bpe.PerfectHash(ranks)
    assert sorted(table.ids) == sorted(ranks.values()) and len(table.keys) == len(ranks)  # minimal
    find = table.finder()
    assert all(find(k) == r for k, r in ranks.items()) and find(b"\xff\xfe\xfd never a token") is None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "é", "1", "'s", "!", ".", " ", "　", "word", "\t", "\x1c", "\x85", "😀", " the", "ing."]), max_size=14).map("".join) | st.text(max_size=40))
def test_encoding(codec, reference, text):
    got = codec.encode([text])[0]
    assert ids(got) == reference.encode_ordinary(text) and codec.decode(got) == text.encode()


def test_every_character(codec, reference):
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}c  {chr(c)}\n 1{chr(c)}2" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 29 == 0)]
    assert all(ids(a) == reference.encode_ordinary(t) for a, t in zip(codec.encode(texts), texts))


def test_long_words(codec, reference):
    text = "".join(random.Random(1).choices("abcdeé", k=30000)) + " " * 5000 + "!" * 3000
    assert ids(codec.encode([text])[0]) == reference.encode_ordinary(text)


def test_codec_operators(spark, reference):
    docs = documents(spark, [(1, "Hello wörld"), (2, None), (2, ""), (None, "x y")])
    both = bpe.decode(bpe.encode(clashing(docs).drop("ids"), MULTI, P.PATTERN), MULTI, P.PATTERN)
    assert Counter((r[0], bytes(r[1])) for r in both.collect()) == Counter([(1, "Hello wörld".encode()), (2, b""), (2, b""), (None, b"x y")])
    got = {r["doc_id"]: r for r in queries.op4_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        want = reference.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]][1:] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def encoder():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, docs):
    """Each id in one piece, sequences gapless and short enough; returns the share of padding."""
    encode, by, seqs = encoder(), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    want, got = Counter(), Counter()
    for key, text in docs:
        want[key] += len(encode(text))
    for key, pieces in by.items():
        got[key] = sum(p["length"] for p in pieces)
        texts = [encode(t) for k, t in docs if k == key]
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(texts[0])
                assert p["ids_crc32"] == zlib.crc32(np.array(texts[0][at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(texts[0])
    assert got == want
    padded = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
        padded += 0 if at.bit_count() == 1 else 1024 - at
    return padded / sum(want.values()) if rows else 0


def test_packing(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert check_packing(queries.op8_packing(spark, DATA).collect(), docs) < 0.01
    many = spark.read.parquet(f"{DATA}/documents.parquet").repartition(40)  # leftovers of three groups
    assert check_packing(packing.pack(many, JSON).collect(), docs) < 0.01


def test_packing_awkward(spark):
    docs = awkward(spark)
    assert check_packing(packing.pack(clashing(docs), JSON).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()]) < 0.05
    assert packing.pack(docs.filter("false"), JSON).collect() == []


def test_packing_encoder():
    """The encoder gives the tokenizers library's ids."""
    fast, exact = partial(packing.encoder(JSON).encode, allowed_special="all"), encoder()
    texts = ["x<|endoftext|>y", " " * 3000, "a" * 9000, *(f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}c  {chr(c)}\n 1{chr(c)}2" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x1000 or c % 97 == 0))]
    assert all(fast(t) + [0] == exact(t) for t in texts)


def test_powers_of_two():
    p = packing.Packer(packing.Plan(), 0)
    for n in (700, 300, 600, 5):
        p.add(packing.Piece(n, 0, n, np.arange(n, dtype="<u4").tobytes()))
    p.finish()
    sizes = defaultdict(int)
    for row in p.done:
        sizes[row[5]] += row[2]
    assert sum(sizes.values()) == 1605 and all(s == 1024 or s.bit_count() == 1 or s > 1024 - 8 for s in sizes.values())
