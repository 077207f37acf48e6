"""Packing gives the ids of an untouched tokenizer, added tokens included."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from helpers import documents
from tokenizers import Tokenizer

from phonolith.llm import packing

JSON = P.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|>", "<|endoftext|><|endoftext|>", " \n<|endoftext|>\n ", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", "plain"]


def test_added_tokens(spark):
    whole = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t in enumerate(TEXTS):
        ids = whole.encode(t, add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    rows = packing.pack(documents(spark, list(enumerate(TEXTS))).coalesce(1), JSON, packing.Plan(merge=1)).collect()
    whole_rows = [r for r in rows if r["start"] == 0 and r["length"] == r["doc_tokens"]]
    got = Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in whole_rows)
    assert len(whole_rows) >= 5 and got <= want
    totals = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert totals == {i: n for i, n, _ in want}
