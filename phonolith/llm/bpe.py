"""Byte-level BPE encoding and decoding by a two-tier lookup (operator 4).

A minimal perfect hash over the vocabulary resolves each pre-token that is a token already. The others are merged
by a heap of ranked pairs over a doubly linked list of bytes. Work runs in Arrow batches; the hash, as large as
the vocabulary file, is broadcast. Texts are encoded whole, without special tokens. Before both tiers stands a
memory of what was encoded before (tokens.Cache), of bounded size, which only saves time; patterns other than the
public one, across whose pre-tokens its cuts might not hold, go without its cuts.

Defined results: a null text is empty and has no ids; null and repeated doc_ids give a row each; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship
from .tokens import Cache, Words, cuts_hold

ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file. Read on the driver, from where its tokenizer is installed."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash by displacement: key i of n sits in slot (h ^ shift[h % m]) % n."""

    def __init__(self, ranks: dict[bytes, int]):
        from xxhash import xxh64_intdigest

        keys = list(ranks)
        n, m = len(keys), max(1, len(keys) // 3)
        hashes = np.array([xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("two tokens share a hash")
        bucket = (hashes % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begins = np.searchsorted(bucket[order], np.arange(m + 1))
        sizes = np.diff(begins)
        free, slot, shift = np.ones(n, bool), np.empty(n, np.int64), [0] * m
        random = np.random.default_rng(1)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[begins[b] : begins[b + 1]]
            if len(own) == 1:  # its place can be chosen
                at = int(np.argmax(free))
                shift[b], slot[own], free[at] = int(hashes[own[0]]) ^ at, at, False
            while len(own) > 1:
                tries = random.integers(0, 1 << 63, 512, dtype=np.uint64)
                places = ((hashes[own][:, None] ^ tries) % np.uint64(n)).astype(np.int64)
                good = free[places].all(0)
                if len(own) > 1 and good.any():
                    ordered = np.sort(places[:, good], axis=0)
                    apart = (ordered[1:] != ordered[:-1]).all(0)
                    if apart.any():
                        t = np.flatnonzero(good)[np.flatnonzero(apart)[0]]
                        shift[b], slot[own] = int(tries[t]), places[:, t]
                        free[places[:, t]] = False
                        break
        self.n, self.m, self.shift = n, m, shift
        self.keys, self.ids = [b""] * n, [0] * n
        for k, s in zip(keys, slot.tolist()):
            self.keys[s], self.ids[s] = k, ranks[k]

    def finder(self):
        """The id of a key, or None."""
        from xxhash import xxh64_intdigest as hashed

        n, m, shift, keys, ids = self.n, self.m, self.shift, self.keys, self.ids

        def find(key: bytes) -> int | None:
            h = hashed(key)
            s = (h ^ shift[h % m]) % n
            return ids[s] if keys[s] == key else None

        return find


class Codec:
    """Encodes and decodes by a PerfectHash."""

    def __init__(self, table: PerfectHash, pattern: str):
        import regex

        self.find = table.finder()
        self.bytes = dict(zip(table.ids, table.keys))
        self.pairs = [self.find(bytes((a, b))) for a in range(256) for b in range(256)]
        words = Words(regex.compile(pattern).findall, self._words)
        self.encode = Cache(words).texts if cuts_hold(pattern) else words  # lists of texts to lists of packed ids

    def _words(self, words: list[str]) -> list[bytes]:
        """Tier one: a whole token. Tier two: merges."""
        out, find = [], self.find
        for key in map(str.encode, words):
            whole = find(key)
            out.append(array("I", self.merged(key) if whole is None else (whole,)).tobytes())
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the lowest-ranked pair of neighbours, the leftmost of equals, is merged first.

        after[i] and before[i] link the parts, by where they begin; a heap entry holds where its pair begins and
        ends and is stale if the parts there have changed.
        """
        n, pairs, find = len(piece), self.pairs, self.find
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pairs[piece[i] << 8 | piece[i + 1]]) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := find(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if i and (r := find(piece[before[i] : end])) is not None:
                heappush(heap, (r, before[i], end))
        ids, at = [], 0
        while at < n:
            ids.append(self.find(piece[at : after[at]]))
            at = after[at]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One for each worker process and broadcast table, so that its cache serves later tasks too."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value, pattern)
    return _CODECS[shared.id]


class _Shared:
    """A broadcast with an id that pickling keeps."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, hash((broadcast._jbroadcast.id(), id(broadcast)))

    @property
    def value(self):
        return self.broadcast.value


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def _run(docs: DataFrame, path: str, pattern: str, make, schema: str, key: str, column: str) -> DataFrame:
    spark = ship(docs.sparkSession)
    shared = _Shared(spark.sparkContext.broadcast(PerfectHash(read_ranks(path))))

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            yield from make(codec, batch)

    return docs.select(F.col(key).cast("long").alias(key), F.col(column).alias(column)).mapInArrow(run, f"{key} long, {schema}")


def _encoded(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for key, texts in _texts(batch):
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(texts)]
        yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.list_(pa.int32()))], [batch.schema.names[0], "ids"])


def _decoded(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        out = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], [batch.schema.names[0], "bytes"])


def _audited(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for key, texts in _texts(batch):
        ids = codec.encode(texts)
        columns = [key, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids)), pa.array([sha(codec.decode(x)) for x in ids])]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row of docs."""
    return _run(docs, path, pattern, _encoded, "ids array<int>", key, text)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes) of every row of encoded; null ids are none."""
    return _run(encoded, path, pattern, _decoded, "bytes binary", key, ids)


def audit(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every row of docs in one pass and returns digests of both."""
    return _run(docs, path, pattern, _audited, "n_tokens long, ids_sha256 string, decoded_sha256 string", key, text)
