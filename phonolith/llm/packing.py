"""Bounded-space online packing of tokenised documents into sequences (operator 8).

Each partition keeps at most `windows` open sequences and places a piece into the one it fits best. When none fits,
the fullest is filled with the piece's first tokens (or closed as it is, if fewer than `least` tokens would fit) and
emitted. What stays open at a partition's end, a bounded number of tokens, is merged in groups of `merge`
partitions by the same rule; the last open sequences of a group are joined end to end, and a rest shorter than a
sequence is cut at powers of two, which need no padding.

Defined results: a null text is empty and packs its end token only; null and repeated doc_ids pack a document each;
further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Tables, ship

ROWS = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = f"{SCHEMA}, ids binary, part int, slot int"
NAMES = [x.split()[0] for x in OPEN.split(", ")]
TYPES = [pa.int64()] * 7 + [pa.binary(), pa.int32(), pa.int32()]


@dataclass(frozen=True)
class Plan:
    length: int = 1024
    windows: int = 32
    merge: int = 16
    least: int = 8
    end: int = 0


@dataclass
class Piece:
    doc: int | None
    start: int
    total: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.total, self.ids[: 4 * n]), Piece(self.doc, self.start + n, self.total, self.ids[4 * n :])


@dataclass
class Packer:
    """Packs pieces as they come. first: the id of its first sequence."""

    plan: Plan
    first: int
    done: list[tuple] = field(default_factory=list)
    open: list[tuple[int, list[Piece]]] = field(default_factory=list)

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.done.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, self.first, at, None, None, None))
            at += len(p)
        self.first += 1

    def add(self, piece: Piece) -> None:
        room = self.plan.length
        while len(piece) >= room:
            head, piece = piece.cut(room)
            self.emit([head])
        while n := len(piece):
            best = min((i for i, (free, _) in enumerate(self.open) if free >= n), key=lambda i: self.open[i][0], default=None)
            if best is not None:
                free, held = self.open[best]
                held.append(piece)
                if free == n:
                    self.emit(self.open.pop(best)[1])
                else:
                    self.open[best] = (free - n, held)
                return
            if len(self.open) < self.plan.windows:
                self.open.append((room - n, [piece]))
                return
            free, held = self.open.pop(min(range(len(self.open)), key=lambda i: self.open[i][0]))
            if free >= self.plan.least:
                head, piece = piece.cut(free)
                held.append(head)
            self.emit(held)

    def finish(self) -> None:
        """Joins the open sequences end to end; a last rest goes into sequences of powers of two."""
        held, size = [], 0
        for p in [p for _, pieces in sorted(self.open, key=lambda x: x[0]) for p in pieces]:
            while size + len(p) >= self.plan.length:
                head, p = p.cut(self.plan.length - size)
                self.emit([*held, head])
                held, size = [], 0
            if len(p):
                held.append(p)
                size += len(p)
        while size:
            want, part = 1 << (size.bit_length() - 1), []
            size -= want
            while want:
                head, rest = held[0].cut(min(want, len(held[0])))
                part.append(head)
                want -= len(head)
                held = ([rest] if len(rest) else []) + held[1:]
            self.emit(part)
        self.open = []

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            columns = [pa.array(x, t) for x, t in zip(zip(*self.done), TYPES)]
            self.done = []
            yield pa.RecordBatch.from_arrays(columns, NAMES)


_ENCODERS: dict[str, tiktoken.Encoding] = {}


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file of the tokenizers library, special tokens left out.

    Such files write bytes as characters: printable ones as themselves, the others from 256 on. Ids follow the
    order of the merges, so they serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in data["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}


def added(path: str) -> dict[str, int]:
    """Strings and ids of the file's added tokens."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str) -> tiktoken.Encoding:
    """Gives the ids that the tokenizers library gives for this file, which tests check, in a quarter of its time.

    The file's added tokens are its special tokens: encode() with all of them allowed gives their ids wherever
    their strings stand, as the library does, and encode_ordinary() takes them as text. One for each worker process.
    """
    if path not in _ENCODERS:
        from public_tokenizers import PATTERN

        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=vocabulary(path), special_tokens=added(path))
    return _ENCODERS[path]


def _packed(path: str, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = partial(encoder(path).encode, allowed_special="all"), TaskContext.get().partitionId()
        packer = Packer(plan, part << 32)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    ids = encode(text or "")
                    ids.append(plan.end)
                    packer.add(Piece(doc, 0, len(ids), np.array(ids, "<u4").tobytes()))
                yield from packer.taken()
        for slot, (_, pieces) in enumerate(packer.open):
            packer.done += [(p.doc, p.start, len(p), None, p.total, None, None, p.ids, part, slot) for p in pieces]
        yield from packer.taken()

    return run


def _merged(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of open sequences come by group of partitions; each group is packed anew."""
        group, packer = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if packer is None or r["part"] // plan.merge != group:
                    if packer:
                        packer.finish()
                        yield from packer.taken()
                    group = r["part"] // plan.merge
                    packer = Packer(plan, 1 << 62 | group << 32)
                packer.add(Piece(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]))
        if packer:
            packer.finish()
            yield from packer.taken()

    return run


def pack(docs: DataFrame, path: str, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all docs, each once: where it lies in its document and in its sequence."""
    spark = ship(docs.sparkSession)
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = Tables(spark, "packing").keep(read.mapInArrow(_packed(path, plan), OPEN))
    rest = first.filter("ids is not null").withColumn("group", F.expr(f"part div {plan.merge}"))
    rest = rest.repartition("group").sortWithinPartitions("group", "part", "slot", "doc_id", "start").drop("group")
    columns = NAMES[:7]
    return first.filter("ids is null").select(columns).unionAll(rest.mapInArrow(_merged(plan), OPEN).select(columns))
