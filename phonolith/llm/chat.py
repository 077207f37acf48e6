"""Chat formatting with typed content parts (operator 9).

A message's content is a list of parts: text, image, audio or document. A visitor flattens them in order: text is
escaped, any other part becomes a placeholder, its reference is recorded with its place, and its tokens are counted
as the part will be expanded. The template marks turns; control strings inside texts and roles are escaped
reversibly by one more backslash after `<`; a role's newlines and backslashes are escaped too, as its line ends it. The output is a row a turn, so a conversation of any length is never
held together; read in order, its rows are the formatted conversation.

Defined results: a null text is empty, a null role too; a part of an unknown type is an error; rows of a
conversation that share a turn are ordered by role and text; null turns come first; null conv_ids are one
conversation; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import ship

ROWS = 512
START, END, LOSS = "<|im_start|>", "<|im_end|>\n", "assistant"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = "array<struct<kind:string,ref:string,at:int,tokens:int>>"


@dataclass(frozen=True)
class Costs:
    """Tokens that a part expands to."""

    patch: int = 28  # pixels of an image's patch
    most_patches: int = 1280
    audio_per_second: int = 25
    per_page: int = 600


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape(), on one line: a newline is \\n, a backslash is doubled."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Visitor:
    """Flattens parts in order; text() and the others are called by a part's type."""

    costs: Costs
    out: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kinds = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}
        if part["type"] not in kinds:
            raise ValueError(f"a part of type {part['type']!r}")
        kinds[part["type"]](part)

    def text(self, part: dict) -> None:
        self._write(escape(part["text"] or ""))

    def image(self, part: dict) -> None:
        c = self.costs
        patches = math.ceil((part["width"] or 1) / c.patch) * math.ceil((part["height"] or 1) / c.patch)
        self._attach(part, min(c.most_patches, patches))

    def audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part["seconds"] or 0) * self.costs.audio_per_second)))

    def document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 1) * self.costs.per_page)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": part["type"], "ref": part["ref"], "at": self.size, "tokens": tokens})
        self._write(f"<|{part['type']}|>")

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def text_part(text: Column) -> Column:
    """A list of parts: text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (x.split(":") for x in PART[7:-1].split(",")[2:])])).cast(f"array<{PART}>")


def format_turns(messages: DataFrame, costs: Costs = Costs(), key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """messages(key, turn, role, parts) as rows (key, turn, formatted, mask_start, mask_end, attachments, tokens).

    mask_start and mask_end bound the code points of formatted under the loss mask, both 0 if there are none;
    tokens are those that the attachments expand to.
    """
    ship(messages.sparkSession)
    read = messages.select(F.col(key).cast("long").alias(key), F.col(turn).cast("long").alias(turn), "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    schema = f"{key} long, {turn} long, formatted string, mask_start int, mask_end int, attachments {TURN}, tokens long"
    arrow = [("formatted", pa.string()), ("mask_start", pa.int32()), ("mask_end", pa.int32()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())]))), ("tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, rows = whole.slice(at, ROWS), []
                for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    head = f"{START}{escape_role(role or '')}\n"
                    v = Visitor(costs, [head], len(head))
                    for part in parts or []:
                        v.visit(part)
                    mask = (len(head), v.size) if role == LOSS else (0, 0)
                    rows.append(("".join([*v.out, END]), *mask, v.attachments, sum(a["tokens"] for a in v.attachments)))
                columns = [pa.array(x, t) for x, (_, t) in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [key, turn, *(n for n, _ in arrow)])

    return read.mapInArrow(run, schema)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn of text parts."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(START) : -len(END)].partition("\n")
    return unescape_role(role), unescape(text)


def read_back(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Digests of each conversation, read in order from format_turns()'s rows; they stream, one turn in memory.

    Spark deals a conversation's rows to one task, as a digest over all its text needs; it holds the running
    digests only.
    """
    ship(turns.sparkSession)
    schema = f"{key} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        for batch in batches:
            done = []
            for conv, formatted, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != now:
                    if begun:
                        done.append((now, n, sha.hexdigest(), loss, loss_sha.hexdigest(), chars))
                    now, begun, n, loss, chars, sha, loss_sha = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse_turn(formatted)
                learnt = unescape(formatted[a:b])
                sha.update(f"{role}\n{text}\n".encode())
                loss_sha.update(learnt.encode())
                n, loss, chars = n + 1, loss + len(learnt), chars + len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)
        if begun:
            last = (now, n, sha.hexdigest(), loss, loss_sha.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, types)], names)

    ordered = turns.repartition(key).sortWithinPartitions(key, turn, "formatted")
    return ordered.select(key, "formatted", "mask_start", "mask_end").mapInArrow(run, schema)
