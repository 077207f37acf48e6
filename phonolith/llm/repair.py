"""Conversation structure repair (operator 13): a fold of higher-order functions over sorted turns.

Windows flag each turn's fault: blank, a duplicate of an earlier turn, or truncated. Turns are collected, sorted, as
small structs (role initial, what the fault asks for), and aggregate() carries four (cost, code) structs through
them, one for each state of the grammar `(s?(ua)+)?`: nothing yet, after s, after u, after a. For each turn native
least() keeps in each state the cheapest edits so far, and among them the ASCII-least. A code has a letter for each
edit, as the audit has, but tells the role: D deletes, I and J insert user and assistant, K keeps, R and S rerole to
user and assistant. Which of I and J, or of R and S, can stand somewhere follows from the letters before it, so codes
are ordered as their audits are, and edits that tie in cost and audit are the same edits.

A conversation may hold most rows, so it is cut. Turns fall into ranges of `chunk` turn numbers, and of the rows of a
range each `chunk` make a chunk. A chunk is folded from each of the four states, which gives a four by four table of
(cost, code); a second aggregate() carries four structs through a conversation's tables. So a task holds a chunk's
small structs, or a conversation's codes, about sixteen letters a turn, never its texts. Duplicates are first marked
within a range, and only the first of each range meet in a window over the conversation. Texts are written once,
and join their edits by row number; the digest of a repaired conversation has to read it in order, so its lines
stream through one task, a line in memory.

Defined results: a null role, text, conversation or turn is one space where strings are made of it; a null conv_id is
a conversation of its own; null turns come first; rows that share a turn come by role, then by the SHA-256 of their
text, which also puts the copies that damage adds next to their originals; further columns are ignored; an empty
table gives an empty table. Gaps that leave 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import spans as S
from .common import Tables, ship


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # for a truncated turn that stays


#: Turn numbers in a range, and rows in a chunk.
CHUNK = 512
SPACE = "\x09\x0a\x0b\x0c\x0d\x20"
ENDS = ".!?"
LETTERS, AUDIT = "DIJKRS", "DIIKRR"
STATE = "struct<cost:long,code:string>"
CARRIED = "struct<cost:long,code:string,path:string>"


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults by their checksum, as (conv, turn, role, text, rep).

    Of crc32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 repeats the
    row (rep 0 and 1), 4 sets role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = rows.select(F.col("conv_id").alias("conv"), "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    reps = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return read.filter(kind != 0).select("conv", "turn", role.alias("role"), text.alias("text"), reps.alias("rep"))


def flagged(rows: DataFrame) -> DataFrame:
    """rows(rid, rep, conv, turn, role, text) without texts: place in a chunk, initial, fault, and whether the turn number is new."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    last = F.substring(bare, -1, 1)
    range_ = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))
    small = rows.select("rid", "rep", "conv", "turn", "role", range_.alias("range"), F.unhex(F.sha2("text", 256)).alias("sha"), (bare == "").alias("blank"), F.instr(F.lit(ENDS), last).alias("ended"))
    own = Window.partitionBy("conv", "range")
    inside = own.orderBy("turn", "role", "sha", "rid", "rep")
    small = small.withColumns({
        "pos": F.row_number().over(inside),
        "new": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(inside)),
        "head": F.row_number().over(Window.partitionBy("conv", "range", "role", "sha").orderBy("turn", "rid", "rep")) == 1,
    })
    heads = Window.partitionBy("conv", "role", "sha", F.when(F.col("head"), F.lit(None)).otherwise(F.col("range"))).orderBy("range")
    again = ~F.col("head") | (F.row_number().over(heads) > 1)
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when((F.col("ended") == 0), "truncated")
    initial = F.substring("role", 1, 1)
    return small.select("rid", "rep", "conv", "turn", "range", F.floor((F.col("pos") - 1) / CHUNK).alias("sub"), "pos", "new", initial.alias("initial"), fault.alias("fault"))


def _to(state: Column, cost: Column, letter: Column) -> Column:
    """state after one more edit; null where there is no such state."""
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["code"], letter).alias("code")))


def _states(*parts: Column) -> Column:
    return F.struct(*[p.alias(f"s{i}") for i, p in enumerate(parts)])


def _inserted(now: Column, c: Costs) -> Column:
    """The four states where inserts may follow."""
    five = F.lit(c.insert)
    after_u = lambda v: F.least(v["s2"], *[_to(v[s], five, F.lit("I")) for s in ("s0", "s1", "s3")])
    with_u = S.let(now, lambda v: _states(v["s0"], v["s1"], after_u(v), v["s3"]))
    return S.let(with_u, lambda v: _states(v["s0"], v["s1"], v["s2"], F.least(v["s3"], _to(v["s2"], five, F.lit("J")))))


def _step(c: Costs):
    def step(now: Column, turn: Column) -> Column:
        initial, stays = turn["initial"], turn["stays"]
        more = F.when(turn["cut"], F.lit(c.truncated)).otherwise(F.lit(0))

        def kept(state: Column, role: str, reroled: str | None) -> Column:
            if reroled is None:
                return F.when(stays & (initial == role), _to(state, more, F.lit("K")))
            cost, letter = (F.when(initial == role, x).otherwise(y) for x, y in ((more, more + c.rerole), (F.lit("K"), F.lit(reroled))))
            return F.when(stays, _to(state, cost, letter))

        gone = [_to(now[f"s{i}"], F.lit(c.delete), F.lit("D")) for i in range(4)]
        moved = _states(
            gone[0],
            F.least(gone[1], kept(now["s0"], "s", None)),
            F.least(gone[2], *[kept(now[s], "u", "R") for s in ("s0", "s1", "s3")]),
            F.least(gone[3], kept(now["s2"], "a", "S")),
        )
        return _inserted(moved, c)

    return step


VECTOR = f"struct<s0:{STATE},s1:{STATE},s2:{STATE},s3:{STATE}>"


def _unit(at: int) -> Column:
    """Only state `at` is open, at no cost."""
    return _states(*[F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("code")) if i == at else F.lit(None) for i in range(4)]).cast(VECTOR)


def table_of(turns: Column, c: Costs) -> Column:
    """What turns, an array of (initial, stays, cut), make of each of the four states."""
    return F.array(*[F.aggregate(turns, _unit(i), _step(c)) for i in range(4)])


def _through(tables: Column, c: Costs) -> Column:
    """Four (cost, code, path) structs after tables in order; path has the state before each table, as a digit."""
    opened = _inserted(_unit(0), c)
    begin = S.let(opened, lambda v: _states(*[F.when(v[f"s{i}"].isNotNull(), F.struct(v[f"s{i}"]["cost"].alias("cost"), v[f"s{i}"]["code"].alias("code"), F.lit("").alias("path"))) for i in range(4)]))
    begin = begin.cast(f"struct<s0:{CARRIED},s1:{CARRIED},s2:{CARRIED},s3:{CARRIED}>")

    def step(now: Column, table: Column) -> Column:
        def to(j: int) -> Column:
            def via(i: int) -> Column:
                a, b = now[f"s{i}"], F.get(table, F.lit(i))[f"s{j}"]
                both = F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["code"], b["code"]).alias("code"), F.concat(a["path"], F.lit(str(i))).alias("path"))
                return F.when(a.isNotNull() & b.isNotNull(), both)

            return F.least(*[via(i) for i in range(4)])

        return _states(*[to(j) for j in range(4)])

    return F.aggregate(tables, begin, step)


def _illegal(initials: Column) -> Column:
    """Adjacent pairs of an array of initials that are not su, ua or au."""
    n = F.greatest(F.size(initials) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(initials, F.lit(1), n), F.slice(initials, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def chunks(small: DataFrame, c: Costs = Costs()) -> DataFrame:
    """flagged()'s rows by chunk: counts, the table of states, and the rows' numbers in order."""
    turn = F.struct("pos", "initial", F.coalesce(~F.col("fault").isin("blank", "duplicate"), F.lit(True)).alias("stays"), F.col("fault").eqNullSafe("truncated").alias("cut"), "rid", "rep")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    made = small.groupBy("conv", "range", "sub").agg(F.array_sort(F.collect_list(turn)).alias("turns"), *counts, F.count_if("new").alias("turn_numbers"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    initials = F.transform("turns", lambda t: t["initial"])
    rows = F.transform("turns", lambda t: F.struct(t["rid"].alias("rid"), t["rep"].alias("rep")))
    return made.select("conv", F.struct("range", "sub", table_of(F.col("turns"), c).alias("table"), rows.alias("rows"), F.element_at(initials, 1).alias("first"), F.element_at(initials, -1).alias("last")).alias("part"), _illegal(initials).alias("illegal"), "blank", "duplicate", "truncated", "turn_numbers", "low", "high")


def folded(parts: DataFrame, c: Costs = Costs()) -> DataFrame:
    """A row for each conversation: its counts, cost, code, path of states and parts."""
    sums = [F.sum(x).alias(x) for x in ("illegal", "blank", "duplicate", "truncated", "turn_numbers")]
    convs = parts.groupBy("conv").agg(F.array_sort(F.collect_list("part")).alias("parts"), *sums, F.min("low").alias("low"), F.max("high").alias("high"))
    n = F.greatest(F.size("parts") - 1, F.lit(0))
    seams = F.zip_with(F.slice("parts", F.lit(1), n), F.slice("parts", F.lit(2), n), lambda a, b: F.concat(a["last"], b["first"]))
    wrong = F.size(F.filter(seams, lambda p: ~p.isin("su", "ua", "au")))
    ended = lambda s, i: F.when(s.isNotNull(), F.struct(s["cost"].alias("cost"), s["code"].alias("code"), F.concat(s["path"], F.lit(str(i))).alias("path")))
    best = S.let(_through(F.transform("parts", lambda p: p["table"]), c), lambda v: F.least(ended(v["s0"], 0), ended(v["s3"], 3)))
    gaps = F.coalesce(F.expr("try_cast(cast(high as decimal(38,0)) - cast(low as decimal(38,0)) + 1 - turn_numbers as bigint)"), F.when(F.col("low").isNull(), F.lit(0).cast("long")))
    return convs.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + wrong).alias("illegal"), best.alias("best"), "parts")


def edits(convs: DataFrame) -> DataFrame:
    """(conv, range, sub, at, rid, rep, code): each row's letters, its own and those of inserts after it, in order by range, sub and at."""
    each = convs.select("conv", "best", F.posexplode("parts").alias("k", "part"))
    before, after = (F.substring("best.path", F.col("k") + i, F.lit(1)).cast("int") for i in (1, 2))
    row = F.get(F.col("part.table"), before)
    code = F.coalesce(*[F.when(after == i, row[f"s{i}"]["code"]) for i in range(4)])
    lead = F.when((F.col("k") == 0) & (before == 2), "I").when((F.col("k") == 0) & (before == 3), "IJ").otherwise("")
    own = F.arrays_zip(F.col("part.rows").alias("row"), F.regexp_extract_all(code, F.lit("([DKRS][IJ]*)"), F.lit(1)).alias("code"))
    none = F.struct(F.struct(F.lit(None).cast("long").alias("rid"), F.lit(None).cast("int").alias("rep")).alias("row"), lead.alias("code"))
    listed = each.select("conv", "part.range", "part.sub", F.posexplode(F.concat(F.array(none), own)).alias("at", "e"))
    return listed.select("conv", "range", "sub", "at", "e.row.rid", "e.row.rep", "e.code").filter(~F.col("code").isin("", "D"))


def lines(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The repaired turns that each row of edits() leaves, newline-joined."""
    met = found.join(rows.select("rid", "rep", "role", "text"), ["rid", "rep"], "left")
    letter = F.substring("code", 1, 1)
    role = F.when(letter == "R", "user").when(letter == "S", "assistant").otherwise(F.col("role"))
    own = F.when(letter.isin("K", "R", "S"), F.array(F.concat(role, F.lit(":"), F.col("text")))).otherwise(F.array().cast("array<string>"))
    more = F.transform(F.filter(F.split("code", ""), lambda x: x.isin("I", "J")), lambda x: F.when(x == "I", "user:").otherwise("assistant:"))
    return met.select("conv", "range", "sub", "at", F.array_join(F.concat(own, more), "\n").alias("lines"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's lines, newline-joined; rows stream in order, one in memory."""
    kind = dict(repaired.dtypes)["conv"]
    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "range", "sub", "at").select("conv", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, type_ = None, None, None
        for batch in batches:
            done, type_ = [], batch.column(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if sha is None or conv != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], type_), pa.array([x[1] for x in done], pa.string())], ["conv", "sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], type_), pa.array([sha.hexdigest()])], ["conv", "sha256"])

    return ordered.mapInArrow(run, f"conv {kind}, sha256 string")


def repair(rows: DataFrame, every: DataFrame, c: Costs = Costs()) -> DataFrame:
    """A row for each conv of every(conv): the faults, cheapest edits and repaired digest of its rows(conv, turn, role, text, rep)."""
    tables = Tables(ship(rows.sparkSession), "repair")
    kept = tables.keep(rows.withColumn("rid", F.monotonically_increasing_id()))
    convs = tables.keep(folded(chunks(flagged(kept), c), c))
    shas = digests(lines(edits(convs), kept)).withColumnRenamed("conv", "_conv")
    convs = convs.drop("parts").withColumnRenamed("conv", "_own")
    every = every.select("conv").distinct()
    out = every.join(convs, F.col("conv").eqNullSafe(F.col("_own")), "left").join(shas, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    gaps = F.when(F.col("_own").isNull() & F.col("best").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps")
    audit = F.coalesce(F.translate("best.code", LETTERS, AUDIT), F.lit("")).alias("audit")
    return out.select("conv", gaps, *[zero(x) for x in ("blank", "duplicate", "truncated", "illegal")], F.coalesce("best.cost", F.lit(0)).cast("long").alias("cost"), audit, F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
