"""Personal data by bootstrapped contextual extraction (operator 3). DataFrame operations only.

The base patterns (email, ip, card, phone) find seed entities. Every identifier-like string (something with an @, or
a run of at least six digits) is an instance, and the words around it induce its lexical patterns: the two words
before it, the word before and the word after it, and the word before it alone if that is a label such as `phone:`.
Over the graph of patterns and instances scores are passed to and fro until they change by less than a tolerance: a
pattern scores the shrunken mean of its instances, a seed is worth 1, another instance as much as the best trusted
pattern that it stands in, or nothing. A pattern is trusted if its score is high and enough of its instances are
worth as much. So patterns that seeds made sure find unseen identifiers, and these make further patterns sure; what
a pattern finds beyond a fifth of its instances speaks against it, which leaves clean texts alone. Instances of
trusted patterns that aren't seeds are spans of kind `context`.

Joins and sums run on distinct (pattern, instance) pairs, so copies of a document add one pair. They meet trusted
patterns, one row each: a small written table is broadcast by its known size, beyond it Spark's adaptive join splits
what a common pattern has. Places, pairs and scores are written tables; texts are read once, and only
rows with an instance that isn't a seed meet the patterns again.

Defined results: a null text is empty and has no spans; null and repeated doc_ids give a row each; further columns
pass through redact() and are ignored by scan(); an empty table gives an empty table. The words around an instance
are whole, however long, and reach as far as the next instance of its class; ^ and $ stand for words that are missing
there. Words over LONG characters enter patterns by their SHA-256, so patterns stay small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as S
from .common import Tables

BASE = ["email", "ip", "card", "phone"]
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(value))
    values = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


#: Fixed by the contract. Possessive and look-behind forms match the same, in linear time and without recursion.
KINDS = [
    S.Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, lambda t: F.contains(t, F.lit("@"))),
    S.Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(IP)),
    S.Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", luhn, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
    S.Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), lambda t: F.contains(t, F.lit("+"))),
]
#: Classes of instances, and which of their values are seeds.
CLASSES = [
    (S.Kind("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", None, lambda t: F.contains(t, F.lit("@"))), lambda v: v.rlike(r"@[A-Za-z0-9-]+\.")),
    (S.Kind("0", r"(?<![A-Za-z0-9+])\+?+[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+", lambda v: F.length(digits(v)) >= 6, lambda t: t.rlike(r"[0-9](?:[\x20().-]{0,3}[0-9]){5}")), lambda v: (v.startswith("+") & F.length(digits(v)).between(9, 15)) | luhn(v) | v.rlike(IP)),
]
LONG = 64
#: White space, as \\s has it.
SPACE = "\t\n\x0b\f\r "


@dataclass(frozen=True)
class Settings:
    support: int = 3  # instances worth `score` that a trusted pattern needs
    score: float = 0.8
    doubt: float = 0.5  # instances worth nothing added to each pattern
    tolerance: float = 0.01
    rounds: int = 100  # more raise an error; values only rise, so they settle


def base(text: Column) -> Column:
    return F.array_sort(F.concat(*[S.find(text, k, i) for i, k in enumerate(KINDS)]))


def last_word(text: Column) -> Column:
    """What follows the last space of text, which has no other white space and none at its end."""
    return F.substring_index(text, " ", -1)


def patterns(kind: str, left: Column, right: Column) -> Column:
    """The patterns that the words around an instance make; left and right reach to the next instances."""
    plain = lambda x: F.translate(x, SPACE, " " * len(SPACE))

    def word(x: Column, end: str) -> Column:
        known = F.when(F.length(x) > LONG, F.concat(F.lit("#"), F.sha2(F.lower(x), 256))).otherwise(F.lower(x))
        return F.when(x == "", F.lit(end)).otherwise(known)

    def made(w: Column) -> Column:
        one, two, after = word(w["one"], "^"), word(w["two"], "^"), word(w["after"], "$")
        both = [F.concat_ws(" ", two, one, F.lit(kind)), F.concat_ws(" ", one, F.lit(kind), after)]
        label = F.when(w["one"].rlike("[A-Za-z]") & w["one"].rlike("[:=#]$"), F.concat_ws(" ", one, F.lit(kind)))
        return F.array_compact(F.array(*both, label))

    def words(x: Column) -> Column:
        one = last_word(x["left"])
        before = F.rtrim(F.substring(x["left"], F.lit(1), F.length(x["left"]) - F.length(one)))
        return F.struct(one.alias("one"), last_word(before).alias("two"), F.substring_index(x["right"], " ", 1).alias("after"))

    sides = F.struct(F.rtrim(plain(left)).alias("left"), F.ltrim(plain(right)).alias("right"))
    return S.let(sides, lambda x: S.let(words(x), made))


CUE = "array<struct<patterns:array<string>,instance:string,start:int,end:int,seed:boolean>>"


def _cues(text: Column) -> Column:
    """(patterns, instance, start, end, seed) of each identifier-like string."""

    def of(kind: S.Kind, seeds) -> Column:
        found = S.places(text, kind.pattern, True)
        if kind.passes:
            found = F.filter(found, lambda p: kind.passes(p["value"]))
        cue = lambda p: F.struct(patterns(kind.name, p["left"], p["right"]).alias("patterns"), F.lower(p["value"]).alias("instance"), p["start"], p["end"], seeds(p["value"]).alias("seed"))
        return F.when(kind.hint(text), F.transform(found, cue)).otherwise(F.expr(f"cast(array() as {CUE})"))

    return F.concat(*[of(kind, seeds) for kind, seeds in CLASSES])


def score(edges: DataFrame, s: Settings, tables: Tables) -> DataFrame:
    """Trusted patterns with their scores, from distinct edges(pattern, instance, seed).

    Only the worth of instances that aren't seeds changes, so only their edges are joined again; mostly there is
    none to begin with, and one round is all.
    """
    worth, known, unseen = None, edges.select("pattern", F.col("seed").cast("double").alias("value")), edges.filter("not seed")
    for _ in range(s.rounds):
        sums = known.groupBy("pattern").agg((F.sum("value") / (F.count("*") + s.doubt)).alias("score"), F.count_if(F.col("value") >= s.score).alias("support"))
        trusted = tables.keep(sums.filter((F.col("score") >= s.score) & (F.col("support") >= s.support)))
        best = unseen.join(trusted.select("pattern", "score"), "pattern")
        now = best.groupBy("instance").agg(F.max("score").alias("value"))
        old = now.sparkSession.createDataFrame([], "instance string, old double") if worth is None else worth.select("instance", F.col("value").alias("old"))
        now = tables.keep(now.join(old, "instance", "left"))
        moved = now.agg(F.max(F.col("value") - F.coalesce("old", F.lit(0.0)))).first()[0]
        if not moved or moved < s.tolerance:
            return trusted
        worth = now
        again = unseen.join(worth.select("instance", "value"), "instance", "left")
        known = edges.filter("seed").select("pattern", F.lit(1.0).alias("value")).union(again.select("pattern", F.coalesce("value", F.lit(0.0))))
    raise RuntimeError("the scores have not settled")


def _marked(docs: DataFrame, s: Settings, text: str, keep_text: bool) -> DataFrame:
    """(_row, found): docs' rows as structs, with their spans."""
    tables = Tables(docs.sparkSession, "pii")
    own = [c for c in docs.columns if keep_text or c != text]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), base(body).alias("_base"), _cues(body).alias("_cues"), F.monotonically_increasing_id().alias("_rid"))
    read = tables.keep(read)
    cues = read.filter(F.size("_cues") > 0).select("_rid", F.explode("_cues").alias("c")).select("_rid", "c.instance", "c.start", "c.end", "c.seed", F.explode("c.patterns").alias("pattern"))
    edges = tables.keep(cues.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    trusted = score(edges, s, tables)
    unseen = cues.filter("not seed").join(trusted.select("pattern"), "pattern")
    span = F.struct("start", F.lit(len(KINDS)).alias("ord"), F.lit("context").alias("kind"), "end", F.col("instance").alias("value"))
    more = unseen.groupBy("_rid").agg(F.collect_set(span).alias("_more"))
    open_ = F.exists("_cues", lambda c: ~c["seed"])
    found = F.array_sort(F.concat("_base", F.coalesce(F.col("_more"), S.none())))
    met = read.filter(open_).select("_row", "_base", "_rid").join(more, "_rid", "left").select("_row", found.alias("found"))
    return read.filter(~open_).select("_row", F.col("_base").alias("found")).union(met)


def scan(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key with `found`, the spans of every text by start and kind."""
    return _marked(docs.select(key, text), s, text, False).select(F.col(f"_row.{key}").alias(key), "found")


def redact(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; n_chars, where there is one, follows."""
    rows = _marked(docs, s, text, True)
    t = F.col(f"_row.`{text}`")
    hit = F.size("found") > 0
    rows = rows.select("_row", hit.alias("_hit"), F.when(hit, S.replaced(t, F.col("found"))).otherwise(t).alias("_clean"))
    new = {text: F.col("_clean")}
    if "n_chars" in docs.columns and text != "n_chars":
        new["n_chars"] = F.when(F.col("_hit"), F.length("_clean")).otherwise(F.col("_row.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
