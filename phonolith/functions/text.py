"""Text: normalisation, distances, sentences, token decoding. Column in, Column out."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def squeeze(t: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize(t: Column) -> Column:
    """Lower case, a-z, 0-9 and single spaces only; in one pass, as what is neither a letter nor a digit becomes space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_unicode(t: Column) -> Column:
    """As normalize(), keeping letters and numbers of any script."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}\s]", " "))


@F.pandas_udf(StringType())
def normalize_compat(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, straight quotes, no _ and * marks, single spaces, lower case."""
    quotes = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "_": " ", "*": " "})
    for s in batches:
        yield s.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").translate(quotes).split()).lower())


def reference_text(t: Column) -> Column:
    """Marker words to line breaks, one for each run of breaks and white space around them."""
    t = F.replace(F.replace(F.coalesce(t, F.lit("")), F.lit("PARAGRAPH"), F.lit("\n\n")), F.lit("NEWLINE"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"\s+\n", "\n"), r"\n\s+", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean_reference(t: Column) -> Column:
    """Marker words to spaces, lower case, no ASCII punctuation, trimmed."""
    t = F.replace(F.replace(F.coalesce(t, F.lit("")), F.lit("PARAGRAPH"), F.lit(" ")), F.lit("NEWLINE"), F.lit(" "))
    return F.trim(F.regexp_replace(F.lower(t), r"[!-/:-@\[-`{-~]", ""))


def words(t: Column) -> Column:
    return F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the share of edits between normalised texts."""
    a, b = normalize(a), normalize(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def cer(reference: Column, got: Column) -> Column:
    """Character edits per reference character; 0 without reference."""
    return F.when(F.length(reference) == 0, 0.0).otherwise(F.levenshtein(reference, got) / F.length(reference))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda an outer expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Where the characters that stand for words begin: two planes for private use, 131,072 code points in a row.
FIRST, PLANES = 0xF0000, 0x20000


def word_edits(reference: Column, got: Column) -> Column:
    """Word edits between two lists of words, as character edits of strings with a character for each distinct word.

    A pair with more distinct words than PLANES is an error, not a wrong number; edits.item_edits() takes those.
    """

    def edits(p: Column) -> Column:
        places = F.map_from_entries(F.transform(p["known"], lambda w, i: F.struct(w, i)))
        return let(F.struct(p["a"], p["b"], places.alias("places")), lambda q: F.levenshtein(_spelt(q["a"], q["places"]), _spelt(q["b"], q["places"])))

    pair = F.struct(reference.alias("a"), got.alias("b"), F.array_distinct(F.concat(reference, got)).alias("known"))
    return let(pair, lambda p: F.when(F.size(p["known"]) > PLANES, F.raise_error(F.lit("too many distinct words in a pair"))).otherwise(edits(p)).cast("int"))


def _spelt(words: Column, places: Column) -> Column:
    """A string of the UTF-8 characters FIRST + place of each word."""
    code = lambda w: F.element_at(places, w) + F.lit(FIRST)
    byte = lambda c, shift, lead, mask: F.lpad(F.hex(F.shiftright(c, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(lead))), 2, "0")
    hexed = lambda c: F.concat(byte(c, 18, 0xF0, 0x07), byte(c, 12, 0x80, 0x3F), byte(c, 6, 0x80, 0x3F), byte(c, 0, 0x80, 0x3F))
    return F.decode(F.unhex(F.array_join(F.transform(F.transform(words, code), hexed), "")), "UTF-8")


def wer(reference: Column, got: Column) -> Column:
    n = F.size(reference)
    return F.when(n == 0, 0.0).otherwise(word_edits(reference, got) / n)


def matched_prefix(a: Column, b: Column) -> Column:
    """How many leading elements of two lists are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)).cast("long")


def ratio4(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part / whole * 10000 + 0.5) / 10000).otherwise(0.0)


SENTENCE = r"[^.!?]+[.!?]+|[^.!?]+$"


def sentences(t: Column) -> Column:
    found = F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(found, lambda s: s != "")


def join_fragments(parts: Column) -> Column:
    """Trimmed, non-empty fragments joined by single spaces."""
    return squeeze(F.array_join(F.filter(F.transform(parts, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != ""), " "))


def decode_pieces(pieces: Column, blank: str = "<blank>") -> Column:
    """Word pieces to text: blanks and <...> controls go, the word mark is a space, none stands before punctuation."""
    kept = F.filter(pieces, lambda p: (p != blank) & ~p.rlike("^<.*>$"))
    text = F.replace(F.array_join(kept, ""), F.lit("▁"), F.lit(" "))
    return squeeze(F.regexp_replace(text, r"\s+([.,!?;:])", "$1"))


def csv_field(v: Column) -> Column:
    """As a CSV field: null is empty; quoted only with a quote, comma or line break inside."""
    t = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(t.rlike("[\",\n]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def language_token(t: Column) -> Column:
    t = F.trim(t)
    return F.when(t.startswith("<|") & t.endswith("|>"), t).otherwise(F.concat(F.lit("<|"), t, F.lit("|>")))


def boolean_option(t: Column, fallback: bool) -> Column:
    """yes and true, no and false, in any case; null where neither, the fallback for null."""
    v = F.lower(F.trim(t))
    return F.when(t.isNull(), fallback).when(v.isin("yes", "true"), True).when(v.isin("no", "false"), False)


def task_option(t: Column) -> Column:
    v = F.lower(F.trim(t))
    return F.when(v == "asr", "asr").when(v.isin("ast", "translate", "translation", "speech-translation"), "translation")


def toggle_token(name: str, on: Column) -> Column:
    return F.when(on, f"<|{name}|>").otherwise(f"<|no{name}|>")


def common_run(a: Column, b: Column) -> Column:
    """(a, b, n): where the longest run of equal words of two lists begins in each, from 0; of equals the first in a, then in b.

    Hashes of runs of 1, 2, 4 ... words are made by doubling, and two of them that overlap make the hash of a run of
    any length. A run of n words holds runs of fewer, so n is found bit by bit; each test meets two sets of hashes, so
    words that occur often cost no more than others. The run found is compared word for word; were hashes to
    mislead, that is an error, not a wrong answer.
    """
    get, size = F.get, F.size
    pow2 = lambda j: F.call_function("shiftleft", F.lit(1), j)
    high = lambda n: F.length(F.bin(n)).cast("int") - 1  # noqa: E731  of n's highest bit

    def doubled(words: Column) -> Column:
        def more(all_: Column, j: Column) -> Column:
            half = pow2(j - 1)
            pairs = let(F.struct(get(all_, j - 1).alias("h"), half.alias("half")), lambda p: F.transform(F.sequence(F.lit(0), size(p["h"]) - p["half"] - 1), lambda i: F.xxhash64(get(p["h"], i), get(p["h"], i + p["half"]))))
            return F.concat(all_, F.array(pairs))

        first = F.array(F.transform(words, lambda w: F.xxhash64(w)))
        levels = F.when(size(words) > 1, F.sequence(F.lit(1), high(size(words)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(levels, first, more)

    def grams(side: Column, n: Column) -> Column:
        """Hashes of all runs of n words: two overlapping halves each."""
        parts = let(high(n), lambda j: F.struct(get(side["levels"], j).alias("h"), (n - pow2(j)).alias("back")))
        return let(parts, lambda p: F.transform(F.slice(p["h"], F.lit(1), size(p["h"]) - p["back"]), lambda h, i: F.xxhash64(h, get(p["h"], i + p["back"]))))

    def found(p: Column) -> Column:
        most = F.least(size(p["x"]["words"]), size(p["y"]["words"]))
        bits = F.when(most > 0, F.transform(F.sequence(F.lit(0), high(most)), lambda i: pow2(high(most) - i))).otherwise(F.array().cast("array<int>"))
        shared = lambda n: F.when(n <= most, F.arrays_overlap(grams(p["x"], n), grams(p["y"], n))).otherwise(False)
        longest = F.aggregate(bits, F.lit(0), lambda n, bit: F.when(shared(n + bit), n + bit).otherwise(n))
        return let(longest, lambda n: F.when(n > 0, placed(p, n)))

    def placed(p: Column, n: Column) -> Column:
        both = F.struct(grams(p["x"], n).alias("x"), grams(p["y"], n).alias("y"))
        first = let(both, lambda g: let(get(F.array_intersect(g["x"], g["y"]), F.lit(0)), lambda h: F.struct((F.array_position(g["x"], h) - 1).alias("a"), (F.array_position(g["y"], h) - 1).alias("b"), n.cast("long").alias("n"))))
        part = lambda side, at: F.slice(side["words"], at.cast("int") + 1, n)
        return let(first, lambda r: F.when(part(p["x"], r["a"]) == part(p["y"], r["b"]), r).otherwise(F.raise_error(F.lit("two runs share a hash")).cast("struct<a:bigint,b:bigint,n:bigint>")))

    side = lambda words: F.struct(words.alias("words"), doubled(words).alias("levels"))
    return let(F.struct(side(a).alias("x"), side(b).alias("y")), found)


def utf16(t: Column) -> Column:
    """The UTF-16 units of a text, as longs."""
    hexed = F.hex(F.encode(t, "UTF-16BE"))
    count = F.floor(F.length(hexed) / 4).cast("int")
    return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("long")))


def imul(a: Column, b: Column | int) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def fnv1a(t: Column) -> Column:
    """FNV-1a in 32 bits over the UTF-16 units of a text; null for null and empty texts, which seed nothing."""
    return F.when(t != "", F.aggregate(utf16(t), F.lit(2166136261).cast("long"), lambda h, c: imul(h.bitwiseXOR(c), 16777619)))


def draws(seed: Column, count: int) -> Column:
    """The first numbers, from 0 to below 1, of the 32-bit Mulberry generator with an unsigned 32-bit seed."""
    low = F.lit(0xFFFFFFFF)
    turn = lambda s: imul(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    mix = lambda t: t.bitwiseXOR((t + imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(low))
    number = lambda t: t.bitwiseXOR(F.shiftright(t, 14)).bitwiseAND(low) / (1 << 32)
    one = lambda i: let(let((seed + (i + 1) * F.lit(0x6D2B79F5).cast("long")).bitwiseAND(low), lambda s: turn(s)), lambda t: let(mix(t), number))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)
