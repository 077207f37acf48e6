"""Secret scan by a trigram inverted index (operator 2). DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams: an OR of ANDs that any matching text must
satisfy. Postings (trigram, row) are made for the trigrams that some rule needs, the postings of each AND are
intersected, and only the surviving (row, rule) pairs run the regular expression. A rule without mandatory trigrams
reads every text.

Texts are read once and stay where they are: the index pass runs the rules without trigrams in place and writes a
row's postings; it keeps the text only of rows that have all trigrams of some AND, the others can't survive. So the
shuffles move postings and, by a number of their own, the texts of candidates. Which rows have candidates is thus
known when postings are written; their intersection says for which rules.

Defined results: a null text is empty and has no spans; null and repeated doc_ids give a row for each input row;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as S
from .common import Tables

BASE = ["assign", "access", "hex"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The first three are fixed by the contract; the others are public key formats that the method adds. Tokens have no
#: greatest length: what a longer one has beyond the usual is part of its span.
RULES = [
    S.Kind("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 1)) >= 12),
    S.Kind("access", "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 18),
    S.Kind("hex", "[0-9a-f]{16,}+"),
    S.Kind("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    S.Kind("github", "gh[pousr]_[A-Za-z0-9]{36,}+"),
    S.Kind("slack", "xox[abprs]-[A-Za-z0-9-]{10,}+"),
    S.Kind("google_api", "AIza[A-Za-z0-9_-]{35,}+"),
    S.Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
]

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])
#: Strings kept exact while a pattern is read, and clauses of a query. Beyond, a query only gets weaker.
MOST = 64


def _grams(strings: set[str]) -> Clauses:
    """Any of strings is in the text: an OR of the ANDs of their trigrams."""
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    """AND; the longer query is dropped if the product has too many clauses."""
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= MOST else min(a, b, key=len)


def _read(items) -> tuple[set[str] | None, Clauses]:
    """Of a parsed sequence: all strings it can match, lower-cased, if few; and its trigram query."""
    run, query, whole = {""}, ANY, True

    def cut():
        nonlocal run, query, whole
        query, run, whole = _both(query, _grams(run)), {""}, False

    for op, arg in items:
        exact, inner = None, ANY
        if op is C.LITERAL:
            exact = {chr(arg).lower()}
        elif op is C.IN and all(x[0] is C.LITERAL for x in arg) and len(arg) <= 8:
            exact = {chr(x[1]).lower() for x in arg}
        elif op is C.SUBPATTERN:
            exact, inner = _read(arg[3])
        elif op is C.BRANCH:
            parts = [_read(x) for x in arg[1]]
            exact = set().union(*(x for x, _ in parts)) if all(x is not None for x, _ in parts) else None
            inner = frozenset(c for _, q in parts for c in q)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            some, needed = _read(body)
            if some is not None and (low, high) == (0, 1):
                exact = {""} | some
            elif some is not None and low == high and low <= 8:
                exact = {""}
                for _ in range(low):
                    exact = {x + y for x in exact for y in some} if len(exact) * len(some) <= MOST else exact
                    whole = whole and len(exact) * len(some) <= MOST
            elif low:
                inner = needed
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {x + y for x in run for y in exact}
        else:
            cut()
            query = _both(query, _both(inner, _grams(exact) if exact is not None else ANY))
    return (run, ANY) if whole else (None, _both(query, _grams(run)))


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams: a text that the pattern matches has all the trigrams of one of them.

    The empty clause stands for a pattern without mandatory trigrams.
    """
    exact, query = _read(P.parse(pattern))
    query = _grams(exact) if exact is not None else query
    return ANY if frozenset() in query else query


def scan(docs: DataFrame, rules: list[S.Kind] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key with `found`, the spans of all rules by start and rule."""
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    free = [(i, r) for i, r in enumerate(rules) if queries[r.name] == ANY]
    indexed = [(i, r) for i, r in enumerate(rules) if queries[r.name] != ANY]
    clauses = sorted({tuple(sorted(c)) for _, r in indexed for c in queries[r.name]})
    grams = sorted({g for c in clauses for g in c})
    body = F.coalesce(F.col(text), F.lit(""))
    if not grams:
        return docs.select(F.col(key), _all(body, free, None).alias("found"))
    spark = docs.sparkSession
    own = S.let(F.lower(body), lambda low: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(low, g)))
    may = reduce(or_, [reduce(and_, [F.array_contains("_grams", g) for g in c]) for c in clauses])
    read = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), body.alias("_body"), own.alias("_grams"))
    rows = Tables(spark, "secrets").keep(read.select("_rid", "_key", "_grams", _all(F.col("_body"), free, None).alias("_free"), F.when(may, F.col("_body")).alias("_text")))

    wanted = spark.createDataFrame([(r.name, n, sorted(c)) for _, r in indexed for n, c in enumerate(sorted(queries[r.name], key=sorted))], "rule string, clause int, grams array<string>")
    wanted = F.broadcast(wanted.select("rule", "clause", F.size("grams").alias("needs"), F.explode("grams").alias("gram")))  # as large as the rules
    postings = rows.select("_rid", F.explode("_grams").alias("gram"))
    met = postings.join(wanted, "gram").groupBy("_rid", "rule", "clause", "needs").agg(F.count("*").alias("has")).filter("has = needs")
    hits = met.groupBy("_rid").agg(F.collect_set("rule").alias("_rules"))  # as many as there are rules
    candidates = rows.filter("_text is not null").select("_rid", "_key", "_free", "_text").join(hits, "_rid", "left")
    found = F.array_sort(F.concat("_free", _all(F.col("_text"), indexed, F.col("_rules"))))
    rest = rows.filter("_text is null").select(F.col("_key").alias(key), F.col("_free").alias("found"))
    return candidates.select(F.col("_key").alias(key), found.alias("found")).union(rest)


def _all(text: Column, rules: list[tuple[int, S.Kind]], only: Column | None) -> Column:
    """Spans of all rules; with only, of those that it names."""
    parts = []
    for i, r in rules:
        part = S.find(text, r, i)
        parts.append(part if only is None else F.when(F.array_contains(only, r.name), part).otherwise(S.none()))
    return F.array_sort(F.concat(*parts)) if parts else S.none()
