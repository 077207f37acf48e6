"""Edit distances of long texts and of long lists, exact and whole, in Arrow batches.

F.levenshtein() fills a table of all pairs of characters, which suits turns. Here a column of that table is two whole
numbers with a bit for each element of the longer side (Myers 1999, in Hyyro's form), and a few operations on them make
the next column, one for each element of the shorter side; what both sides begin or end with costs nothing. Texts of n
and m characters take min(n, m) steps on numbers of max(n, m) bits, so time is n * m / 64 word operations, and memory a
few numbers. Elements may be characters or words, of any number of kinds.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

#: Bytes of the places of elements that are kept at once; those of the rest are made again.
KEPT = 16 << 20
#: Steps after which what has run over a column's end is cut off.
TIDY = 512


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Fewest insertions, deletions and substitutions that turn a into b."""
    if len(a) < len(b):
        a, b = b, a
    low, n, m = 0, len(a), len(b)
    while low < m and a[low] == b[low]:
        low += 1
    while m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    if low == m:
        return n - low
    size = n - low
    where: dict[Hashable, list[int]] = {x: [] for x in b[low:m]}
    for i, x in enumerate(a[low:n]):
        if x in where:
            where[x].append(i)

    def marked(x: Hashable) -> int:
        """The places of x on the longer side, as bits."""
        bits = bytearray(size + 7 >> 3)
        for i in where[x]:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    places: dict[Hashable, int] = {}
    most = max(1, KEPT // (size + 7 >> 3))
    full = (1 << size) - 1
    up, down, cost = full, 0, size  # where a column grows and falls; its last entry. Bits from size on mean nothing
    for j, x in enumerate(b[low:m]):
        same = places.get(x)
        if same is None:
            same = marked(x)
            if len(places) < most:
                places[x] = same
        level = (((same & up) + up) ^ up) | same | down
        right, left = (((level | up) ^ full) | down) << 1 | 1, (level & up) << 1
        cost += (right >> size & 1) - (left >> size & 1)
        up, down = ((level | right) ^ full) | left, right & level
        if j % TIDY == TIDY - 1:
            up, down = up & full, down & full
    return cost


@F.pandas_udf(LongType())
def char_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Character edits of two texts; null if one is."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(LongType())
def item_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits of two lists of texts, such as words; null if one is."""
    return pd.Series([None if x is None or y is None else distance(x.tolist(), y.tolist()) for x, y in zip(a, b)], dtype="Int64")


def rate(edits: Column, size: Column) -> Column:
    """Edits for each element of the reference; 0 without one."""
    return F.when(size == 0, 0.0).otherwise(edits / size)
