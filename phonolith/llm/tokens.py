"""Cutting texts where a byte-level BPE can't merge across, and a bounded cache of what the cuts encode to.

A space before a non-space always begins a new pre-token under the public byte-level pattern, so a text may be cut
there and its pieces encoded apart; most pieces are common words that a cache answers.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice

#: Pieces and pre-tokens remembered, the longest that are, and pieces of the hot part: the bounds of a cache's memory.
PIECES, WORDS, LONGEST, HOT = 700_000, 600_000, 48, 16_384


def cuts_hold(pattern: str) -> bool:
    """Whether texts may be cut as this module does: what it states of pre-tokens is true of the public pattern only."""
    from public_tokenizers import PATTERN

    return pattern == PATTERN


def pieces(text: str) -> list[str]:
    """text cut at each space that a non-space follows; all but the first lack that space."""
    out: list[list[str]] = []
    for part in text.split(" "):
        if out and (not part or part[0].isspace()):
            out[-1].append(part)
        else:
            out.append([part])
    return [" ".join(x) for x in out]


#: Marks that end a piece. After a letter or digit they always begin a pre-token of their own.
MARKS = ".,!?;:"


def cut_marks(piece: str) -> tuple[str, str]:
    """A piece without the marks at its end, and these; only after a plain letter or digit, else whole."""
    if piece and piece[-1] in MARKS:
        word = piece.rstrip(MARKS)
        if word and word[-1] < "\u0250" and word[-1].isalnum():
            return word, piece[len(word) :]
    return piece, ""


class Cache:
    """Ids of texts, packed as little-endian unsigned 32-bit integers. encode: the same of strings, all at once.

    Pieces that follow a space are remembered. When full, a memory keeps its older half, where the common ones are.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.pieces: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.hot: dict[str, bytes] = {}  # the oldest pieces: small enough for a processor's cache

    def texts(self, texts: list[str]) -> list[bytes]:
        rows, need = [], {}
        for text in texts:
            first, *rest = text.split(" ")
            ids, gaps = self._known(rest)
            if any(not rest[i] or rest[i][0].isspace() for i in gaps):
                first, *rest = pieces(text)
                ids, gaps = self._known(rest)
            need.update(dict.fromkeys(cut_marks(rest[i])[0] for i in gaps))
            rows.append((first, rest, ids, gaps))
        new = list(need)
        need.update(zip(new, self.encode([" " + p for p in new])))
        out = []
        for head, (_, rest, ids, gaps) in zip(self.encode([r[0] for r in rows]), rows):
            for i in gaps:
                word, marks = cut_marks(rest[i])
                ids[i] = need[word] + self._marks(marks) if marks else need[word]
            out.append(head + b"".join(ids))
        self.pieces.update((p, x) for p, x in need.items() if len(p) <= LONGEST)
        self.pieces = _older(self.pieces, PIECES)
        if len(self.hot) < HOT:
            self.hot = dict(islice(self.pieces.items(), HOT))
        return out

    def _known(self, parts: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Ids of parts, and the places of those that aren't remembered."""
        ids = list(map(self.hot.get, parts))
        cold = [i for i, x in enumerate(ids) if x is None]
        gaps = []
        for i, x in zip(cold, map(self.pieces.get, [parts[i] for i in cold])):
            if x is None:
                word, marks = cut_marks(parts[i])
                x = self.pieces.get(word) if marks else None
                x = x + self._marks(marks) if x is not None else None
            if x is None:
                gaps.append(i)
            else:
                ids[i] = x
        return ids, gaps

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= HOT:
                self.marks.clear()
            self.marks[marks] = self.encode([marks])[0]
        return self.marks[marks]


class Words:
    """An encode of strings by their pre-tokens, which are remembered: for when a pre-token costs much.

    split: a string's pre-tokens. encode: ids of pre-tokens, all at once.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]]):
        self.split, self.encode, self.known = split, encode, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut, known = list(map(self.split, texts)), self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, self.encode(new)))
        get = known.__getitem__
        out = [get(w[0]) if len(w) == 1 else b"".join(map(get, w)) for w in cut]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        self.known = _older(known, WORDS)
        return out


def _older(known: dict[str, bytes], most: int) -> dict[str, bytes]:
    return known if len(known) <= most else dict(islice(known.items(), most // 2))
