"""Folds that merge overlapping transcripts. Each emits what it newly settles and what is still open.

What is settled leaves the state: only a tail stays, to tell repeats from new words. So state, work and output of a
row don't grow with the stream; settled rows read in order are the transcript.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import defaultdict, deque
from dataclasses import dataclass, field
from difflib import SequenceMatcher

SENTENCE = re.compile(r"[^.!?]+[.!?]+|[^.!?]+$")


def key_of(text: str) -> str:
    return " ".join(text.lower().split())


def bare(text: str) -> int:
    """Characters that aren't white space."""
    return len("".join(text.split()))


def cut_sentences(words: list) -> list[list]:
    """words, whose first items are texts, by the sentences that these make; a word goes to the sentence it ends in."""
    out, left = [], iter(words)
    for sentence in SENTENCE.findall(" ".join(w[0] for w in words)):
        own, want = [], bare(sentence)
        while want > 0 and (word := next(left, None)) is not None:
            own.append(word)
            want -= bare(word[0])
        if own:
            out.append(own)
    if rest := list(left):
        out.append(rest)
    return out


@dataclass
class Utterances:
    """Settles all sentences of a window but the last; repeats that end at about the same time are dropped.

    A sentence is told from the last `memory` settled ones.
    """

    tolerance: float = 0.15
    least_words: int = 1
    memory: int = 256
    tail: deque = field(default_factory=deque)  # (key, end or None)
    pending: list = field(default_factory=list)  # words (text, start, end)
    cursor: float = 0.0
    revision: int = 0

    def known(self, text: str, end: float | None) -> bool:
        near = lambda e: e is None or end is None or abs(e - end) <= self.tolerance
        return any(k == key_of(text) and near(e) for k, e in self.tail)

    def _settle(self, sentences: list[list]) -> list[str]:
        out = []
        for words in sentences:
            text, end = " ".join(w[0] for w in words), words[-1][2]
            if len(words) >= self.least_words and not self.known(text, end):
                out.append(text)
                self.tail.append((key_of(text), end))
                self.cursor = max(self.cursor, end or 0.0)
        while len(self.tail) > self.memory:
            self.tail.popleft()
        return out

    def process(self, words: list) -> dict:
        """words: (text, start, end) of a window's transcript; times may be None."""
        self.revision += 1
        *done, self.pending = cut_sentences(words) or [[]]
        return self.state(self._settle(done))

    def finalize(self) -> dict:
        settled = self._settle([self.pending] if self.pending else [])
        self.revision, self.pending = self.revision + len(settled), []
        return self.state(settled)

    def state(self, settled: list[str]) -> dict:
        return {"revision": self.revision, "settled": " ".join(settled), "preview": " ".join(w[0] for w in self.pending), "cursor": self.cursor}

    def step(self, row: dict) -> list[dict]:
        words = [(w, None, None) if isinstance(w, str) else tuple(w) for w in row["words"]]
        return [self.process(words)] + ([self.finalize()] if row.get("final") else [])


@dataclass
class Times:
    """Times of tokens by id, in order."""

    of: dict = field(default_factory=lambda: defaultdict(list))

    def add(self, token: tuple) -> None:
        insort(self.of[token[0]], token[1])

    def near(self, token: tuple, distance: float) -> bool:
        """Whether a token of this id lies closer than distance."""
        times = self.of.get(token[0], ())
        at = bisect_left(times, token[1])
        return any(abs(t - token[1]) < distance for t in times[max(0, at - 1) : at + 1])

    def forget(self, before: float) -> None:
        for i in list(self.of):
            self.of[i] = [t for t in self.of[i] if t >= before]
            if not self.of[i]:
                del self.of[i]


#: Seconds behind a window's start in which a settled token may be seen again.
REACH = 60.0


@dataclass
class Aligned:
    """Tokens by time: what comes before the first token that two windows share is settled, and so is what is seen often."""

    frame_s: float = 0.08
    near_s: float = 0.2
    stable: int = 2
    settled: Times = field(default_factory=Times)
    pending: list = field(default_factory=list)  # (id, time)
    votes: dict = field(default_factory=dict)  # by id and tenth of a second

    def _anchor(self, again: list) -> tuple[int, float | None]:
        """How many tokens of the overlap are pending too, and when the first of them is."""
        open_ = Times()
        for t in self.pending:
            open_.add(t)
        shared = [t[1] for t in again if open_.near(t, self.near_s)]
        return len(shared), min(shared, default=None)

    def _voted(self, again: list):
        for t in again:
            slot = t[0], math.floor(10 * t[1] + 0.5)
            self.votes[slot] = self.votes.get(slot, 0) + 1
            if self.votes[slot] >= self.stable and not self.settled.near(t, self.near_s):
                yield t

    def step(self, row: dict) -> list[dict]:
        tokens = [(i, row["start"] + f * self.frame_s) for i, f in zip(row["ids"], row["frames"])]
        limit, out = row["start"] + row["overlap"], []

        def settle(some) -> None:
            for t in some:
                out.append(t[0])
                self.settled.add(t)

        again = [t for t in tokens if t[1] < limit]
        anchors, first = self._anchor(again)
        if first is not None:
            settle(t for t in self.pending if t[1] < first)
            settle(self._voted(again))
        self.pending = [t for t in tokens if t[1] >= limit]
        self.settled.forget(row["start"] - REACH)
        self.votes = {k: n for k, n in self.votes.items() if k[1] >= 10 * (row["start"] - REACH)}
        return [{"anchors": anchors, "settled": out, "pending": [t[0] for t in self.pending]}]


def longest_run(a: list, b: list) -> tuple[int, int, int]:
    """Where the longest common run of two lists begins in each, and its length; the first of equals."""
    found = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    return (found.a, found.b, found.size) if found.size else (0, 0, 0)


@dataclass
class CommonRun:
    """Tokens by the longest run that two windows share: kept if it is long and in time, else the likelier side's is.

    With nothing pending a window is taken as it is.
    """

    frame_s: float = 0.08
    least: int = 3
    near_s: float = 0.15
    pending: list = field(default_factory=list)  # (id, time, weight)

    def _weighed(self, row: dict) -> list[tuple]:
        """Tokens with their log-probabilities, less sure towards a window's ends."""
        n = max(1, len(row["ids"]))
        ease = lambda i: math.exp(-((i - (n - 1) / 2) ** 2) / (2 * (n * 0.25) ** 2))
        return [(t, row["start"] + f * self.frame_s, p * ease(i)) for i, (t, f, p) in enumerate(zip(row["ids"], row["frames"], row["log_probs"]))]

    def _agreed(self, again: list) -> tuple[int, list]:
        """Length of the shared run, and what it settles of pending tokens."""
        ids = lambda some: [t[0] for t in some]
        a, b, n = longest_run(ids(self.pending), ids(again))
        if not n:
            return 0, self.pending
        before, mine, theirs = self.pending[:a], self.pending[a : a + n], again[b : b + n]
        timely = n >= self.least and all(abs(x[1] - y[1]) <= self.near_s for x, y in zip(mine, theirs))
        worth = lambda some: sum(t[2] for t in some)
        return n, before + (theirs if not timely and worth(theirs) > worth(mine) else mine)

    def step(self, row: dict) -> list[dict]:
        tokens, limit = self._weighed(row), row["start"] + row["overlap"]
        run, settled = 0, []
        if self.pending:
            run, settled = self._agreed([t for t in tokens if t[1] < limit])
            tokens = [t for t in tokens if t[1] >= limit]
        self.pending = tokens
        return [{"run": run, "settled": [t[0] for t in settled], "pending": [t[0] for t in tokens]}]


# Greedy decoders over logits given as data.


def best(values) -> int:
    """The first largest; NaN never wins."""
    top = None
    for i, v in enumerate(values):
        if v == v and (top is None or v > values[top]):
            top = i
    return top or 0


def decode_durations(frames: list, n_tokens: int, blank: int = 0, cap: int = 10, frame_s: float = 0.08) -> list[dict]:
    """frames: logits of tokens, then of durations. A blank emits nothing; each step moves by its duration."""
    at, emitted, out = 0, 0, []
    while at < len(frames):
        token, step = best(frames[at][:n_tokens]), best(frames[at][n_tokens:])
        if token != blank:
            end = min(len(frames), at + max(1, step))
            out.append({"id": token, "frame": at, "start_s": round(at * frame_s, 3), "end_s": round(end * frame_s, 3)})
            emitted += 1
        if step:
            at, emitted = at + step, 0
        elif token == blank or emitted >= cap:
            at, emitted = at + 1, 0
    return out


def decode_transducer(frames: list, blank: int = 0, cap: int = 10, frame_s: float = 0.08) -> list[dict]:
    """frames: for each frame the logits of its successive steps; up to cap tokens before a blank."""
    out = []
    for at, steps in enumerate(frames):
        for logits in steps[:cap]:
            token = best(logits)
            if token == blank:
                break
            out.append({"id": token, "frame": at, "start_s": round(at * frame_s, 3), "end_s": round(at * frame_s, 3)})
    return out


def decode_attention(steps: list, end: int, budget: int) -> tuple[list[int], bool]:
    """Tokens until end; whether the budget ran out before."""
    ids = []
    for logits in steps[:budget]:
        token = best(logits)
        if token == end:
            return ids, False
        ids.append(token)
    return ids, True
