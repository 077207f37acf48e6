"""Folds of a live session: sample ring, resampler, layered buffer, transcriber and controller; settings of detectors."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, fields, replace

from .folds import Accumulator, WindowBuilder
from .mergers import Utterances


class StreamError(ValueError):
    """A stream was read or fed out of order."""


@dataclass
class Ring:
    """The newest `capacity` samples by absolute frame."""

    capacity: int
    samples: deque = field(default_factory=deque)
    end: int = 0

    @property
    def base(self) -> int:
        return self.end - len(self.samples)

    def write(self, samples: list) -> None:
        self.samples.extend(samples[-self.capacity :])
        self.end += len(samples)
        while len(self.samples) > self.capacity:
            self.samples.popleft()

    def read(self, start: int, end: int) -> list:
        if start < self.base:
            raise StreamError(f"frame {start} is overwritten; the first is {self.base}")
        if end > self.end:
            raise StreamError(f"frame {end} isn't written; the last is {self.end}")
        return [self.samples[i - self.base] for i in range(start, end)]

    def step(self, row: dict) -> list[dict]:
        self.write(list(row["samples"]))
        return [{"base": self.base, "end": self.end}]


@dataclass
class Resampler:
    """Linear resampling over pushes into chunks of `size`; the place between samples is carried along."""

    ratio: float  # input samples for one output sample
    size: int = 256
    held: list = field(default_factory=list)
    place: float = 0.0
    out: list = field(default_factory=list)
    frame: int = 0

    def step(self, row: dict) -> list[dict]:
        self.held += list(row["samples"])
        while self.place + 1 < len(self.held):
            i = int(self.place)
            self.out.append(self.held[i] + (self.held[i + 1] - self.held[i]) * (self.place - i))
            self.place += self.ratio
        gone = min(int(self.place), max(0, len(self.held) - 1))
        self.held, self.place = self.held[gone:], self.place - gone
        chunks = []
        while len(self.out) >= self.size:
            chunks.append({"frame": self.frame, "samples": self.out[: self.size]})
            self.out, self.frame = self.out[self.size :], self.frame + self.size
        return chunks


@dataclass
class Layers:
    """Chunks of the last `most` seconds, each with what was derived from it by layer name."""

    most: float = 30.0
    overlap: float = 2.0
    chunks: dict = field(default_factory=dict)  # sequence: (seconds, layers)

    def step(self, row: dict) -> list[dict]:
        kept = self.chunks.setdefault(row["sequence"], (row["seconds"], {}))
        kept[1].update(row.get("layers") or {})
        total = sum(s for s, _ in self.chunks.values())
        for sequence in sorted(self.chunks):
            seconds = self.chunks[sequence][0]
            if total <= self.most or len(self.chunks) == 1 or total - seconds < self.overlap:
                break
            total -= seconds
            del self.chunks[sequence]
        return [{"first": min(self.chunks), "last": max(self.chunks), "seconds": total}]


@dataclass
class Transcriber:
    """Partial texts as chunks come; the utterance is final at a long enough silence after speech. Then it is closed."""

    silence_ms: float = 350.0
    heard: bool = False
    closed: bool = False
    texts: Accumulator = field(default_factory=Accumulator)

    def step(self, row: dict) -> list[dict]:
        """row: text of the window so far, speech (or null), chunk_ms."""
        if self.closed:
            raise StreamError("the utterance is final")
        self.heard = self.heard or bool(row["speech"])
        final = self.heard and row["speech"] is False and row["chunk_ms"] >= self.silence_ms
        self.closed = final
        return [{"kind": "final" if final else "partial", **o} for o in self.texts.step({"text": row["text"], "final": final})]


@dataclass
class Controller:
    """Chooses what to transcribe next, merges what comes back, and settles an utterance at a silence."""

    silence_s: float = 0.8
    windows: WindowBuilder = field(default_factory=WindowBuilder)
    merger: Utterances = field(default_factory=Utterances)

    def step(self, row: dict) -> list[dict]:
        """row: base and end frames, words (text, start, end in seconds) of the window, silent seconds at the end."""
        found = self.windows.build(row["base"], row["end"])
        out = []
        if found:
            state = self.merger.process([tuple(w) for w in row["words"]])
            self.windows.mature(round(state["cursor"] * self.windows.rate))
            out.append({"kind": "partial", "start": found[0], "end": found[1], **state})
        if row["silence_s"] >= self.silence_s and self.merger.pending:
            out.append({"kind": "silence-finalize", "start": None, "end": None, **self.merger.finalize()})
        return out


CHUNK = 16


@dataclass(frozen=True)
class Profile:
    """Settings of a detector; times in milliseconds, on the grid of 16 ms."""

    name: str = "realtime"
    preroll: float = 680.0
    most: float = 3600.0
    threshold: float = 0.55
    speech: float = 240.0
    silence: float = 320.0
    hangover: float = 320.0
    lookback: float = 240.0

    def aligned(self) -> Profile:
        """Times raised to the grid, one chunk at least."""
        up = lambda v: max(CHUNK, -(-v // CHUNK) * CHUNK)
        return replace(self, **{f.name: up(getattr(self, f.name)) for f in fields(self) if f.name not in ("name", "threshold")})

    def merged(self, **changes) -> Profile:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"no settings {sorted(unknown)}")
        return replace(self, **{k: v for k, v in changes.items() if v is not None}).aligned()


PROFILES = {
    p.name: p.aligned()
    for p in (
        Profile(),
        Profile("generic", threshold=0.55, silence=320.0),
        Profile("aggressive", speech=160.0, threshold=0.42, silence=128.0),
        Profile("conservative", speech=240.0, threshold=0.60, silence=256.0, hangover=480.0),
    )
}
