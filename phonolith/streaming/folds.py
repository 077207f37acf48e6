"""State machines of speech streams, as plain folds: a state that pickles, and step(row) -> rows out.

Each runs per key, in order, the same in batch and in streaming (see runner.py). They hold bounded state: counters
and short histories, never the stream. Frames are integers; seconds are frames by rate.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field


def level(amplitude: float) -> float:
    return max(-100.0, 20 * math.log10(amplitude)) if amplitude and math.isfinite(amplitude) and amplitude > 0 else -100.0


@dataclass
class NoiseFloor:
    """Tracks a background level: quickly at first, slowly once silence is sure, slower still from rejected sounds."""

    start: float = 0.005
    fast: float = 0.15
    slow: float = 0.01
    sure_after: float = 1.0  # seconds of silence
    least: float = 1e-5
    floor: float = 0.0
    silence: float = 0.0
    quiet: deque = field(default_factory=lambda: deque(maxlen=64))
    rejected: deque = field(default_factory=lambda: deque(maxlen=64))

    def __post_init__(self) -> None:
        self.floor = self.floor or self.start

    @staticmethod
    def low_mean(seen: deque) -> float | None:
        """Mean of the lowest 60 of 100, at least one."""
        low = sorted(seen)[: max(1, int(len(seen) * 0.6))]
        return sum(low) / len(low) if low else None

    def background(self) -> float:
        a, b = self.low_mean(self.quiet), self.low_mean(self.rejected)
        return 0.8 * a + 0.2 * b if a is not None and b is not None else a if a is not None else b

    def observe(self, energy: float, seconds: float, rejected: bool = False) -> float:
        if not (math.isfinite(energy) and energy >= 0 and math.isfinite(seconds) and seconds > 0):
            return self.floor
        energy = max(self.least, energy)
        if rejected:
            self.silence = 0.0
            self.rejected.append(energy)
            rate = min(self.fast, self.slow) * 0.5
        else:
            self.silence += seconds
            self.quiet.append(energy)
            sure = self.sure_after <= 0 or self.silence >= self.sure_after
            rate = self.slow if sure else self.fast + (self.slow - self.fast) * self.silence / self.sure_after
        self.floor = max(self.least, self.floor * (1 - rate) + self.background() * rate)
        return self.floor

    def step(self, row: dict) -> list[dict]:
        return [{"floor": self.observe(row["energy"], row["seconds"], bool(row.get("rejected")))}]


@dataclass
class Hysteresis:
    """Speaking begins after `enter` speech hops and ends after `leave` hops below a lower threshold; in between both runs start anew."""

    threshold: float = 0.5
    offset: float = 0.15
    enter: int = 2
    leave: int = 4
    speaking: bool = False
    speech_run: int = 0
    silence_run: int = 0

    def step(self, row: dict) -> list[dict]:
        p = row["prob"]
        if p is not None and p >= self.threshold:
            self.speech_run, self.silence_run = self.speech_run + 1, 0
        elif p is None or math.isnan(p) or p < self.threshold - self.offset:
            self.speech_run, self.silence_run = 0, self.silence_run + 1
        else:
            self.speech_run = self.silence_run = 0
        if not self.speaking and self.speech_run >= self.enter:
            self.speaking = True
        elif self.speaking and self.silence_run >= self.leave:
            self.speaking = False
        return [{"speaking": self.speaking}]


@dataclass
class RoughGate:
    """Energy gate over analysis windows, one row out for each: candidates confirm into speech, silence ends it."""

    rate: int = 16000
    window_ms: float = 80.0
    smooth: int = 6
    threshold_db: float = -45.0
    snr_db: float | None = 6.0
    least_snr_db: float = 6.0  # below it speech has not begun; half of it is the noise floor
    speech_ms: float = 240.0
    silence_ms: float = 800.0
    lookback: int = 6
    default_lookback: int = 4
    active: bool = False
    speech: float = 0.0
    silent: float = 0.0
    frame: int = 0
    recent: deque = field(default_factory=lambda: deque(maxlen=6))
    history: deque = field(default_factory=lambda: deque(maxlen=24))
    pending: list = field(default_factory=list)
    noise: NoiseFloor = field(default_factory=NoiseFloor)

    def onset(self) -> int:
        """Where the energy began to rise, looking back from the newest window, a candidate.

        Rises count back to the nearest window near the noise floor, and `lookback` + 1 windows at most; the earliest
        counts. Without any: the window after the nearest one below the least SNR, else a fixed number back.
        """
        h, newest = list(self.history), len(self.history) - 1
        low = lambda limit: [i for i, x in enumerate(h) if self.snr_db is not None and x[2] < limit]
        back = max([0, newest - self.lookback - 1, *(i for i in low(self.least_snr_db / 2) if i < newest)])
        rises = [i for i in range(back, newest) if h[i + 1][1] > h[i][1] * 1.08]
        quiet = [min(newest, i + 1) for i in low(self.least_snr_db)[-1:]]
        return h[[*rises, *quiet, max(0, newest - self.default_lookback)][0]][0]

    def step(self, row: dict) -> list[dict]:
        """row: rms of one window."""
        seconds = self.window_ms / 1000
        self.recent.append(row["rms"])
        energy = sum(self.recent) / len(self.recent)
        snr = level(energy) - level(self.noise.floor)
        begin, start, end, onset = self.frame, False, False, None
        self.frame += round(self.window_ms / 1000 * self.rate)
        self.history.append((begin, energy, snr))
        candidate = level(energy) > self.threshold_db or (self.snr_db is not None and snr > self.snr_db)
        if candidate:
            self.silent = 0.0
            if not self.active:
                self.pending.append((energy, seconds))
                self.speech += self.window_ms
                if self.speech >= self.speech_ms:
                    onset, start, self.active = self.onset(), True, True
                    self.pending = []
        else:
            self.speech = 0.0
            if self.active:
                self.silent += self.window_ms
                if self.silent >= self.silence_ms:
                    end, self.active, self.silent = True, False, 0.0
            else:
                if self.pending:
                    total = sum(s for _, s in self.pending)
                    self.noise.observe(sum(e * s for e, s in self.pending) / total, total, rejected=True)
                    self.pending = []
                self.noise.observe(energy, seconds)
        return [{"frame": begin, "energy": energy, "snr": snr, "active": self.active, "start": start, "end": end, "onset": onset}]


@dataclass
class Detector:
    """Segments of speech from gate rows: opened before the onset, closed by silence or length."""

    rate: int = 16000
    preroll_ms: float = 680.0
    most_ms: float = 3600.0
    hop: int = 1280
    base: int = 0
    opened: int | None = None

    def open(self, onset: int) -> None:
        self.opened = max(self.base, onset - round(self.preroll_ms / 1000 * self.rate))

    def close(self, end: int, reason: str) -> dict:
        out = {"start_frame": self.opened, "end_frame": end, "reason": reason}
        self.base, self.opened = end, None
        return out

    def too_long(self, end: int) -> bool:
        return end - self.opened >= self.most_ms / 1000 * self.rate

    def step(self, row: dict) -> list[dict]:
        """row: a RoughGate's output."""
        end, out = row["frame"] + self.hop, []
        if self.opened is None and row["start"]:
            self.open(row["onset"] or 0)
        elif self.opened is not None:
            if self.too_long(end):
                out.append(self.close(end, "max-duration"))
                if row["active"]:
                    self.opened = end
            elif row["end"]:
                out.append(self.close(end, "silence"))
        return out

    def finish(self, end: int) -> list[dict]:
        return [self.close(end, "finish")] if self.opened is not None else []


@dataclass
class VoiceDetector(Detector):
    """Segments from the probabilities of an activity model, a row a hop, without the energy gate.

    A run of speech opens a segment at its start once it is `enter` hops long, and hops below the threshold for
    `leave` in a row close it. phase: listening, candidate (speech not sure yet, or silence not), speaking.
    """

    threshold: float = 0.5
    enter: int = 3
    leave: int = 5
    frame: int = 0
    run: int = 0
    quiet: int = 0
    phase: str = "listening"

    def step(self, row: dict) -> list[dict]:
        speech = row["prob"] is not None and row["prob"] >= self.threshold  # NaN isn't
        self.frame += self.hop
        self.run, self.quiet = (self.run + 1, 0) if speech else (0, self.quiet + 1)
        if self.opened is None:
            self.phase = "candidate" if speech else "listening"
            if self.run >= self.enter:
                self.open(self.frame - self.run * self.hop)
                self.phase = "speaking"
            return []
        if self.too_long(self.frame):
            out = self.close(self.frame, "max-duration")
            self.opened, self.phase = (self.frame, "speaking") if speech else (None, "listening")
            return [out]
        if self.quiet >= self.leave:
            self.phase = "listening"
            return [self.close(self.frame, "vad-silence")]
        self.phase = "speaking" if speech else "candidate"
        return []


@dataclass
class Hops:
    """Adapts an activity model to pushes of any size: samples gather to hops, each gets a probability.

    model: samples of a hop to a probability; it must pickle for streams.
    """

    model: Callable[[list], float]
    hop: int = 256
    held: list = field(default_factory=list)
    frame: int = 0

    def step(self, row: dict) -> list[dict]:
        self.held += list(row["samples"])
        out = []
        while len(self.held) >= self.hop:
            now, self.held = self.held[: self.hop], self.held[self.hop :]
            out.append({"frame": self.frame, "prob": min(1.0, max(0.0, float(self.model(now))))})
            self.frame += self.hop
        return out


@dataclass
class GatedDetector:
    """A gate and the detector behind it."""

    gate: RoughGate = field(default_factory=RoughGate)
    detector: Detector = field(default_factory=Detector)

    def step(self, row: dict) -> list[dict]:
        return [s for g in self.gate.step(row) for s in self.detector.step(g)]


@dataclass
class Accumulator:
    """Final texts are settled, partial ones replace the preview. A row emits what it settles; read in order that is the text."""

    revision: int = 0

    def step(self, row: dict) -> list[dict]:
        self.revision += 1
        text = (row["text"] or "").strip()
        return [{"revision": self.revision, "settled": text if row["final"] else "", "preview": "" if row["final"] else text}]


@dataclass
class RollingWindow:
    """Chunks of the last `most` seconds: whole old ones go, never below `overlap` seconds or one chunk."""

    most: float = 30.0
    overlap: float = 2.0
    chunks: deque = field(default_factory=deque)
    held: float = 0.0

    def step(self, row: dict) -> list[dict]:
        self.chunks.append((row["sequence"], row["seconds"]))
        self.held += row["seconds"]
        while self.held > self.most and len(self.chunks) > 1 and self.held - self.chunks[0][1] >= self.overlap:
            self.held -= self.chunks.popleft()[1]
        return [{"first": self.chunks[0][0], "last": row["sequence"], "seconds": self.held}]


@dataclass
class WindowBuilder:
    """The next stretch of a stream to transcribe: from the last settled place, not too short, not too long."""

    rate: int = 16000
    first_s: float = 1.5
    least_s: float = 3.0
    most_s: float = 30.0
    snap_s: float = 0.5
    cursor: int = 0
    ends: deque = field(default_factory=lambda: deque(maxlen=4))

    def mature(self, cursor: int, sentence_end: int | None = None) -> None:
        self.cursor = max(self.cursor, cursor)
        if sentence_end is not None:
            self.ends.append(sentence_end)

    def build(self, base: int, end: int, silence=None) -> tuple[int, int] | None:
        """Frames [start, end) or None. silence(a, b): the last silent place in a range, or None."""
        frames = lambda s: round(s * self.rate)
        if not self.cursor and not self.ends:
            return (base, min(end, base + frames(self.most_s))) if end - base >= frames(self.first_s) else None
        start = self.cursor or (self.ends[-2] if len(self.ends) > 1 else self.ends[-1])
        start = max(base, start)
        if end - start < frames(self.least_s):
            return None
        if end - start > frames(self.most_s):
            start = max(self.cursor, end - frames(self.most_s))
        if silence:
            place = silence(start, min(end, start + frames(self.snap_s)))
            if place is not None and place > start and end - place >= frames(self.least_s):
                start = place
        return start, end

    def step(self, row: dict) -> list[dict]:
        """row: base and end frames, and what has matured."""
        if row.get("cursor") is not None:
            self.mature(row["cursor"])
        found = self.build(row["base"], row["end"])
        return [{"start": found[0], "end": found[1]}] if found else []
