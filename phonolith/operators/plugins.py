"""A registry of what stays outside the engine: recognisers, activity models, tokenizers, as Column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .transcript import KEPT

#: The type of a kind's results, which apply() checks; None where a plug-in isn't a function of Columns.
CONTRACTS: dict[str, str | None] = {
    "backend": None,
    "family": None,
    "preset": None,
    "transcribe": "string",
    "activity": "double",
    "tokenizer": "array<int>",
    "timestamps": "array<struct<text:string,start_s:double,end_s:double,confidence:double>>",
    "confidence": "struct<utterance:double,words:double,tokens:double>",
    "rate_policy": "int",
    "cache_key": "string",
    "cache_size": "bigint",
    "normalizer": None,
}
KINDS = tuple(CONTRACTS)


class PluginError(LookupError):
    pass


@dataclass
class Plugins:
    """Functions of Columns, pandas UDFs among them, by kind and name."""

    known: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def register(self, kind: str, name: str, make: Callable) -> None:
        if kind not in KINDS:
            raise PluginError(f"no plug-ins of kind {kind!r}")
        if (kind, name) in self.known:
            raise PluginError(f"{kind} {name!r} is registered already")
        self.known[kind, name] = make

    def get(self, kind: str, name: str) -> Callable:
        if (kind, name) not in self.known:
            raise PluginError(f"no {kind} named {name!r}")
        return self.known[kind, name]

    def apply(self, df: DataFrame, kind: str, name: str, into: str, *columns: Column) -> DataFrame:
        """df with a plug-in's result; its type is checked as the plan is made, before any row is read."""
        if (want := CONTRACTS.get(kind)) is None:
            raise PluginError(f"{kind} plug-ins aren't functions of Columns")
        out = df.withColumn(into, self.get(kind, name)(*columns))
        got = out.schema[into].dataType.simpleString()
        if got != want:
            raise PluginError(f"{kind} {name!r} gives {got}, not {want}")
        return out

    def names(self, kind: str) -> list[str]:
        return [n for k, n in self.known if k == kind]

    def family(self, preset: str) -> tuple[str, dict[str, str]]:
        """The family that a preset names, and its plug-ins by kind; a preset's own ones come first.

        A preset gives (family, plug-ins by kind), a family its plug-ins by kind. Every plug-in must be registered.
        """
        name, own = self.get("preset", preset)()
        hooks = {**self.get("family", name)(), **own}
        for kind in STEPS:
            if kind not in hooks:
                raise PluginError(f"family {name!r} has no {kind} plug-in")
            self.get(kind, hooks[kind])
        return name, hooks

    def recognise(self, df: DataFrame, preset: str, samples: Column, into: str = "native") -> DataFrame:
        """df with the native transcript that a preset's plug-ins make of samples, one after the other.

        A text from samples and their rate; tokens from the text; timed words from text and seconds; confidence from
        the words. All are Column functions, pandas UDFs among them, so recognition is one stage of the scan.
        """
        name, hooks = self.family(preset)
        d = self.apply(df.withColumn("_x", samples), "rate_policy", hooks["rate_policy"], "_rate", F.col("_x"))
        d = self.apply(d, "transcribe", hooks["transcribe"], "_text", F.col("_x"), F.col("_rate"))
        d = self.apply(d, "tokenizer", hooks["tokenizer"], "_ids", F.col("_text"))
        d = self.apply(d, "timestamps", hooks["timestamps"], "_words", F.col("_text"), F.size("_x") / F.col("_rate"))
        d = self.apply(d, "confidence", hooks["confidence"], "_sure", F.col("_words"))
        fields = {"family": F.lit(name), "text": F.col("_text"), "tokens": F.col("_ids"), "words": F.col("_words"), "confidence": F.col("_sure")}
        return d.select(*df.columns, F.struct(*[c.alias(n) for n, c in fields.items()]).alias(into))


#: The kinds of plug-ins that recognise() needs, in its order.
STEPS = ("rate_policy", "transcribe", "tokenizer", "timestamps", "confidence")


def spread_words(text: Column, seconds: Column) -> Column:
    """A `timestamps` plug-in: the text's words, evenly spread over the recording, each as sure as it is short."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = seconds / F.size(words)
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), (i * step).alias("start_s"), ((i + 1) * step).alias("end_s"), (F.lit(1.0) / F.length(w)).alias("confidence")))


def mean_confidence(words: Column) -> Column:
    """A `confidence` plug-in: the mean of the words' confidences for words and utterance; null without words. Tokens have none."""
    mean = F.try_divide(F.aggregate(words, F.lit(0.0), lambda n, w: n + w["confidence"]), F.size(words))
    return F.struct(mean.alias("utterance"), mean.alias("words"), F.lit(None).cast("double").alias("tokens"))


@dataclass(frozen=True)
class Normalizer:
    """A family's canonical form of a native transcript as recognise() gives it."""

    id: str

    def to_canonical(self, native: Column, detail: str = "words") -> Column:
        """Text, segments and words at a level of detail, and their confidences; arrays that a level lacks, and empty ones, are null."""
        words = native["words"]
        span = F.array(F.struct(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.get(words, F.lit(0))["start_s"].alias("start_s"), F.element_at(words, -1)["end_s"].alias("end_s"), native["confidence"]["words"].alias("confidence")))
        kept = {n: F.when((F.size(words) > 0) & F.lit(detail).isin(*KEPT[n]), a).alias(n) for n, a in (("segments", span), ("words", words))}
        return F.struct(native["text"].alias("text"), native["family"].alias("family"), F.lit(self.id).alias("normalizer"), *kept.values(), native["confidence"].alias("confidence"))

    def to_envelope(self, native: Column, detail: str = "words") -> Column:
        """The canonical form beside the native one."""
        return F.struct(self.to_canonical(native, detail).alias("canonical"), native.alias("native"))
