"""Catalogues of models, backends and files as DataFrames: criteria, ranking, preferences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed orders: of quantisations in listings, and of preference by component and backend.
MODES = ("fp32", "fp16", "int8")
ON_GPU, ELSEWHERE = ("fp16", "fp32", "int8"), ("int8", "fp32", "fp16")
SUFFIX = {"fp32": ".onnx", "fp16": ".fp16.onnx", "int8": ".int8.onnx"}
ACCELERATION = ("npu", "gpu", "hybrid")


class BackendError(LookupError):
    """No backend is registered, available, or fits."""


@dataclass(frozen=True)
class Criteria:
    precision: str | None = None
    environment: str | None = None
    shared_buffer: bool = True  # may be needed
    experimental: bool = False  # may be chosen


def matches(c: Criteria) -> Column:
    ok = F.col("available")
    if not c.experimental:
        ok = ok & ~F.col("experimental")
    if c.precision:
        ok = ok & F.array_contains("precisions", c.precision)
    if c.environment:
        ok = ok & F.array_contains("environments", c.environment)
    return ok if c.shared_buffer else ok & ~F.col("shared_buffer")


def ranked(backends: DataFrame, preferred: list[str], precision: str | None = None, declared: bool = False) -> DataFrame:
    """backends with their rank: by preference, then registration; declared adds all written keys in between.

    A catalogue is small; its ranking is one window over it.
    """
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("id")) if preferred else F.lit(0)
    keys = [F.when(place > 0, place).otherwise(len(preferred) + 1)]
    if declared:
        if precision:
            keys.append(F.when(F.array_contains("precisions", precision), 0).otherwise(1))
        fast = F.coalesce(*[F.when(F.array_contains("acceleration", a), i) for i, a in enumerate(ACCELERATION)], F.lit(len(ACCELERATION)))
        keys += [fast, F.col("shared_buffer"), ~F.col("fallback"), F.col("priority").desc()]
    return backends.withColumn("rank", F.row_number().over(Window.orderBy(*keys, "reg")).cast("long"))


def choice(backends: DataFrame, c: Criteria, preferred: list[str]) -> DataFrame:
    """The best backend's row, none if none fits."""
    return ranked(backends.filter(matches(c)), preferred).filter("rank = 1")


def select(backends: DataFrame, c: Criteria, preferred: list[str]) -> str:
    """The best backend's id; an error says what is missing."""
    n, up = backends.agg(F.count("*"), F.count_if("available")).first()
    if not n:
        raise BackendError("no backend is registered")
    if not up:
        raise BackendError("no backend is available")
    best = choice(backends, c, preferred).first()
    if best is None:
        raise BackendError(f"no backend fits {c}")
    return best["id"]


def quantisations(files: Column, base: str) -> Column:
    """Modes that a listing offers for a model file, in fixed order; fp32 if none."""
    has = lambda name: F.exists(files, lambda f: (f == name) | f.endswith(f"/{name}"))
    found = F.filter(F.array(*[F.when(has(base + SUFFIX[m]), m) for m in MODES]), lambda m: m.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("fp32")))


def preferred(modes: Column, backend: str, component: str = "encoder") -> Column:
    """The first preferred mode that is offered, else the first offered, else fp32."""
    order = ON_GPU if component != "decoder" and backend.startswith("webgpu") else ELSEWHERE
    return F.coalesce(*[F.when(F.array_contains(modes, m), m) for m in order], F.get(modes, F.lit(0)), F.lit("fp32"))


def first_provider(can: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(c, name) for name, c in can.items()])


def named(wanted: str, id_column: str, aliases: str) -> Column:
    key = wanted.strip().lower()
    return (F.lower(id_column) == key) | F.exists(aliases, lambda a: F.lower(a) == key)


def repo_path(path: Column) -> Column:
    """Path parts percent-encoded, empty ones dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def snap(v: Column, low: float, high: float, step: float) -> Column:
    """A control's value inside its limits, on its grid from the lower one."""
    inside = F.least(F.lit(high), F.greatest(F.lit(low), v))
    return F.least(F.lit(high), F.greatest(F.lit(low), low + F.floor((inside - low) / step + 0.5) * step))


def with_settings(df: DataFrame, name: str, known: list[dict], own: dict[str, Column], grid: float, free: tuple[str, ...] = ()) -> DataFrame:
    """df with the settings of the profile it names, a bounded list of them; a row's own values come first.

    All but the free ones are raised to the grid, one step at least. Rows that name no known profile have nulls.
    """
    if unknown := set(own) - set(known[0]):
        raise ValueError(f"no settings {sorted(unknown)}")
    settings = [c for c in known[0] if c != name]
    of = F.get(F.filter(F.array(*[F.struct(F.lit(p[name]).alias("_of"), *[F.lit(float(p[c])).alias(c) for c in settings]) for p in known]), lambda p: p["_of"] == F.col(name)), F.lit(0))
    d = df.withColumn("_p", of)

    def value(c: str) -> Column:
        v = F.coalesce(own[c].cast("double"), F.col(f"_p.{c}")) if c in own else F.col(f"_p.{c}")
        v = v if c in free else F.greatest(F.lit(grid), F.ceil(v / grid) * grid)
        return F.when(F.col("_p").isNotNull(), v).alias(c)

    return d.select(*df.columns, *map(value, settings))
