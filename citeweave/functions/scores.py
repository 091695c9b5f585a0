"""Ranking signals and guarded arithmetic as columns. The current year is always a parameter."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WEIGHTS = {"embedding": 0.50, "recency": 0.20, "citation": 0.25, "author": 0.05, "velocity": 0.0}
HALF_LIFE = 4.0
MISSING = 0.3


def number(c: Column, default: float | None = None) -> Column:
    """Text as a double; `default` where blank, null or no number."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(x, F.lit(default).cast("double"))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b; default where b is 0 or null."""
    return F.when(b.isNull() | (b == 0), F.lit(default)).otherwise(a / b)


def year_of(c: Column) -> Column:
    """The first 19xx or 20xx in c, else null."""
    return F.regexp_extract(c.cast("string"), r"((19|20)[0-9]{2})", 1).try_cast("int")


def recency(year: Column, as_of: int, half_life: float = HALF_LIFE) -> Column:
    y = year_of(year)
    return F.when(y.isNull(), F.lit(MISSING)).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (F.lit(as_of) - y).cast("double")) / max(half_life, 1e-9)))


def citation(cites: Column) -> Column:
    c = cites.cast("double")
    return F.when(c.isNull() | (c < 0), F.lit(MISSING)).otherwise(F.least(F.lit(1.0), F.log1p(c) / math.log1p(500)))


def velocity(cites: Column, year: Column, as_of: int, library: Column | None = None) -> Column:
    y = year_of(year)
    lib = F.lit(0.0) if library is None else F.coalesce(library.cast("double"), F.lit(0.0))
    total = F.greatest(F.lit(0.0), F.coalesce(cites.cast("double"), F.lit(0.0)) + 5.0 * lib)
    rate = total / F.greatest(F.lit(1.0), (F.lit(as_of) - y).cast("double"))
    return F.when(y.isNull(), F.lit(MISSING)).otherwise(F.least(F.lit(1.0), F.log1p(rate) / math.log1p(50)))


def author(most: Column) -> Column:
    """From the frequency of the paper's most frequent author."""
    return F.when(most.isNull() | (most <= 0), F.lit(MISSING)).otherwise(F.least(F.lit(1.0), F.log1p(most.cast("double")) / math.log1p(10)))


@dataclass(frozen=True)
class Weights:
    """Weights of the signals: embedding, recency, citation and author are required, velocity may be given."""

    values: dict[str, float]

    def __post_init__(self):
        lacking = {"embedding", "recency", "citation", "author"} - set(self.values)
        if lacking:
            raise ValueError(f"missing weights: {sorted(lacking)}")
        if any(w < 0 for w in self.values.values()) or not sum(self.values.values()) > 0:
            raise ValueError("weights must not be negative or all zero")

    def without(self, signal: str) -> "Weights":
        """signal at 0, the others scaled to sum 1."""
        rest = {k: 0.0 if k == signal else v for k, v in self.values.items()}
        total = sum(rest.values())
        return Weights({k: v / total for k, v in rest.items()})


def normalised(weights: dict[str, float], fallback: dict[str, float] = WEIGHTS) -> dict[str, float]:
    """Weights clamped at 0 and divided by their sum, to 4 decimals; the fallback where the sum is 0."""
    w = {k: max(0.0, float(v)) for k, v in weights.items()}
    total = sum(w.values())
    return {k: round(v / total, 4) for k, v in w.items()} if total > 0 else dict(fallback)


def combined(weights: Weights) -> Column:
    """The weighted sum of the signal columns."""
    return sum((F.lit(float(w)) * F.col(k) for k, w in weights.values.items()), F.lit(0.0))


def trajectory(counts: Column, total: Column) -> Column:
    """The label of yearly citation counts, array<struct<year, n>>."""
    c = F.array_sort(counts, lambda a, b: F.when(a["year"] < b["year"], -1).when(a["year"] > b["year"], 1).otherwise(0))
    n = F.size(c)
    last, prev = F.element_at(c, -1)["n"], F.when(n >= 2, F.try_element_at(c, F.lit(-2))["n"]).otherwise(0)
    older = F.aggregate(F.slice(c, 1, F.greatest(n - 2, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return (
        F.when(counts.isNull() | total.isNull() | (F.size(counts) == 0), "unknown")
        .when(n < 2, F.when(total > 20, "growing").otherwise("new_or_sparse"))
        .when((prev == 0) & (last > 5), "exploding")
        .when((prev > 0) & (last / prev >= 2.0) & (last >= 5), "exploding")
        .when((prev > 0) & (last / prev >= 1.3), "growing")
        .when((last >= prev * 0.85) & (last >= 3), "stable")
        .when((last < prev * 0.5) & (older > last), "declining")
        .when(total < 5, "dormant")
        .otherwise("stable")
    )


def geometry_class(m: Column, delta: Column, r2: Column) -> Column:
    """The discovery mode of a paper against its references."""
    rest = 1.0 - r2
    return (
        F.when((rest >= 0.45) | (F.sqrt(F.greatest(F.lit(0.0), rest)) >= 0.67), "Paradigm Shift / Subspace Outlier")
        .when(delta >= 0.05, "High Synergy Cone Blend")
        .when(delta >= 0.02, "Moderate Synthesis")
        .when(m >= 0.60, "Linear / Incremental Extension")
        .otherwise("Diffused Reference Combination")
    )


def typology(m: Column, delta: Column, r2: Column, chance: Column, spread: Column) -> Column:
    """A hint at what kind of paper the profile shows; unknown where a measure is null."""
    return (
        F.when(m.isNull() | delta.isNull() | r2.isNull(), "unknown")
        .when(chance.isNotNull() & (r2 < chance + 0.05), "near_chance")
        .when((m >= 0.75) & (delta < 0.05), "extension_like")
        .when((delta >= 0.08) & (F.coalesce(spread, F.lit(0.0)) >= 0.25), "blend_like")
        .when(r2 < 0.35, "outlier_like")
        .otherwise("mixed")
    )
