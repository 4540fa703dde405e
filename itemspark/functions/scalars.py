"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_likelihood(y: Column, p: Column) -> Column:
    """Bernoulli log-probability of ``y``; ``p`` is kept off 0 and 1."""
    inside = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), p))
    return y * F.log(inside) + (F.lit(1) - y) * F.log(F.lit(1.0) - inside)


def fixed(x: Column, digits: int = 6) -> Column:
    """Round half up and turn -0.0 into 0.0, so results compare as values."""
    return F.round(x, digits) + F.lit(0.0)


def dot(left: list[Column], right: list[Column]) -> Column:
    return reduce(add, [a * b for a, b in zip(left, right)])


def hash_text(keys: list[str], seed: int) -> Column:
    """md5 of the key columns and the seed: a reproducible random order."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_uniform(keys: list[str], seed) -> Column:
    """A reproducible uniform number in (0, 1) per key and seed."""
    bits = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hash_normal(keys: list[str], seed) -> Column:
    """A reproducible standard normal number per key (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(hash_uniform(keys, seed)))
    return radius * F.cos(F.lit(6.283185307179586) * hash_uniform(keys, f"{seed}-angle"))


def shorten(text: Column, width: int, mark: str = "...") -> Column:
    """The first ``width`` characters, with ``mark`` appended when text was cut."""
    cut = F.substring(text, 1, width)
    return F.when(F.length(text) > width, F.concat(cut, F.lit(mark))).otherwise(text)


def title_words(label: Column) -> Column:
    """``dyck_language`` -> ``Dyck Language``, ``gsm8k`` -> ``Gsm8K``: every letter that
    follows no letter is upper case, the others lower case."""
    runs = F.regexp_extract_all(F.lower(F.replace(label, F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def loading_band(loading: Column, high: float = 0.3, low: float = 0.2) -> Column:
    size = F.abs(loading)
    return F.when(size >= high, "high").when(size < low, "low").otherwise("middle")


# Lower bounds and names of the sampling-adequacy bands.
ADEQUACY_BANDS = [(0.9, "Marvelous"), (0.8, "Meritorious"), (0.7, "Middling"),
                  (0.6, "Mediocre"), (0.5, "Miserable")]


def adequacy_band(kmo: Column) -> Column:
    out = F.when(kmo.isNull(), F.lit(None).cast("string"))
    for bound, name in ADEQUACY_BANDS:
        out = out.when(kmo >= bound, name)
    return out.otherwise("Unacceptable")


def finite_or_null(x: Column) -> Column:
    """NaN and both infinities become NULL."""
    infinite = F.abs(x) == F.lit(float("inf"))
    return F.when(~F.isnan(x) & ~infinite, x)


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(finite_or_null(x), F.lit(0.0))
