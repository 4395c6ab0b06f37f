"""Scalar expressions that the queries share; all of them stay in Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(value: Column, fallback: str) -> Column:
    """Trimmed text, or the fallback where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(fallback))


def finite(value: Column, default: float = -1.0) -> Column:
    """A number from text or number; what is missing, NaN or infinite is the default."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number).otherwise(F.lit(default))


def clamp(value: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def formula_guard(value: Column) -> Column:
    """Text that a spreadsheet would run gets an apostrophe in front."""
    return F.when(F.ltrim(value).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def first_match(value: Column, cases: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that a lower-cased text matches."""
    out = F.lit(default)
    for pattern, label in reversed(cases):
        out = F.when(F.lower(value).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def steps(value: Column, cuts: Sequence[tuple[float, int]], default: int = 0) -> Column:
    """The mark of the first threshold, from the highest, that a value reaches."""
    out = F.lit(default)
    for least, mark in sorted(cuts):
        out = F.when(value >= least, F.lit(mark)).otherwise(out)
    return out


def fold(digest: Column, folds: int = 5) -> Column:
    """A fold from the first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, least: float = 1e-12) -> Column:
    """An array over its length, which counts as ``least`` at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / norm)


def failed_reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules whose condition holds, in order, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])), ";")


def count_map(keys: Column, counts: Column) -> Column:
    """JSON of a map from keys to counts, sorted by key; an aggregate."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(keys, counts)))))
