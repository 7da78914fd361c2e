"""Array-column arithmetic that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def doubles(col: ColumnLike) -> Column:
    """Promote a stored float vector before any sum."""
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def energy(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def not_finite(a: Column) -> Column:
    """True when any element is null, NaN or infinite."""
    return F.exists(
        a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )


def flatten_masked(field: Column, mask: Column) -> Column:
    """Keep the field values whose mask entry is true, in order."""
    kept = F.filter(F.arrays_zip(field.alias("v"), mask.alias("m")), lambda p: p["m"])
    return F.transform(kept, lambda p: p["v"])
