"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963985


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is null or 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def micro(x: Column) -> Column:
    """A double as whole millionths, for exact comparison between engines."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("long")


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a proportion, within 0..1; (0, 1) where n is 0."""
    p = share(hits, n)
    nn = n.cast("double")
    z2 = F.lit(z * z)
    centre = (p + z2 / (2 * nn)) / (1 + z2 / nn)
    half = F.lit(z) * F.sqrt(p * (1 - p) / nn + z2 / (4 * nn * nn)) / (1 + z2 / nn)
    empty = n == 0
    return (
        F.when(empty, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half)),
        F.when(empty, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half)),
    )
