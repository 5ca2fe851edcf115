"""Vertical partitioning: prefixes are grouped by a memory budget, and each group is worked on alone.

A prefix is known by a 64-bit hash. One that weighs more than the budget is cut into its longer prefixes by the
caller; the others are put into groups here: the space of hashes is cut into cells, and consecutive cells are packed
until the budget is full. The driver sees one number a cell (4 million at most), whatever the number of prefixes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

MOST_CELL_BITS = 22


def budget_of(spark: SparkSession, total: int, most: int, least: int = 1) -> int:
    """Weight of a group: ``most`` (what a task's memory holds), or less, but ``least``, so that there are four groups a partition."""
    return min(most, max(least, -(-total // (4 * partitions(spark)))))


def cell_bits(budget: int, total: int) -> int:
    """Leading bits of a hash that make its cell: some 16 to 32 cells a group, 4 million at most."""
    return min(MOST_CELL_BITS, max(10, (16 * -(-total // budget)).bit_length()))


def sums(weights: DataFrame, bits: int) -> np.ndarray:
    """The weight of each cell, from rows (cell, n)."""
    found = weights.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[np.asarray(found.column("cell"), np.int64)] = np.asarray(found.column("n"), np.int64)
    return out


def packed(cells: np.ndarray, budget: int) -> np.ndarray:
    """The first cell of each group: consecutive cells until the budget is full."""
    starts, load = [0], 0
    for at, n in zip(np.flatnonzero(cells).tolist(), cells[cells > 0].tolist(), strict=True):
        if load and load + n > budget:
            starts.append(at)
            load = 0
        load += n
    return np.array(starts, np.int64)


def grouped(weights: DataFrame, budget: int, total: int) -> tuple[int, np.ndarray]:
    """From ``weights`` (p, n): how far to shift a hash to get its cell, and the first cell of each group."""
    bits = cell_bits(budget, total)
    return 64 - bits, packed(sums(weights.select(F.expr(f"shiftrightunsigned(p, {64 - bits})").alias("cell"), "n"), bits), budget)


def group_of(p: np.ndarray, shift: int, starts: np.ndarray) -> np.ndarray:
    """The group of each prefix hash."""
    return np.searchsorted(starts, (p >> np.uint64(shift)).astype(np.int64), side="right") - 1
