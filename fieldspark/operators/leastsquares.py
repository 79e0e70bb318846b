"""Linear models from sums: one aggregate over the rows, one small solve on the driver.

What a linear model needs of its rows are, for every two columns, the number of rows that have both,
and the sums of each and of their product over those rows. These moments add up, so models of groups, of
all groups, and of all groups but one come from one pass. Null and NaN inputs count as their column's mean.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: A column whose variance is below this share of its mean square is taken as constant.
CONSTANT = 1e-9


@dataclass(frozen=True)
class LinearFit:
    """``base`` is the mean of the labels, the prediction where every input is at its mean."""

    rows: int
    base: float
    weights: Mapping[str, float]
    means: Mapping[str, float]

    def prediction(self) -> Column:
        return prediction(
            F.lit(self.base),
            {c: (F.lit(w), F.lit(self.means[c])) for c, w in self.weights.items()},
        )


def prediction(base: Column, terms: Mapping[str, tuple[Column, Column]]) -> Column:
    """``base`` plus weight times distance from the mean, for each input that is there."""
    total = base
    for name, (weight, mean) in terms.items():
        total = total + F.coalesce(weight * (_value(name) - mean), F.lit(0.0))
    return total


def _value(name: str) -> Column:
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by…, i, j, n, si, sj, sij) for each pair i <= j: rows that have both columns, and the sums of the
    one, the other and their product over them. Column 0 is the constant 1, the others count from 1.

    A row becomes a pair of numbers for each pair of its columns that are not null; they are
    summed before they are moved, so what is shuffled depends on columns and groups only.
    """
    values = [F.lit(1.0), *map(_value, columns)]
    entries = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("x")) for k, v in enumerate(values)))
    rows = df.select(*by, F.filter(entries, lambda e: e["x"].isNotNull()).alias("_e"))
    first = rows.select(*by, "_e", F.explode("_e").alias("_a"))
    both = first.select(*by, "_a", F.explode(F.filter("_e", lambda e: e["k"] >= F.col("_a.k"))).alias("_b"))
    a, b = F.col("_a.x"), F.col("_b.x")
    return both.groupBy(*by, F.col("_a.k").alias("i"), F.col("_b.k").alias("j")).agg(
        F.count("*").alias("n"), F.sum(a).alias("si"), F.sum(b).alias("sj"), F.sum(a * b).alias("sij")
    )


class Moments:
    """Collected moments of one set of rows; sets add up and subtract."""

    def __init__(self, sums: Mapping[tuple[int, int], np.ndarray] | None = None):
        self.sums: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(4), sums or {})

    @classmethod
    def of(cls, rows: Iterable[Row]) -> Moments:
        return cls({(r["i"], r["j"]): np.array([r["n"], r["si"], r["sj"], r["sij"]], float) for r in rows})

    def plus(self, other: Moments, sign: int = 1) -> Moments:
        keys = self.sums.keys() | other.sums.keys()
        return Moments({k: self.sums.get(k, np.zeros(4)) + sign * other.sums.get(k, np.zeros(4)) for k in keys})

    def fit(self, columns: Sequence[str], inputs: Sequence[str], label: str, ridge: float) -> LinearFit | None:
        """The least squares of ``label`` by ``inputs`` with a penalty ``ridge`` on the inputs' correlation
        matrix; None without rows. ``columns``: those the moments were taken of. The label has no nulls."""
        at = {c: k for k, c in enumerate(columns, 1)}
        y = at[label]
        rows = int(self.sums[0, 0][0])
        if not rows:
            return None

        def mean(k: int) -> float:
            n, _, total, _ = self.sums[0, k]
            return float(total / n) if n else 0.0

        def spread(i: int, j: int) -> float:
            """Sum of products of the distances from the means; a filled-in mean adds nothing."""
            n, si, sj, sij = self.sums[min(i, j), max(i, j)]
            mi, mj = mean(min(i, j)), mean(max(i, j))
            return sij - mi * sj - mj * si + n * mi * mj

        own = {c: spread(at[c], at[c]) for c in inputs}
        used = [c for c in inputs if own[c] > CONSTANT * self.sums[at[c], at[c]][3]]
        weights = dict.fromkeys(inputs, 0.0)
        if used:
            unit = np.array([math.sqrt(own[c]) for c in used])
            matrix = np.array([[spread(at[a], at[b]) for b in used] for a in used]) / np.outer(unit, unit)
            matrix[np.diag_indices(len(used))] = 1 + ridge
            half = np.linalg.cholesky(matrix)
            right = np.array([spread(at[c], y) for c in used]) / unit
            solved = np.linalg.solve(half.T, np.linalg.solve(half, right)) / unit
            weights |= dict(zip(used, solved.tolist(), strict=True))
        return LinearFit(rows, mean(y), weights, {c: mean(at[c]) for c in inputs})


def collected(frame: DataFrame, by: Sequence[str]) -> dict[tuple, Moments]:
    """Moments by group: some hundred numbers for each, whatever the number of rows."""
    groups: dict[tuple, list[Row]] = defaultdict(list)
    for r in frame.collect():
        groups[tuple(r[c] for c in by)].append(r)
    return {key: Moments.of(rows) for key, rows in groups.items()}
