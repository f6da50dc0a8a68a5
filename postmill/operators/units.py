"""Quantities recorded in different units, brought to one canonical unit.

Conversions are edges of a graph: an edge src -> dst with an affine function dst = a * src + b, a and b exact
fractions. Shortest compositions from every unit to the target are computed once on the driver (the graph holds
units, not data), every cycle is checked to compose to the identity, and the resulting table
(unit, target, mul_numer, mul_denom, add_numer, add_denom) is equi-joined to the values on the source unit.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.session import broadcast_if_small

#: A conversion table above this many units is joined by shuffle instead of broadcast.
MAX_BROADCAST_UNITS = 100_000

Affine = tuple[Fraction, Fraction]
IDENTITY: Affine = (Fraction(1), Fraction(0))

CONVERSION_SCHEMA = T.StructType(
    [
        T.StructField("unit", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("mul_numer", T.LongType(), False),
        T.StructField("mul_denom", T.LongType(), False),
        T.StructField("add_numer", T.LongType(), False),
        T.StructField("add_denom", T.LongType(), False),
        T.StructField("hops", T.IntegerType(), False),
    ]
)


def compose(first: Affine, then: Affine) -> Affine:
    """The affine function `then` after `first`."""
    return then[0] * first[0], then[0] * first[1] + then[1]


def inverse(f: Affine) -> Affine:
    return 1 / f[0], -f[1] / f[0]


class InconsistentUnits(ValueError):
    """Two paths between the same units give different conversions."""


class UnitGraph:
    """Units joined by affine conversions; each edge serves both ways."""

    def __init__(self, edges: Iterable[tuple[str, str, Fraction | int, Fraction | int]]):
        self.edges: dict[str, dict[str, Affine]] = defaultdict(dict)
        for src, dst, a, b in edges:
            f = (Fraction(a), Fraction(b))
            if f[0] == 0:
                raise ValueError(f"the conversion {src} -> {dst} can't be inverted")
            for x, y, g in ((src, dst, f), (dst, src, inverse(f))):
                if self.edges[x].get(y, g) != g:
                    raise InconsistentUnits(f"{x} -> {y} is given twice with different factors")
                self.edges[x][y] = g

    def compositions(self, target: str) -> dict[str, tuple[Affine, int]]:
        """Shortest composition unit -> target and its length, for every unit that reaches the target.

        Breadth-first from the target, ties by unit name. Every edge that is not on the search tree closes a
        cycle; its composition must agree with the tree's, else InconsistentUnits.
        """
        found: dict[str, tuple[Affine, int]] = {target: (IDENTITY, 0)}
        queue = deque([target])
        while queue:
            at = queue.popleft()
            to_target, hops = found[at]
            for other in sorted(self.edges[at]):
                via = compose(self.edges[other][at], to_target)
                if other not in found:
                    found[other] = (via, hops + 1)
                    queue.append(other)
                elif found[other][0] != via:
                    raise InconsistentUnits(f"{other} -> {target} differs by path: {found[other][0]} and {via}")
        return found

    def table(self, spark: SparkSession, targets: Iterable[str]) -> DataFrame:
        """The conversion table for the equi-join, one row per (unit, target)."""
        rows = [
            (unit, target, a.numerator, a.denominator, b.numerator, b.denominator, hops)
            for target in targets
            for unit, ((a, b), hops) in sorted(self.compositions(target).items())
        ]
        return spark.createDataFrame(rows, CONVERSION_SCHEMA)


def convert(df: DataFrame, conversions: DataFrame, target: str, values: dict[str, str], unit: str = "unit") -> DataFrame:
    """Add for each `values` item (input column -> output column) the amount in `target`, as decimal(38,6).

    Left equi-join on the source unit: a row whose unit is null or unknown keeps its columns and gets null
    amounts; null amounts stay null. The conversion table is broadcast when it has at most MAX_BROADCAST_UNITS
    rows. Columns of `df` may have any other names, those of the conversion table included.
    """
    chosen = conversions.filter(F.col("target") == target).select(
        F.col("unit").alias("__unit"), *(F.col(c).cast("decimal(20,0)").alias(f"__{c}") for c in ("mul_numer", "mul_denom", "add_numer", "add_denom"))
    )
    joined = df.join(broadcast_if_small(chosen, MAX_BROADCAST_UNITS), F.col(unit) == F.col("__unit"), "left")

    def amount(c: str) -> Column:
        scaled = (F.col(c).cast("decimal(18,6)") * F.col("__mul_numer")).cast("decimal(38,6)") / F.col("__mul_denom")
        return (scaled + F.col("__add_numer") / F.col("__add_denom")).cast("decimal(38,6)")

    return joined.select(*(df[c] for c in df.columns), *(amount(c).alias(out) for c, out in values.items()))
