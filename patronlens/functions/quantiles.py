"""Exact order statistics and quantiles by counting.

Spark's exact ``percentile`` keeps every distinct value of a column in one task, and a sketch of a whole column ends in
one task as well. Here each round counts the values of a range in ``BUCKETS`` equal buckets, with the
least and the greatest value of each: an ordinary hash aggregate, combined in the map tasks, whose result has
``BUCKETS`` rows per range whatever the table. The bucket that holds the wanted rank is the next
range; a bucket of one distinct value is the answer. Values that lie over many powers of ten would fall into one bucket round after
round; so the bucket nearest to zero is cut once more, by powers of two. From the second round on a range spans a factor of 16 at
most, which holds fewer than 2^55 doubles, and six rounds of 1024 buckets part those: seven passes are enough for any values. All columns and ranks share the rounds, and
tables of any size take the same path. Missing values (null and NaN) are left out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
# Over twice the powers of two of a double, four a step.
SCALES = 2048
LARGEST = sys.float_info.max


@dataclass(frozen=True)
class Bounds:
    """How many values a column has, and between which values."""

    rows: int
    low: float | None
    high: float | None


@dataclass(frozen=True)
class _Span:
    """Values from ``low`` to ``high``; the least of them has rank ``first``."""

    name: str
    low: float
    high: float
    first: int
    ranks: tuple[int, ...]

    def bucket(self, value: Column) -> Column:
        """Never falls as the value rises; the two ends are in different buckets, unless their scales are."""
        half = 0.5 if math.isinf(self.high - self.low) else 1.0
        width = self.high * half - self.low * half
        place = (value * half - self.low * half) / width * BUCKETS
        linear = F.least(F.floor(place), F.lit(BUCKETS - 1)).cast("int")
        if not self.is_wide:
            return linear * SCALES
        nearest = F.lit(min(max(0.0, self.low), self.high))
        middle = F.least(F.floor((nearest * half - self.low * half) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        # Four powers of two a step; zero is between the signs.
        power = F.floor((F.log2(F.abs(value)) + 1080) / 4).cast("int")
        scale = F.when(value == 0, 0).otherwise(F.signum(value).cast("int") * power) + SCALES // 2
        return linear * SCALES + F.when(linear == middle, scale).otherwise(0)

    @property
    def is_wide(self) -> bool:
        """Whether the values lie on both sides of zero or span more than a factor of 16."""
        least, most = sorted((abs(self.low), abs(self.high)))
        return self.low <= 0 <= self.high or most / 16 > least

    def cell(self, value: Column, number: int) -> Column:
        inside = (value >= self.low) & (value <= self.high)
        return F.when(inside, F.struct(F.lit(number).alias("span"), self.bucket(value).alias("bucket"), value.alias("value")))


def _value(column: Column) -> Column:
    """A finite double, null where the value is missing; an infinite one becomes the largest."""
    value = column.cast("double")
    finite = F.greatest(F.least(value, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(value.isNotNull() & ~F.isnan(value), finite)


def column_bounds(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, Bounds]:
    """All bounds in one aggregate."""
    wanted = []
    for i, column in enumerate(columns.values()):
        value = _value(column)
        wanted += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"l{i}"), F.max(value).alias(f"h{i}")]
    row = df.agg(*wanted).first()
    return {name: Bounds(*row[3 * i : 3 * i + 3]) for i, name in enumerate(columns)}


def _open_or_answer(name, low, high, first, ranks, answers) -> list[_Span]:
    if not ranks:
        return []
    if low == high:
        whole = math.copysign(math.inf, low) if abs(low) == LARGEST else low
        answers.update({(name, rank): whole for rank in ranks})
        return []
    return [_Span(name, low, high, first, tuple(ranks))]


def _round(df: DataFrame, values: Mapping[str, Column], spans: Sequence[_Span]) -> list[tuple]:
    """``span, bucket, n, low, high`` in ascending order: one pass over the rows."""
    cells = F.array_compact(F.array(*[s.cell(values[s.name], i) for i, s in enumerate(spans)]))
    counted = (
        df.select(F.explode(cells).alias("c"))
        .groupBy("c.span", "c.bucket")
        .agg(F.count("*").alias("n"), F.min("c.value").alias("low"), F.max("c.value").alias("high"))
    )
    return sorted(map(tuple, counted.collect()))


def order_statistics(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    bounds: Mapping[str, Bounds] | None = None,
) -> dict[tuple[str, int], float]:
    """Values at 0-based ``ranks`` of the ascending values of each column.

    Pass a staged table: every round reads it again, three or four times for most columns and seven at most.
    """
    bounds = bounds or column_bounds(df, columns)
    values = {name: _value(column) for name, column in columns.items()}
    answers: dict[tuple[str, int], float] = {}
    spans: list[_Span] = []
    for name, some in ranks.items():
        found = bounds[name]
        spans += _open_or_answer(name, found.low, found.high, 0, sorted(set(some)), answers)
    while spans:
        counted = _round(df, values, spans)
        at = [s.first for s in spans]
        further: list[_Span] = []
        for number, _, n, low, high in counted:
            inside = [r for r in spans[number].ranks if at[number] <= r < at[number] + n]
            further += _open_or_answer(spans[number].name, low, high, at[number], inside, answers)
            at[number] += n
        spans = further
    return answers


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[Fraction | float | str]],
    columns: Mapping[str, Column] | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns; missing values are left out.

    ``wanted`` maps a name to probabilities (fractions keep ranks free of rounding); ``columns`` maps
    a name to an expression where it is not simply the column of that name.
    """
    columns = {name: (columns or {}).get(name, F.col(name)) for name in wanted}
    if not columns:
        return {}
    bounds = column_bounds(df, columns)
    positions = {
        name: [Fraction(str(p)) * (bounds[name].rows - 1) for p in probabilities] if bounds[name].rows else []
        for name, probabilities in wanted.items()
    }
    ranks = {
        name: sorted({int(p) for p in places} | {int(p) + 1 for p in places if p != int(p)})
        for name, places in positions.items()
    }
    found = order_statistics(df, columns, ranks, bounds)

    def interpolate(name: str, place: Fraction) -> float:
        rank = int(place)
        low = found[name, rank]
        if place == rank or found[name, rank + 1] == low:
            return low
        return low + (found[name, rank + 1] - low) * float(place - rank)

    return {
        name: [interpolate(name, place) for place in positions[name]] if bounds[name].rows else [None] * len(probabilities)
        for name, probabilities in wanted.items()
    }


def quantile_edges(df: DataFrame, bins: Mapping[str, int]) -> dict[str, list[float]]:
    """Distinct, ascending edges that cut each column into ``bins[name]`` equal-count bins."""
    wanted = {name: [Fraction(i, q) for i in range(q + 1)] for name, q in bins.items()}
    found = exact_quantiles(df, wanted)
    return {name: sorted({v for v in values if v is not None}) for name, values in found.items()}
