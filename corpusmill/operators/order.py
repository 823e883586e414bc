"""Places in a global order without gathering rows: sorted ranges are counted, and each adds the counts of those before it;
single places are found by sketches and counts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def running_total(rows: DataFrame, order: list[Column | str], amount: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``, the sum of ``amount`` over the rows up to this one in the given order, of all rows or of each group.

    Rows are sorted once into ranges; a group of any size is spread over as many ranges as it fills. The order should tell all
    rows apart, or those that tie get their places in any order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"__order_{k}" for k in range(len(order))]
    ranged = rows.withColumns({**dict(zip(keys, order)), "__amount": amount}).orderBy(*by, *keys)
    ranged = stored(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__amount").alias("__sum"))  # a row for each range and group in it
    starts = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, "__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("__start") + F.sum("__amount").over(inside)
    return ranged.join(starts, [*by, "__range"]).withColumn(name, total).drop(*keys, "__amount", "__range", "__start")


#: Values that are gathered at once, at most; ranks by which a sketch may be off, as a share of the rows.
AT_ONCE, OFF = 50_000, 1e-4


class _Open(NamedTuple):
    """Values above ``low`` and below ``high``, either None where there is no such end: ``n`` of them, ``under`` rows lower."""

    low: object
    high: object
    under: int
    n: int

    def holds(self, value: Column) -> Column:
        return (F.lit(True) if self.low is None else value > F.lit(self.low)) & (F.lit(True) if self.high is None else value < F.lit(self.high))


def _narrower(part: _Open, at: int, lo: object, hi: object, counts: tuple[int, int, int, int]) -> _Open | tuple:
    """Where the place lies, by the counts below lo, at lo, between the two, and at hi: a narrower part, or (value,)."""
    under = part.under
    for n, low, high, value in zip((*counts, part.n - sum(counts)), (part.low, lo, lo, hi, hi), (lo, lo, hi, hi, part.high), (None, (lo,), None, (hi,), None)):
        if at < under + n:
            return value or _Open(low, high, under, n)
        under += n
    raise ValueError("counts don't add up: the values changed between two passes")


def values_at(values: DataFrame, column: str, places: Callable[[int], dict]) -> dict:
    """The values at some places in ascending order, exactly. ``places`` gives, from the number of values that aren't null,
    names and places counted from 0, few of them; names whose place is beyond the values are left out.

    Nothing is sorted as a whole: a sketch brackets each place by two values, a second pass counts below, at, between and above
    them, and so on within the part that holds the place, a few thousand times smaller each time, until it has at most
    ``AT_ONCE`` values. What a sketch can't tell apart is put in order by sorted ranges.
    """
    rows = stored(values.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")), "values")
    total, value, found = rows.count(), F.col("value"), {}
    left = {name: (at, _Open(None, None, 0, total)) for name, at in places(total).items() if 0 <= at < total}
    while wide := {name: x for name, x in left.items() if x[1].n > AT_ONCE}:
        share = lambda at, part, off: min(1.0, max(0.0, (at - part.under + off) / part.n))
        ends = lambda at, part: [share(at, part, -2 * OFF * part.n), share(at, part, 2 * OFF * part.n)]
        asked = list(wide.items())
        sketch = rows.agg(*(F.percentile_approx(F.when(part.holds(value), value), ends(at, part), int(1 / OFF)) for _, (at, part) in asked)).first()
        sums = []
        for (_, (_, part)), (lo, hi) in zip(asked, sketch):
            inside = part.holds(value)
            tests = (value < F.lit(lo), value == F.lit(lo), (value > F.lit(lo)) & (value < F.lit(hi)), (value == F.lit(hi)) & (value > F.lit(lo)))
            sums.append(F.array(*(F.count_if(inside & test) for test in tests)))
        for (name, (at, part)), (lo, hi), counts in zip(asked, sketch, rows.agg(*sums).first()):
            part_at = _narrower(part, at, lo, hi, counts)
            if not isinstance(part_at, _Open):
                found[name] = part_at[0]
                del left[name]
            elif part_at.n == part.n:  # numbers too close for the sketch
                found[name] = _in_ranges(rows.filter(part.holds(value)), at - part.under)
                del left[name]
            else:
                left[name] = at, part_at
    if left:
        few = rows.agg(*(F.get(F.sort_array(F.collect_list(F.when(part.holds(value), value))), F.lit(at - part.under)) for at, part in left.values())).first()
        found |= dict(zip(left, few))
    return found


def _in_ranges(rows: DataFrame, at: int):
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    placed = running_total(counts, ["value"], F.col("n"), "end")
    return placed.filter((F.lit(at) < F.col("end")) & (F.lit(at) >= F.col("end") - F.col("n"))).first()["value"]


def medians(values: DataFrame, column: str) -> DataFrame:
    """(n, median): the middle value, or the mean of the two in the middle; null of nothing."""
    sizes = []

    def middle(n: int) -> dict:
        sizes.append(n)
        return {"low": (n - 1) // 2, "high": n // 2}

    found = values_at(values, column, middle)
    median = (float(found["low"]) + float(found["high"])) / 2 if found else None
    return values.sparkSession.createDataFrame([(sizes[0], median)], "n long, median double")
