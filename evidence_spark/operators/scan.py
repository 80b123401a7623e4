"""Running sums and maxima of hot keys in two levels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(rows: DataFrame, keys: list[str], position: str, found: Mapping[str, tuple[str, Column]], before: bool = False, segment: int | None = None) -> DataFrame:
    """Adds to each row the sums or maxima of its key's rows up to its own; with `before`, of those before it.

    `found`: name -> ("sum" or "max", column). Keys are not null; positions are numbers, unlike within a key. Without `segment` a key's
    rows pass through one task, sorted and one at a time; several calls with the same keys share one shuffle.
    With it, a key's positions are cut into segments: a row's value is that of its segment so far and that of all segments
    before, which come from one row for each segment. So the rows of a key, however many, go to a task for each
    segment; `rows` is read twice, so write it first if it is dear.
    """
    make = {"sum": F.sum, "max": F.max}
    end = -1 if before else 0
    if segment is None:
        so_far = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, end)
        return rows.withColumns({name: make[kind](column).over(so_far) for name, (kind, column) in found.items()})
    at = "_segment"
    cut = rows.withColumn(at, F.floor(F.col(position) / segment))
    totals = cut.groupBy(*keys, at).agg(*[make[kind](column).alias(name) for name, (kind, column) in found.items()])
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, at, *[make[kind](name).over(earlier).alias(f"_carried_{name}") for name, (kind, _) in found.items()])
    inside = Window.partitionBy(*keys, at).orderBy(position).rowsBetween(Window.unboundedPreceding, end)
    made = cut.withColumns({f"_inside_{name}": make[kind](column).over(inside) for name, (kind, column) in found.items()}).join(carried, [*keys, at])
    out = {}
    for name, (kind, _) in found.items():
        one, other = F.col(f"_inside_{name}"), F.col(f"_carried_{name}")
        # a maximum of structs has no greatest(), so the later one of two is taken: it is the inner one unless there is none or it is less
        out[name] = F.coalesce(one + other, one, other) if kind == "sum" else F.when(one.isNull() | (other > one), other).otherwise(one)
    return made.withColumns(out).select(*rows.columns, *found)
