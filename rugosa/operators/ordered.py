"""Running sums along an order, for groups of any size: no group has to fit in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running_sums(rows: DataFrame, keys: tuple[str, ...], order: list[str], values: dict[str, str]) -> DataFrame:
    """rows with a column for each of values ({new name: column}): its sum over the rows of the same group that come before in the order.

    Rows are dealt by ranges of keys and order and sorted; a part's own running sums are taken within it, and
    the sums of a group's earlier parts, one row a group and part, are added. Rows equal in all of keys and
    order stay in any one order among themselves.
    """
    sort = [*keys, *order]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    own = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({name: F.sum(c).over(own) for name, c in values.items()})
    parts = dealt.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_{name}") for name, c in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.withColumns({f"_{name}": F.sum(f"_{name}").over(earlier) for name in values})
    both = inside.alias("i").join(parts.alias("p"), F.expr(" AND ".join(["i._part = p._part", *(f"i.{k} <=> p.{k}" for k in keys)])))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*(F.col(f"i.{c}") for c in rows.columns), *((zero(F.col(f"i.{n}")) + zero(F.col(f"p._{n}"))).alias(n) for n in values))
