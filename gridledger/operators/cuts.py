"""Windows over partitions of any size: rows are cut into ranges of their order, and what a range needs of those before
it is carried over its boundary. A partition with a third of all rows is then the work of many tasks: windows run
within (partition, range), and only one row a range is ordered by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of the order that a range spans.
SPAN = 1 << 16


def _cut(rows: DataFrame, on: Column, span: int) -> DataFrame:
    return rows.withColumn("_cut", F.floor(on.cast("double") / span).cast("long"))


def _met(rows: DataFrame, carried: DataFrame, partition: list[str]) -> DataFrame:
    """rows with what is carried to their range; partitions may be null."""
    names = {c: f"_of_{k}" for k, c in enumerate([*partition, "_cut"])}
    other = carried.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(other, same).drop(*names.values())


def previous(rows: DataFrame, partition: list[str], order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """rows with `name`: the value of the row before, by a numeric order that is unique within a partition; null for the first."""
    cut = _cut(rows, F.col(order), span)
    held = F.struct(F.col(value).alias("v"))  # so that a null value is still a row
    own = F.lag(held).over(Window.partitionBy(*partition, "_cut").orderBy(order))
    last = cut.groupBy(*partition, "_cut").agg(F.max_by(held, order).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*partition).orderBy("_cut"))).drop("_last")
    out = _met(cut.withColumn("_own", own), carried, partition)
    return out.withColumn(name, F.coalesce("_own", "_carried")["v"]).drop("_own", "_carried", "_cut")


def numbered(rows: DataFrame, partition: list[str], on: Column, order: list[Column], name: str, span: int = SPAN) -> DataFrame:
    """rows with `name`: their place, from 1, within the partition by `order`, which `on`, a number, rises with."""
    cut = _cut(rows, on, span)
    within = F.row_number().over(Window.partitionBy(*partition, "_cut").orderBy(*order))
    n = cut.groupBy(*partition, "_cut").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*partition).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    carried = n.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    out = _met(cut.withColumn("_within", within), carried, partition)
    return out.withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).drop("_within", "_before", "_cut")
