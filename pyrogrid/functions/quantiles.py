"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(
    df: DataFrame,
    value: str,
    p: float,
    by: list[str] | None = None,
    width: float = 0.25,
    weight: Column | None = None,
    name: str = "quantile",
) -> DataFrame:
    """Linearly interpolated quantile per group, with no group in one task's memory.

    Values are first counted (a map-side combined aggregate on group and value).
    Counts of value buckets of the given ``width`` locate the two order statistics,
    and only the buckets that hold them are ranked value by value.
    """
    by = list(by or [])
    count = F.sum(weight) if weight is not None else F.count(F.lit(1))
    freq = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(count.cast("long").alias("_n"))
        .filter(F.col("_n") > 0)
        .withColumn("_bucket", F.floor(F.col(value) / width))
    )
    group = [F.col(c) for c in by] or [F.lit(0)]
    running = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    wanted = (
        freq.groupBy(*by, "_bucket")
        .agg(F.sum("_n").alias("_in"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(running), F.lit(0)))
        .withColumn("_rank", (F.sum("_in").over(whole) - 1) * F.lit(float(p)))
        .filter(
            (F.ceil("_rank") >= F.col("_before"))
            & (F.floor("_rank") < F.col("_before") + F.col("_in"))
        )
        .select(*by, "_bucket", "_before", "_rank")
    )
    inner = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    picked = (
        freq.join(wanted, [*by, "_bucket"])
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(inner), F.lit(0)))
        .withColumn("_end", F.col("_start") + F.col("_n"))
    )

    def order_statistic(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col(value)))

    return (
        picked.groupBy(*by)
        .agg(
            order_statistic(F.floor("_rank")).alias("_lo"),
            order_statistic(F.ceil("_rank")).alias("_hi"),
            F.first("_rank").alias("_rank"),
        )
        .select(
            *by,
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))).alias(name),
        )
    )
