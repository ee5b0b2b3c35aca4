"""Running sums, ranks and totals of groups that may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.sources.scratch import cut_lineage


def sums_before(df: DataFrame, by: list[str], order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its value over the earlier rows of the group ``by`` in ``order``.

    Rows are dealt into ranges of (by, order), written once so that the ranges stay as they are; sums of
    ranges are added up, and within a range a window does the rest. So a group may hold most of the rows.
    Null values count as 0; of rows with equal order any may be the earlier one; an empty table gives no rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"__{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()}).repartitionByRange(parts, *by, *order)
    dealt = cut_lineage(dealt.withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "__range").agg(*[F.sum(f"__{n}").alias(f"__{n}_all") for n in values])
    earlier = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__{n}_all").over(earlier), F.lit(0)).alias(f"__{n}_off") for n in values])
    within = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    got = dealt.join(offsets, [*by, "__range"])
    got = got.withColumns({n: F.col(f"__{n}_off") + F.coalesce(F.sum(f"__{n}").over(within), F.lit(0)) for n in values})
    return got.drop("__range", *[f"__{n}" for n in values], *[f"__{n}_off" for n in values])


def ranked(df: DataFrame, by: list[str], order: list[str | Column], name: str, *, spread: bool = False) -> DataFrame:
    """Adds the place of each row, from 1, in its group by ``order``, which should leave no ties.

    A window sorts each group in one task. With ``spread`` the rows are dealt into ranges of (by, order) and the sizes of the
    ranges are added up, so that a group of most of the rows is ranked by all tasks.
    """
    if not spread:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return sums_before(df, by, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("int"))


def with_totals(df: DataFrame, by: list[str], totals: dict[str, Column], *, spread: bool = False) -> DataFrame:
    """Adds aggregates over each group; ``by`` is never null.

    As windows, or with ``spread`` summed in all tasks first and joined to the rows; Spark splits the share of a large group.
    """
    if not spread:
        of = W.partitionBy(*by)
        return df.withColumns({n: c.over(of) for n, c in totals.items()})
    return df.join(df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]), by)
