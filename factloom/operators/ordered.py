"""Order-dependent operators that never gather a group: ranks and running sums over a distributed sort.

A window partitioned by a hot key puts the whole key into one task. Here the rows are range-partitioned by the full sort
order, so a key of any size spreads over many tasks; each task numbers its own rows, and the offsets of the tasks come
from their counts per group, of which there are at most (groups + tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from factloom.session import stage


def blocks(df: DataFrame, group: list[str], order: list, n: int | None = None) -> DataFrame:
    """df, sorted over the cluster by group and order, with `_block`, the number of the task that held the row.
    `order` should end with a unique column, so that equal values spread too. The result is staged: the bounds of a
    range partitioning are drawn from a sample and would differ if the work were repeated."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    return stage(df.repartitionByRange(n, *keys).withColumn("_block", F.spark_partition_id()), "sorted")


def ranked(df: DataFrame, group: list[str], order: list, size: str | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, parts). rows: df with `_block`, `_rank` (0-based within group in the order given) and, if size names a
    numeric column, `_before`, its sum over the group's earlier rows. parts: per group and block the counts, kept apart
    so that parts of other days or tables can be added. Nulls in group form a group of their own."""
    if clash := {"_block", "_rank", "_before", "_n", "_sum", "_off", "_base", "_local", "_lsum"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are used by the operator")
    b = blocks(df, group, order, n)
    total = F.sum(F.coalesce(F.col(size), F.lit(0))) if size else F.lit(0)
    parts = b.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"), total.cast("bigint").alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    here = W.partitionBy("_block", *group).orderBy(*order)
    rows = b.withColumn("_local", F.row_number().over(here) - 1)
    if size:
        rows = rows.withColumn("_lsum", F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))).over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    p = parts.select(F.col("_block").alias("_b"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_off", "_base")
    on = (F.col("_block") == F.col("_b"))
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rows = rows.join(p, on).withColumn("_rank", F.col("_off") + F.col("_local"))
    if size:
        rows = rows.withColumn("_before", F.col("_base") + F.col("_lsum"))
    return rows.drop("_b", *[f"_g{i}" for i in range(len(group))], "_off", "_base", "_local", "_lsum"), parts
