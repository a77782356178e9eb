"""Row numbers of sorted groups of any size: no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.plans.staging import staged


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: the place of each row in its group, from 0, in ``order``, which must tell all rows of a group apart.

    Rows are range-partitioned by group and order and written once; each partition numbers its own, and starts where the partitions before it end.
    """
    keys = [F.col(c) for c in group]
    dealt = staged(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a group and partition
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(starts, [*group, "_part"]).withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_part", "_own", "_start")
