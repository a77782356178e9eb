"""How many files depend on each file, for all files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.plans.staging import scratch, staged


def dependents(files: DataFrame, edges: DataFrame, most: int = 200, lg_k: int = 12) -> DataFrame:
    """``path, n_dependents, exact, dependents``: how many files depend on each, directly or not, itself left out.

    Every file carries the set of what depends on it as long as that has at most ``most`` members with the file itself, and a HyperLogLog sketch of ``2 ** lg_k``
    registers; both are passed on along ``edges(src, dst)`` until nothing changes, only from files that changed.  Where the set is too
    large ``dependents`` is null and the number is the sketch's estimate, with a standard error of ``1.04 / sqrt(2 ** lg_k)`` (1.6 %).
    Cycles need no treatment, as unions settle; rounds grow with the longest way.  A file with more than ``most`` importers gathers no sets.
    """
    with scratch(files.sparkSession) as stage:
        links = stage(edges.filter("src <> dst").select("src", "dst").distinct(), "links")
        hubs = links.groupBy(F.col("dst").alias("path")).agg((F.count("*") > most).alias("_hub"))
        start = files.select("path").distinct().groupBy("path").agg(F.hll_sketch_agg(F.xxhash64("path"), lg_k).alias("sketch"))
        start = start.join(hubs, "path", "left").withColumn("_hub", F.coalesce("_hub", F.lit(False)))
        now = stage(start.select("path", F.when(~F.col("_hub"), F.array("path")).alias("few"), "sketch", "_hub"), "spread")
        moved = now
        while True:
            sent = moved.select(F.col("path").alias("src"), "few", "sketch").join(links, "src").join(now.select(F.col("path").alias("dst"), F.col("_hub").alias("_to_hub")), "dst")
            met = sent.groupBy(F.col("dst").alias("path")).agg(
                F.flatten(F.collect_list(F.when(~F.col("_to_hub"), F.col("few")))).alias("_few"), F.bool_or(F.col("few").isNull()).alias("_large"), F.hll_union_agg("sketch").alias("_sketch")
            )
            union = F.array_sort(F.array_union("few", "_few"))
            few = F.when(~F.col("_large") & (F.size(union) <= most), union)
            both = now.join(met, "path").select("path", "few", few.alias("_new"), "sketch", F.hll_union("sketch", "_sketch").alias("_sketch"))
            grown = ~F.col("few").eqNullSafe(F.col("_new")) | (F.col("_new").isNull() & (F.hll_sketch_estimate("_sketch") > F.hll_sketch_estimate("sketch")))
            moved = stage(both.filter(grown).select("path", F.col("_new").alias("few"), F.col("_sketch").alias("sketch")), "spread-moved")
            if moved.isEmpty():
                break
            news = moved.select("path", F.col("few").alias("_few"), F.col("sketch").alias("_sketch"), F.lit(True).alias("_moved"))
            changed = F.coalesce("_moved", F.lit(False))
            now = now.join(news, "path", "left").select(
                "path", F.when(changed, F.col("_few")).otherwise(F.col("few")).alias("few"), F.when(changed, F.col("_sketch")).otherwise(F.col("sketch")).alias("sketch"), "_hub"
            )
            now = stage(now, "spread")
        exact = F.col("few").isNotNull()
        number = F.when(exact, F.size("few")).otherwise(F.hll_sketch_estimate("sketch")).cast("long") - 1
        return staged(now.select("path", number.alias("n_dependents"), exact.alias("exact"), F.array_except("few", F.array("path")).alias("dependents")), "dependents")
