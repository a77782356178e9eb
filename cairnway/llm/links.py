"""Connected components over a distributed table of links.

Large-star and small-star rounds (Kiveris et al., 2014) as joins and grouped
minima.  Grouped minima are pre-aggregated on the map side and joined back, so
that a node with very many links is never gathered; each round is written to
the shared folder, and nothing but two counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.plans.staging import staged


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the links seen in one batch: same components, fewer and shorter paths."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        stars = [(n, root(n)) for n in list(parent)]
        stars = [(n, r) for n, r in stars if n != r]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars, strict=True)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``links``: two long columns.  Returns ``node, root``: every linked node, its component's smallest node."""
    a, b = links.columns
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = staged(pairs.mapInArrow(_contract, "u long, v long").distinct(), "stars")
    state = _digest(now)
    while state[0]:
        # Large star: every larger neighbour of a node moves to the least of its neighbours and itself.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node's smaller neighbours and itself move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, state = state, _digest(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
