"""Bounded labelled samples for fitting classifiers.

Which rows are taken depends on a hash of their id only; whether a row may be
learned from is decided by the caller on the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.plans.staging import staged

#: Bytes of labelled texts that are learned from at most; the texts are taken in the order of the hash as long as they fit.
SAMPLE_BYTES = 64_000_000


def crc_mod(doc: str, n: int) -> Column:
    """The split of the contracts: crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, doc: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES
) -> tuple[list[tuple[bytes, int]], tuple[float, float]]:
    """At most ``per_class`` (UTF-8 text, label) rows of each class, and the share of each class among all that may be learned from.

    Only ids are ordered and cut; texts are then fetched for those ids, whole or not at all, ``most_bytes`` in all.  Rows with a
    null id or label play no part; a repeated id counts once, with its larger label.
    """
    known = labels.filter(F.col(doc).isNotNull() & F.col(label).isNotNull() & learn).groupBy(doc).agg(F.max(F.col(label).cast("int")).alias("_y"))
    known = known.select(F.col(doc).alias("_id"), (F.col("_y") > 0).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("_y") == y).orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # 2 * per_class rows at most
    bodies = docs.select(F.col(f"`{doc}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))
    rows = bodies.join(ids, F.col("_key") == F.col("_id")).select("_id", "t", "_y")
    rows = staged(rows.groupBy("_id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("_y").alias("_y")), "labelled")
    sizes = rows.select("_id", F.octet_length("t").alias("n")).orderBy(F.xxhash64(F.lit(11), "_id"), "_id").collect()  # 2 * per_class numbers
    taken, room = [], most_bytes
    for r in sizes:
        if r["n"] <= room:
            taken.append(r["_id"])
            room -= r["n"]
    if len(taken) < len(sizes):
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in taken], rows.select("_id").schema)), "_id", "left_semi")
    total = max(1, sum(counts.values()))
    return [(bytes(r["t"]), r["_y"]) for r in sorted(rows.collect(), key=lambda r: r["_id"])], (counts.get(0, 0) / total, counts.get(1, 0) / total)
