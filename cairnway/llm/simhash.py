"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 majority bits over the XXH64 hashes of word shingles, made in
Arrow batches with numpy.  Exact copies meet in one row per distinct
fingerprint before any search.

Search (after Qin et al., GPH, 2018): bits are grouped into partitions, most
correlated bits together; if a partition ``i`` is given a threshold ``t_i`` with
``sum(t_i + 1) = max_distance + 1``, two fingerprints within ``max_distance`` differ
in at most ``t_i`` bits of some partition.  The thresholds (from -1, a skipped
partition) are allocated by dynamic programming on the candidates estimated
from the value counts of all fingerprints.  Each fingerprint is put
under the keys left when any ``t_i`` bits of a partition are masked out; those that share a
key are probed and verified.

A key shared by many fingerprints is dealt out in chunks, and chunks meet in
pairs, so that a task holds at most two of them.  From a bucket come only the links of
a spanning forest of its verified links: the components are the same, and a group of
``n`` near copies yields at most ``n - 1`` links a bucket.

Defined results: A-Z are lower-cased, words are what blank and U+0009-U+000D
separate; a text of fewer words than a shingle is one shingle; null and
wordless texts have fingerprint zero and are linked like any other; a null id has
no part in a component's smallest id (a component of null ids only has id null);
rows that repeat an id each keep their fingerprint; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import LOWER, UPPER, small_batches
from cairnway.llm.links import components
from cairnway.plans.staging import staged

BITS = 64
SEED = 42
#: Fingerprints of one key that are verified together at most; larger buckets are dealt out in chunks of about this size.
CHUNK = 2048
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15
#: Numbers of partitions to choose from.
PARTITIONS = (3, 4, 6, 8)
#: What comparing two fingerprints costs against dealing one out under a key, chunks included.
PAIR_COST = 2e-3


def shingles(text: bytes | None, words: int) -> list[bytes]:
    """Space-joined word shingles of a text, repeats included."""
    parts = (text or b"").translate(FOLD).split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)]


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The bits set in over half of unsigned 64-bit hashes, which come in blocks."""
    counts, n = np.zeros(BITS, np.int64), 0
    for block in hashes:
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    grams, digest = shingles(text, words), xxhash.xxh64_intdigest
    blocks = (grams[at : at + BLOCK] for at in range(0, len(grams), BLOCK))
    return majority(np.fromiter((digest(g, SEED) for g in block), np.uint64, len(block)) for block in blocks)


def fingerprint_column(text: Column, words: int) -> Column:
    """Signed 64-bit fingerprints of a string column."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return simhash(text.cast("binary"))


def bit_moments(prints: DataFrame, column: str = "fp") -> np.ndarray:
    """How often bits are set together over all fingerprints: a 64 x 64 matrix of counts, summed on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(batch.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])

    sums = prints.select(column).mapInArrow(count, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for cell, n in sums:  # 4,096 sums whatever the input
        out[cell] = n
    return out.reshape(BITS, BITS)


def group_bits(moments: np.ndarray, n: int, partitions: int) -> list[list[int]]:
    """Bits in ``partitions`` groups of near-equal size; each group grows from the most correlated free pair."""
    p = np.diag(moments) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(moments / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, groups = list(range(BITS)), []
    for i in range(partitions):
        room = len(free) // (partitions - i)
        seed = max(combinations(free, 2), key=lambda ab: tie[ab]) if room > 1 else (free[0],)
        group = list(seed)
        while len(group) < room:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: tie[b, group].sum()))
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def as_signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], units: int) -> list[int]:
    """``costs[i][u]``: of giving partition ``i`` ``u`` units (threshold ``u - 1``).  The cheapest thresholds that use all units."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u, c in enumerate(row):
                if used + u <= units and (used + u not in step or cost + c < step[used + u][0]):
                    step[used + u] = (cost + c, [*chosen, u - 1])
        best = step
    return best[units][1]


def plan_partitions(prints: DataFrame, max_distance: int, partitions: tuple[int, ...]) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, from statistics of all fingerprints; the cheapest of the numbers of partitions offered."""
    moments, n = bit_moments(prints), prints.count()
    offered = {m: group_bits(moments, n, m) for m in partitions}
    masked = [F.col("fp").bitwiseAND(F.lit(as_signed(mask_of(g)))) for groups in offered.values() for g in groups]
    values = prints.select(F.posexplode(F.array(*masked)).alias("part", "value")).groupBy("part", "value").agg(F.count("*").alias("n"))
    pairs = {r["part"]: float(r["pairs"]) for r in values.groupBy("part").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    p, part, best = np.diag(moments) / max(n, 1), 0, (math.inf, [])
    for groups in offered.values():
        costs = []
        for group in groups:
            near = np.array([1.0])  # probabilities of 0, 1, ... differing bits, bits taken as independent
            for b in group:
                differ = 2 * p[b] * (1 - p[b])
                near = np.convolve(near, [1 - differ, differ])
            row = [0.0]
            for t in range(min(max_distance, len(group) - 1) + 1):
                # A pair meets under each mask that hides where it differs.
                met = sum(near[d] * math.comb(len(group) - d, t - d) for d in range(t + 1)) / max(near[0], 1e-12)
                row.append(max(pairs.get(part, 0.0), n * n / 2 * near[0]) * met * PAIR_COST + n * math.comb(len(group), t))
            costs.append(row)
            part += 1
        thresholds = allocate(costs, max_distance + 1)
        best = min(best, (sum(c[t + 1] for c, t in zip(costs, thresholds, strict=True)), list(zip(groups, thresholds, strict=True))), key=lambda x: x[0])
    return best[1]


def close_pairs(prints: np.ndarray, max_distance: int, most: float | None = None) -> list[tuple[int, int]] | None:
    """All pairs within the distance, block by block; None once there are more than ``most`` (twice the fingerprints)."""
    out, most = [], 2 * len(prints) if most is None else most
    for at in range(0, len(prints), 128):
        rows, cols = np.nonzero(np.bitwise_count(prints[at : at + 128, None] ^ prints[None, at:]) <= max_distance)
        ahead = cols > rows
        if len(out) + np.count_nonzero(ahead) > most:
            return None
        out += zip(prints[at + rows[ahead]].tolist(), prints[at + cols[ahead]].tolist(), strict=True)
    return out


def spanning_links(prints: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints (signed) within the distance: all of them if few, else a spanning forest by breadth-first search."""
    if len(prints) == 2:
        a, b = prints.tolist()
        return [(a, b)] if ((a ^ b) & (1 << 64) - 1).bit_count() <= max_distance else []
    out, left = [], prints.view(np.uint64)  # bits of negative numbers are counted unsigned
    if (found := close_pairs(left, max_distance, 2016 if len(prints) <= 64 else None)) is not None:
        return [(as_signed(a), as_signed(b)) for a, b in found]
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_distance
            found = left[near]
            if found.size:
                left = left[~near]
                out += [(as_signed(int(at)), as_signed(x)) for x in found.tolist()]
                queue.extend(found)
    return out


def near_links(prints: DataFrame, max_distance: int = 3, partitions: tuple[int, ...] = PARTITIONS, chunk: int = CHUNK) -> DataFrame:
    """``prints``: distinct fingerprints ``fp``.  Returns ``a, b``: links that connect all that are within ``max_distance``."""
    masks = []
    for bits, t in plan_partitions(prints, max_distance, partitions):
        if t >= 0:
            whole = mask_of(bits)
            masks += [whole & ~mask_of(list(gone)) for gone in combinations(bits, t)]
    keys = F.transform(F.array(*[F.lit(as_signed(m)) for m in masks]), lambda m: F.col("fp").bitwiseAND(m))
    keyed = prints.select("fp", F.posexplode(keys).alias("mask", "key"))
    large = (
        keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
        .select("mask", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    )
    large = staged(large, "large-buckets")
    if large.isEmpty():
        dealt = keyed.select("mask", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    else:
        dealt = keyed.join(large, ["mask", "key"], "left").withColumn("c", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        dealt = dealt.select("mask", "key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "fp")
    buckets = dealt.groupBy("mask", "key", "lo", "hi").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            found = [x for a, b in zip(offsets[:-1], offsets[1:], strict=True) for x in spanning_links(flat[a:b], max_distance)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return buckets.mapInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 3, max_distance: int = 3, partitions: tuple[int, ...] = PARTITIONS, chunk: int = CHUNK
) -> DataFrame:
    """``doc, fingerprint`` (16 hex digits) and ``component_id``: the smallest id reachable over links."""
    small_batches(docs.sparkSession)
    prints = staged(docs.select(F.col(doc).alias("_doc"), fingerprint_column(F.col(text), words).alias("fp")), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("_doc").alias("first")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), max_distance, partitions, chunk))
    joined = roots.join(distinct, roots["node"] == distinct["fp"])
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "component")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return prints.join(classes, "fp").select(
        F.col("_doc").alias(doc), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
