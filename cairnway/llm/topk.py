"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every query meets every candidate: a stated query set against all rows, in
blocks.  Queries are taken a block after the other, of a bounded size in bytes, and
handed to all tasks; candidates stay where they are.  A task inverts some thousand of its
vectors at a time into postings (dimension to positions and weights), and each sparse query row
scatters its weighted postings, one term after the other, into a dense score
array.  The best ``k`` a query are taken by partition selection and kept from block to block; only they are
shuffled, and a grouped window merges the tasks.

Neither side passes through the driver whole and nothing is pruned.  Rows are numbered once,
and staged so: a task that is run again after an executor is lost meets the same rows.

Defined results: vectors that are null or hold a null or non-finite component
take no part; dimensions beyond a vector's end count as zero, so an empty vector scores 0; ties go to
the smaller id; a null id takes no part.  Queries given as a condition are rows of the vectors: each asks for itself, also if its id repeats, and all
rows but itself are its candidates.  Queries given as a table each ask for themselves, and rows with their id are not their candidates.  Repeated
candidate rows each stand for themselves; fewer candidates than ``k`` give all; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.plans.staging import staged

#: Candidates of a task that are inverted at a time.
CANDIDATE_BLOCK = 8_192
#: Bytes of a block of queries, which every task receives.
QUERY_BYTES = 32 << 20
#: Queries whose dense score arrays are alive at once.
SCORE_ROWS = 32


def quantise(vectors: DataFrame, key: str, vector: str, scale: int, asks: Column) -> DataFrame:
    """``id, v, asks, n``: vectors that take part, as whole numbers floor(scale * x), and a number for each row."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    return staged(rows.withColumn("n", F.monotonically_increasing_id()), "top-vectors")


def _matrix(rows: Sequence, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def block_top(ids: np.ndarray, have: np.ndarray, tags: np.ndarray, query_tags: np.ndarray, want: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate ids and scores of the best ``k`` of a block, query by query; ``ids`` ascend, and rows with a query's own tag are not its candidates."""
    postings = []
    for t in range(have.shape[1]):
        at = np.flatnonzero(have[:, t])
        postings.append((slice(None) if at.size == len(ids) else at, have[at, t]))
    for lo in range(0, len(query_tags), SCORE_ROWS):
        block, weights = query_tags[lo : lo + SCORE_ROWS], want[lo : lo + SCORE_ROWS]
        scores = np.zeros((len(block), len(ids)), np.int64)
        for q, row in enumerate(weights):
            for t in np.flatnonzero(row):  # the query's own terms only
                at, held = postings[t]
                scores[q, at] += row[t] * held
        for q, query in enumerate(block):
            other = np.flatnonzero(tags != query)
            own = scores[q, other]
            if own.size > k:  # partition selection; all that tie with the k-th stay for the tie rule
                least = np.partition(own, own.size - k)[own.size - k]
                keep = own >= least
                other, own = other[keep], own[keep]
            best = np.lexsort((ids[other], -own))[:k]
            yield ids[other][best], own[best]


def _search(shared, k: int, candidate_block: int):
    """The best ``k`` of a task's candidates for every query of the block, the queries by their position in it."""

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= candidate_block:
                yield pd.concat(held, ignore_index=True)
                held = []
        if held:
            yield pd.concat(held, ignore_index=True)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tags, want = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(tags)
        for frame in blocks(frames):
            frame = frame.sort_values(["id", "tag"], kind="stable")
            width = max(frame["v"].map(len).max(), want.shape[1]) if len(frame) else 0
            queries = np.pad(want, ((0, 0), (0, width - want.shape[1])))
            for q, (ids, scores) in enumerate(block_top(frame["id"].to_numpy(), _matrix(frame["v"], width), frame["tag"].to_numpy(), tags, queries, k)):
                ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                first = np.lexsort((ids, -scores))[:k]
                best[q] = ids[first], scores[first]
        counts = [len(ids) for ids, _ in best]
        if sum(counts):
            ids, scores = (np.concatenate([b[i] for b in best]) for i in (0, 1))
            yield pd.DataFrame({"ask": np.repeat(np.arange(len(tags)), counts), "found": ids, "score": scores})

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame | Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    candidate_block: int = CANDIDATE_BLOCK,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``query_id, rank`` (from 1), the candidate's id under ``key`` and its ``score``; ``queries``: a condition on ``vectors``, or a table with ``key`` and ``vector``."""
    inside = isinstance(queries, Column)
    have = quantise(vectors, key, vector, scale, queries if inside else F.lit(False))
    want = have.filter("asks") if inside else quantise(queries, key, vector, scale, F.lit(True))
    tag = F.col("n" if inside else "id").alias("tag")
    n, width = want.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n * 8 * (width + 1) // query_bytes))
    spark, found = vectors.sparkSession, []
    for block in range(blocks):
        # Dealt out by the rows' numbers: neither a repeated id nor a repeated vector can fill a block.
        rows = want.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == block).select("id", "v", tag, "n").collect()  # about ``query_bytes``
        shared = spark.sparkContext.broadcast((np.array([r["tag"] for r in rows], np.int64), _matrix([r["v"] for r in rows], width)))
        names = spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(rows)], "ask long, query_id long, n long")
        best = have.select("id", "v", tag).mapInPandas(_search(shared, k, candidate_block), "ask long, found long, score long")
        order = Window.partitionBy("ask").orderBy(F.desc("score"), "found")
        merged = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(F.broadcast(names), "ask")  # a row a query of the block
        found.append(staged(merged.select("query_id", "rank", F.col("found").alias(key), "score"), "top-found"))
        shared.unpersist()
    return reduce(DataFrame.union, found)
