"""Near-duplicate texts by the exact Jaccard similarity of their word shingles.

Candidates come from three sources, and each candidate pair is compared on whole shingle sets before anything is
joined:

1. SimHash: fingerprints of the shingle sets within a small distance (see ``simhash``), as spanning links.
2. Leaders: texts that share a shingle of their prefixes are each paired with the one that holds most
   common shingles.  Both sources give at most one pair a row, so that a group of ``n`` copies costs ``n`` pairs.
3. Prefixes: an exact similarity join.  Similar sets share several shingles of their prefixes in any common
   order of all shingles (Chaudhuri et al., 2006).  Texts that were not joined before meet under their shared prefix shingles with parity
   sketches: two sketches differ in no more bits than their sets do, so the task itself drops pairs that sizes or sketches rule out,
   and only pairs at or very near ``min_similarity`` leave it.

The third source alone is complete, so no similar pair is missed; the first two keep groups of copies from meeting in
pairs there.  The order puts common shingles last.  How common they are is counted over all texts in two rows of
``CELLS`` cells, summed on the executors; the counts bear on time only.  Shingles that many texts hold are
dealt out in parts, and in chunks that meet in pairs for the third source.

Defined results: A-Z are lower-cased, words are what blank and U+0009-U+000D separate; a text of
fewer words than a shingle is one shingle; null and wordless texts are similar to each other only; a null id is greater than
all others; rows that repeat an id are told apart by their texts; an empty table gives an empty result; other columns play no part.
Different texts share one of their 64-bit names with a chance of one in 10**9 for 2 * 10**5 texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import small_batches, working_name
from cairnway.llm.links import components
from cairnway.llm.simhash import BLOCK, CHUNK, FOLD, as_signed, majority, near_links
from cairnway.plans.staging import staged

#: Cells of a row of the counts of shingles.
CELLS = 1 << 16
#: Shingles in a prefix beyond the first that must be shared: similar texts share one more than this.
SPARE = 4
#: Rows of one shingle that are looked at together for leaders.
SLICE = 1 << 16
#: Bits of a parity sketch for each shingle, and at most; pairs whose sketches are compared at a time.
SKETCH_BITS, MOST_BITS, SLAB = 8, 1 << 13, 1 << 15
#: Rows of a table that is broadcast at most, counted first.
BROADCAST_ROWS = 200_000
#: Odd multipliers of the rolling hash and of its last mix.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SIGNATURE = "struct<fp:long,size:int,common:int,cold:array<long>,hot:array<struct<key:long,parts:int>>>"


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """A text's shingles as sorted unsigned 64-bit hashes; a wordless text has one of its own."""
    parts = (text or b"").translate(FOLD).split()
    if not parts:
        return np.zeros(1, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    out = np.zeros(n, np.uint64)
    for at in range(min(words, len(parts))):
        out = out * ROLL + hashed[at : at + n]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def cells(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of shingles in the two rows of counts."""
    return (grams >> np.uint64(48)).astype(np.int64), ((grams >> np.uint64(32)) & np.uint64(CELLS - 1)).astype(np.int64)


def shingle_counts(bodies: DataFrame, words: int) -> np.ndarray:
    """How many texts hold the shingles of each cell: two rows of ``CELLS``, over all texts (one binary column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                one, two = cells(shingle_set(text, words))
                np.add.at(total, one, 1)
                np.add.at(total, two + CELLS, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(2 * CELLS, np.int64)
    for cell, n in bodies.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n  # 2 * CELLS sums whatever the input
    return out.reshape(2, CELLS)


def needed(size: int, min_similarity: float) -> tuple[int, int]:
    """How many shingles a set of ``size`` must share with a similar set, and how many of them inside both prefixes."""
    overlap = max(1, int(np.ceil(min_similarity * size - 1e-9)))
    return overlap, min(SPARE, overlap - 1) + 1


def prefix(grams: np.ndarray, counts: np.ndarray, min_similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set by count, then hash, and their counts.

    Of two sets that share ``overlap`` shingles, what lies behind the prefix that ends first is fewer than ``overlap`` minus the
    number asked for by ``needed``; so both prefixes hold that number of the shared ones.
    """
    one, two = cells(grams)
    rank = np.minimum(counts[0][one], counts[1][two])
    overlap, shared = needed(len(grams), min_similarity)
    first = np.lexsort((grams, rank))[: len(grams) - overlap + shared]
    return grams[first], rank[first]


def parity(grams: np.ndarray) -> bytes:
    """A sketch of a set: each shingle flips one bit.  The number of bits is a power of two that grows with the set."""
    bits = min(MOST_BITS, 1 << max(6, (SKETCH_BITS * len(grams) - 1).bit_length()))
    flips = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, width: int) -> np.ndarray:
    """A sketch on fewer bytes, as numbers of 64 bits."""
    out = np.frombuffer(sketch, np.uint64)
    while 8 * len(out) > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def signature_column(body: Column, words: int, min_similarity: float, counts: Broadcast) -> Column:
    """Fingerprint, number of shingles and prefix of a text; ``hot`` prefix shingles come with the number of parts their texts are dealt into."""
    kind = pa.struct([("key", pa.int64()), ("parts", pa.int32())])

    @F.arrow_udf(SIGNATURE)
    def signature(raw: pa.Array) -> pa.Array:
        usual = int(counts.value.sum()) // (2 * CELLS) + 1
        out = []
        for text in raw.to_pylist():
            grams = shingle_set(text, words)
            fp = majority(grams[at : at + BLOCK] for at in range(0, len(grams), BLOCK))
            keys, rank = prefix(grams, counts.value, min_similarity)
            parts = 1 + np.maximum(rank - 4 * usual, 0) // CHUNK
            hot, signed = parts > 1, keys.view(np.int64)
            dealt = [{"key": k, "parts": n} for k, n in zip(signed[hot].tolist(), parts[hot].tolist(), strict=True)]
            out.append((as_signed(fp), len(grams), int((rank > 2 * usual).sum()), signed[~hot], dealt))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(kind)]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)]
        return pa.StructArray.from_arrays(columns, ["fp", "size", "common", "cold", "hot"])

    return signature(body)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Sorted rows as columns that end with a run of the first ``keys`` columns, and whether the first run began before; runs over ``most`` are cut."""
    held, goes_on = None, False
    for batch in batches:
        new = [np.asarray(c) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        starts = run_starts(*held[:keys])
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield [c[:cut] for c in held], goes_on
            held, goes_on = [c[cut:] for c in held], False
        if len(held[0]) > most:
            yield held, goes_on
            held, goes_on = [c[:0] for c in held], True
    if held is not None and len(held[0]):
        yield held, goes_on


def meet(batches: Iterator[pa.RecordBatch], min_similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows ``key, salt, name, size, common`` sorted by the first two: (0, key, name, size) where a shingle is not one text's alone, and (1, a, b, smaller size) of each text with its run's leader.

    The rows of a salted key count as shared.  ``goes_on``: a run continued from an earlier cut may have a first text elsewhere, so it is kept.
    """
    for (key, salt, name, size, common), goes_on in whole_runs(batches, 2, SLICE):
        starts = run_starts(key, salt)
        lengths = np.diff(np.append(starts, len(key)))
        keep = (lengths > 1) | (salt[starts] >= 0)
        keep[:1] |= goes_on
        rows = np.repeat(keep, lengths)
        run = np.repeat(np.arange(len(starts)), lengths)[rows]
        key, name, size, common = key[rows], name[rows], size[rows], common[rows]
        order = np.lexsort((name, -common, run))
        at = run_starts(run[order])
        leader = np.repeat(order[at], np.diff(np.append(at, len(order))))  # of the rows in their order
        least, more = np.minimum(size[leader], size[order]), np.maximum(size[leader], size[order])
        pair = (name[leader] != name[order]) & (least >= min_similarity * more - 1e-9)
        a, b = name[leader][pair], name[order][pair]
        columns = [
            np.concatenate((np.zeros(len(key), np.int8), np.ones(len(a), np.int8))),
            np.concatenate((key, np.minimum(a, b))),
            np.concatenate((name, np.maximum(a, b))),
            np.concatenate((size, least[pair])).astype(np.int32),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tag", "x", "y", "z"])


def near(i: np.ndarray, j: np.ndarray, size: np.ndarray, sketch: list[bytes], tables: dict[int, np.ndarray], min_similarity: float) -> np.ndarray:
    """Which pairs of positions have sketches that do not rule them out; ``tables`` are filled by width as they are asked for."""
    widths = np.fromiter(map(len, sketch), np.int64, len(sketch))
    least, out = np.minimum(widths[i], widths[j]), np.zeros(len(i), bool)
    for width in np.unique(least).tolist():
        if width not in tables:  # sizes of similar sets, and so their widths, are less than a factor of two apart
            table = tables[width] = np.zeros((len(sketch), width // 8), np.uint64)
            for row in np.flatnonzero((widths >= width) & (widths <= 2 * width)):
                table[row] = folded(sketch[row], width)
        table, some = tables[width], np.flatnonzero(least == width)
        for at in range(0, len(some), SLAB):
            pick = some[at : at + SLAB]
            differ = np.bitwise_count(table[i[pick]] ^ table[j[pick]]).sum(axis=1, dtype=np.int64)
            # |A - B| + |B - A| of similar sets is at most this share of |A| + |B|.
            out[pick] = differ <= (size[i[pick]] + size[j[pick]]) * (1 - min_similarity) / (1 + min_similarity) + 1e-9
    return out


def meet_all(batches: Iterator[pa.RecordBatch], min_similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows ``key, name, kind, size, sketch`` sorted by key: pairs of names of different kinds that may be similar, and the smaller size."""
    for (key, name, kind, size, sketch), _ in whole_runs(batches, 1, 1 << 40):
        starts = run_starts(key)
        ends, found = np.append(starts[1:], len(key)), []
        mixed = np.minimum.reduceat(kind, starts) != np.maximum.reduceat(kind, starts)
        for start, end in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            own, names, kinds, sketches, tables = size[start:end], name[start:end], kind[start:end], list(sketch[start:end]), {}
            for at in range(0, end - start, 256):
                one = slice(at, at + 256)
                less, more = np.minimum(own[one, None], own[None, at:]), np.maximum(own[one, None], own[None, at:])
                i, j = np.nonzero(np.triu((kinds[one, None] != kinds[None, at:]) & (less >= min_similarity * more - 1e-9), 1))
                i, j = i + at, j + at
                keep = near(i, j, own, sketches, tables, min_similarity)
                i, j = i[keep], j[keep]
                if len(i):
                    found.append((np.minimum(names[i], names[j]), np.maximum(names[i], names[j]), np.minimum(own[i], own[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b", "least"])


def enough(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """``a, b`` of the pairs ``(a, b, least)`` that met as often as similar sets do; ``least`` is the smaller size."""
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    overlap = F.greatest(F.lit(1), F.ceil(F.lit(min_similarity) * F.col("least") - 1e-9))
    return met.filter(F.col("n") >= F.least(F.lit(SPARE + 1), overlap)).select("a", "b")


def small(table: DataFrame) -> DataFrame:
    """A staged table, broadcast if its counted rows allow it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def of_texts(docs: DataFrame, doc: str, body: Column, texts: DataFrame, names: DataFrame, made: Column) -> DataFrame:
    """``_t1, made``: a column made of ``_b``, the bytes of each named text; ``texts(_t1, first)`` name a row of each text."""
    asked = staged(texts.select("_t1", "first").join(names, "_t1", "left_semi"), "similar-asked")
    rows = docs.select(F.xxhash64(body).alias("_t1"), F.col(f"`{doc}`").alias("_doc"), body.cast("binary").alias("_b"))
    own = rows.join(small(asked.withColumnRenamed("_t1", "_n")), (F.col("_t1") == F.col("_n")) & F.col("_doc").eqNullSafe(F.col("first")), "left_semi")
    return staged(own.select("_t1", made.alias("made")).groupBy("_t1").agg(F.any_value("made").alias("made")), "similar-made")


def set_column(words: int) -> Column:
    @F.arrow_udf("array<long>")
    def hashes(raw: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).view(np.int64) for t in raw.to_pylist()], pa.list_(pa.int64()))

    return hashes(F.col("_b"))


def sketch_column(words: int) -> Column:
    @F.arrow_udf("binary")
    def sketches(raw: pa.Array) -> pa.Array:
        return pa.array([parity(shingle_set(t, words)) for t in raw.to_pylist()], pa.binary())

    return sketches(F.col("_b"))


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], min_similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of text names whose whole sets are similar."""
    sets = sets_of(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "_t1"))
    end = lambda name, column: sets.select(F.col("_t1").alias(name), F.col("made").alias(column))
    both = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("all"))
    return staged(both.filter(F.col("shared") >= F.lit(min_similarity) * F.col("all")).select("a", "b"), "similar-pairs")


def print_pairs(texts: DataFrame, max_distance: int) -> DataFrame:
    """``a, b``: names of texts joined by links of their fingerprints; equal fingerprints are joined to one text of theirs."""
    heads = staged(texts.groupBy("fp").agg(F.min("_t1").alias("head")), "similar-heads")
    links = near_links(heads.select("fp"), max_distance)
    head = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"h{end}"))
    far = links.join(head("a"), "a").join(head("b"), "b").select("ha", "hb")
    same = texts.join(heads, "fp").filter(F.col("_t1") != F.col("head")).select("_t1", "head")
    return far.union(same).select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))


def prefix_pairs(shared: DataFrame, kinds: DataFrame, sketches_of: Callable[[DataFrame], DataFrame], min_similarity: float) -> DataFrame:
    """``a, b``: all pairs of texts of different kinds that prefixes, sizes and sketches leave similar; ``shared(key, name, size)``, ``kinds(node, root)``."""
    own = shared.join(kinds.withColumnRenamed("node", "name"), "name", "left").select("key", "name", F.coalesce("root", "name").alias("kind"), F.col("size").cast("long").alias("size"))
    own = staged(own, "similar-own")
    several = own.groupBy("key").agg(F.min("kind").alias("x"), F.max("kind").alias("y"), F.count("*").alias("n")).filter("x <> y")
    several = staged(several.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "similar-several")
    rows = staged(own.join(several, "key"), "similar-rows")
    rows = rows.join(sketches_of(rows.select(F.col("name").alias("_t1")).distinct()).select(F.col("_t1").alias("name"), F.col("made").alias("sketch")), "name")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("name"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")))
    dealt = rows.select(key.alias("key"), "name", "kind", "size", "sketch").repartition("key").sortWithinPartitions("key")
    return enough(dealt.mapInArrow(lambda batches: meet_all(batches, min_similarity), "a long, b long, least long"), min_similarity)


def similar_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, min_similarity: float = 0.8, max_distance: int = 3) -> DataFrame:
    """``doc, _t1, _t2, component_id, _keeps``: rows of one group are joined by links of Jaccard similarity ``min_similarity`` or more.

    ``_t1, _t2`` are two hashes of the row's text; ``component_id`` is the group's smallest id, and ``_keeps`` marks the rows of its smallest
    (id, text).
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counts = spark.sparkContext.broadcast(shingle_counts(docs.select(body.cast("binary").alias("b")), words))
    digest = [F.xxhash64(body).alias("_t1"), F.xxhash64(F.lit(9), body).alias("_t2")]
    prints = docs.select(F.col(f"`{doc}`").alias("_doc"), *digest, signature_column(body.cast("binary"), words, min_similarity, counts).alias("s"))
    prints = staged(prints, "similar-prints")
    texts = prints.groupBy("_t1", "_t2").agg(F.min("_doc").alias("first"), F.min("s.fp").alias("fp"))
    texts = staged(texts, "similar-texts")

    once = prints.groupBy("_t1", "_t2").agg(F.any_value("s").alias("s"))
    salted = lambda x: F.struct(x["key"].alias("key"), F.pmod("_t1", x["parts"]).cast("int").alias("salt"))
    keys = F.concat(F.transform("s.cold", lambda k: F.struct(k.alias("key"), F.lit(-1).alias("salt"))), F.transform("s.hot", salted))
    rows = once.select(F.col("_t1").alias("name"), "s.size", "s.common", F.explode(keys).alias("k")).select("k.key", "k.salt", "name", "size", "common")
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    met = staged(dealt.mapInArrow(lambda batches: meet(batches, min_similarity), "tag byte, x long, y long, z int"), "similar-met")

    led = enough(met.filter("tag = 1").select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("least")), min_similarity)
    tried = staged(led.union(print_pairs(texts, max_distance)).distinct(), "similar-tried")
    made = lambda column: lambda names: of_texts(docs, doc, body, texts, names, column)
    kinds = components(verified(tried, made(set_column(words)), min_similarity))
    shared = met.filter("tag = 0").select(F.col("x").alias("key"), F.col("y").alias("name"), F.col("z").alias("size"))
    apart = prefix_pairs(shared, kinds, made(sketch_column(words)), min_similarity)
    rest = verified(staged(apart.join(tried, ["a", "b"], "left_anti"), "similar-apart"), made(set_column(words)), min_similarity)
    if not rest.isEmpty():
        kinds = components(kinds.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))

    named = texts.join(kinds, texts["_t1"] == kinds["node"], "left").select("_t1", "_t2", "first", F.coalesce("root", "_t1").alias("class"))
    best = named.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "_t1", "_t2")).alias("best"))
    final = named.join(best, "class").select("_t1", "_t2", "best")
    rows = prints.select("_doc", "_t1", "_t2").join(final, ["_t1", "_t2"])
    keeps = F.col("_doc").eqNullSafe(F.col("best.first")) & (F.col("_t1") == F.col("best._t1")) & (F.col("_t2") == F.col("best._t2"))
    return rows.select(F.col("_doc").alias(doc), "_t1", "_t2", F.col("best.first").alias("component_id"), keeps.alias("_keeps"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each group one row stays, that of the smallest id, of its smallest text, and of equal ones any."""
    groups = staged(similar_groups(docs, doc, text, **options).withColumnRenamed(doc, "_doc"), "similar-groups")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    t1, t2, d = (working_name(docs, x) for x in ("_t1", "_t2", "_doc"))
    named = [F.col("_doc").alias(d), F.col("_t1").alias(t1), F.col("_t2").alias(t2)]
    losers = staged(groups.filter("not _keeps").select(*named).distinct(), "similar-losers")
    again = staged(groups.filter("_keeps").groupBy("_doc", "_t1", "_t2").agg(F.count("*").alias("n")).filter("n > 1").select(*named), "similar-again")
    rows = docs.withColumns({t1: F.xxhash64(body), t2: F.xxhash64(F.lit(9), body)})

    def matching(table: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        other = small(table.select(F.col(d).alias(d + "o"), F.col(t1).alias(t1 + "o"), F.col(t2).alias(t2 + "o")))
        return rows.join(other, F.col(f"`{doc}`").eqNullSafe(F.col(d + "o")) & (F.col(t1) == F.col(t1 + "o")) & (F.col(t2) == F.col(t2 + "o")), how)

    kept = matching(losers, "left_anti", rows)
    once = matching(again, "left_semi", kept).dropDuplicates([doc, t1, t2])
    return matching(again, "left_anti", kept).unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
