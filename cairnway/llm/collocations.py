"""Phrase collocations by prefix-free parsing.

Parsing: every text is lower-cased (A-Z), split into pieces at sentence marks and line ends, and pieces into words.  A piece of more
than ``SHORT`` words is cut behind trigger windows, windows of ``max_words - 1`` words whose hash is divisible by ``TRIGGER``; the next
chunk starts with that window, so chunks overlap by ``max_words - 1`` words and the cuts depend on content only.  Equal chunks become one
row of a dictionary with their frequency in the parse, so repeated passages and copies are counted once and weighted.

Counting: a phrase is counted in the chunk that holds its first word before the overlap with the next chunk, hence once.  A phrase that
occurs ``min_count`` times has no part that occurs less often, so words and pairs, then longer phrases are first counted in hashed
cells; what falls into a cell below ``min_count`` is out.  A cell holds at least the count of every phrase in it, so the cells
rule out rare phrases only, and those that are left are counted exactly, as text: tasks send the phrases of a bucket in one packed row, and
buckets are added up one after the other.  The cells' bits are all that is broadcast: at most ``2 ** MOST_BITS`` bits a level.  On
larger inputs the cells fill up and rule out less; then more phrases are shuffled, with the same result.

Defined results: a null text has no words; a null language is ``und``; repeated rows count as often as they occur; other input columns
play no part; an empty table gives an empty result; ties are ordered by count, then by the phrase in UTF-8 byte order.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.plans.staging import scratch, staged

#: Pieces of at most so many words are one chunk.
SHORT = 12
#: One window in so many triggers a cut.
TRIGGER = 8
#: Chunks, words or phrases that a task holds before it sends them on or forgets them.
FLUSH = 400_000
#: Chunks and bytes that are counted at a time.
BLOCK_CHUNKS, BLOCK_BYTES = 1 << 17, 12 << 20
#: Buckets of phrases: this many, or one for each ``BUCKET_BYTES`` of distinct chunks.
BUCKETS, BUCKET_BYTES = 1_024, 1 << 20
#: Cells of one staged row, and the bounds on all cells of a level, in bits.
CELLS = 1 << 16
LEAST_BITS, MOST_BITS = 20, 27
#: Lower case of A-Z; the marks that end a piece become line feeds, and the other white space inside pieces is blank and tab.
FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
BREAK = b"\n"


def chunks_of(words: list[bytes], overlap: int) -> Iterator[tuple[list[bytes], bool]]:
    """``(words, ends its piece)`` of the chunks of one piece."""
    start = 0
    if len(words) > SHORT:
        for i in range(overlap, len(words) - 1):
            if i >= start + overlap and zlib.crc32(b" ".join(words[i + 1 - overlap : i + 1])) % TRIGGER == 0:
                yield words[start : i + 1], False
                start = i + 1 - overlap
    yield words[start:], True


def _parser(overlap: int):
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.binary()), ("ends", pa.bool_()), ("freq", pa.int64())])

    def flush(counts: dict) -> pa.RecordBatch:
        keys = list(counts)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in (text.as_py() or b"").translate(FOLD).split(BREAK):
                    words = piece.split()
                    if len(words) > SHORT:
                        for chunk, ends in chunks_of(words, overlap):
                            counts[lang, b" ".join(chunk), ends] += 1
                    elif words:
                        counts[lang, b" ".join(words), True] += 1
                if len(counts) > FLUSH:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)

    return parse


def chunk_dictionary(docs: DataFrame, max_words: int = 4, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, chunk, ends, freq``: the distinct chunks of all texts with their frequency in the parse; ``ends``: the chunk ends its piece."""
    read = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    parsed = read.mapInArrow(_parser(max_words - 1), "lang string, chunk binary, ends boolean, freq bigint")
    return parsed.groupBy("lang", "chunk", "ends").agg(F.sum("freq").alias("freq"))


class _Words(dict):
    """Numbers of the words met in a task; ``hashes[number]`` is the same in every task.  Number 0 is the break between chunks."""

    def __init__(self, lang: str):
        super().__init__({BREAK: 0})
        self.seed, self.hashes, self.names = zlib.crc32(lang.encode()), [0], [BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """``lang, chunks, ends, freq``, chunks of one language in blocks of a bounded size."""
    held: dict = defaultdict(list)
    rows = size = 0

    def take() -> Iterator:
        for lang, parts in held.items():
            yield lang, [c for p in parts for c in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    for batch in batches:
        lang, chunk, ends, freq = batch.columns
        names, chunks = np.array(lang.to_pylist(), object), np.array(chunk.to_pylist() + [None], object)[:-1]
        for name in set(names):
            at = np.flatnonzero(names == name)
            held[name].append((chunks[at].tolist(), ends.to_numpy(zero_copy_only=False)[at], freq.to_numpy()[at]))
        rows, size = rows + len(names), size + chunk.nbytes
        if rows >= BLOCK_CHUNKS or size >= BLOCK_BYTES:
            yield from take()
            held.clear()
            rows = size = 0
    yield from take()


class _Positions:
    """The words of a block in a row: what is counted at which position, and how often."""

    def __init__(self, known: _Words, chunks: list[bytes], ends: np.ndarray, freq: np.ndarray, overlap: int):
        self.ids = np.fromiter(map(known.__getitem__, (b" \n ".join(chunks) + b" \n").split(b" ")), np.int64)
        self.hashes = np.array(known.hashes, np.uint64)[self.ids]
        breaks = np.flatnonzero(self.ids == 0)
        self.weight = np.repeat(freq, np.diff(breaks, prepend=-1))
        self.counted = self.ids != 0
        cut = breaks[~ends]  # where a chunk does not end its piece, the next chunk counts what starts in the overlap
        for back in range(1, overlap + 1):
            self.counted[cut - back] = False

    def grams(self, most: int, bits: dict[int, np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``n, may, cells`` for phrases of 1 to ``most`` words: ``may[i]`` if no part of the phrase at ``i`` is ruled out by ``bits``."""
        ok, hashes = self.ids != 0, self.hashes
        for n in range(1, most + 1):
            if n > 1:
                ok = ok[:-1] & ok[1:]
                hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[n - 1 :]
            cells = ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - width)
            if n in bits:
                ok = ok & ((bits[n][cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1) > 0)
            yield n, ok, cells


def _cell_counter(levels: list[int], known_bits, width: int, overlap: int, least: int):
    schema = pa.schema([("level", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])

    def packed(level: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Counts up to ``least`` of the cells met, a row a block of cells."""
        cells, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = np.minimum(np.bincount(where, np.concatenate([p[1] for p in parts])), least).astype(np.uint32)
        block = (cells // np.uint64(CELLS)).astype(np.int64)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        rows = [
            zlib.compress((o % CELLS).astype(np.uint16).tobytes() + s.astype(np.uint32).tobytes(), 1)
            for o, s in zip(np.split(cells, starts[1:]), np.split(sums, starts[1:]), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([level] * len(rows), pa.int32()), pa.array(block[starts], pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: np.frombuffer(b, np.uint8) for n, b in known_bits.value.items()}
        known: dict[str, _Words] = {}
        parts: dict[int, list] = defaultdict(list)
        held = 0
        for lang, chunks, ends, freq in _blocks(batches):
            at = _Positions(known.setdefault(lang, _Words(lang)), chunks, ends, freq, overlap)
            for n, may, cells in at.grams(max(levels), bits, width):
                if n in levels:
                    use = may & at.counted[: len(may)]
                    parts[n].append((cells[use], at.weight[: len(may)][use]))
                    held += int(use.sum())
            if sum(map(len, known.values())) > FLUSH:
                known.clear()
            if held > 10 * FLUSH:
                for n, p in parts.items():
                    yield from packed(n, p)
                parts.clear()
                held = 0
        for n, p in parts.items():
            if sum(len(x[0]) for x in p):
                yield from packed(n, p)

    return count


def _cell_bits(least: int):
    """Adds up the cells of one block after the other (rows sorted by level and block) into one bit a cell: ``least`` or more."""
    schema = pa.schema([("level", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])

    def row(key: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(sums >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(CELLS, np.uint64)
        for batch in batches:
            for level, block, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (level, block) != now:
                    if now and sums.max() >= least:
                        yield row(now, sums)
                    now, sums = (level, block), np.zeros(CELLS, np.uint64)
                raw = zlib.decompress(cells)
                n = len(raw) // 6
                sums[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw[2 * n :], np.uint32)
        if now and sums.max() >= least:
            yield row(now, sums)

    return add


def _phrase_counter(known_bits, width: int, max_words: int, buckets: int):
    """Exact counts of the phrases that the cells leave, a row a language and bucket; an empty phrase carries the number of all words."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def packed(lang: str, counts: dict[bytes, int]) -> pa.RecordBatch:
        phrases, sums = np.array([*counts, None], object)[:-1], np.fromiter(counts.values(), np.int64, len(counts))
        bucket = np.fromiter((zlib.crc32(p) % buckets for p in phrases), np.int32, len(phrases))
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = np.split(order, starts[1:])
        columns = [[lang] * len(parts), bucket[order][starts], [zlib.compress(BREAK.join(phrases[p]), 1) for p in parts], [sums[p].tobytes() for p in parts]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: np.frombuffer(b, np.uint8) for n, b in known_bits.value.items()}
        known: dict[str, _Words] = {}
        counts: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for lang, chunks, ends, freq in _blocks(batches):
            words = known.setdefault(lang, _Words(lang))
            at, found, name = _Positions(words, chunks, ends, freq, max_words - 1), counts[lang], words.names.__getitem__
            found[b""] += int(at.weight[at.counted].sum())
            numbers = np.zeros(len(at.ids), np.int64)  # of the phrase at a position among the distinct ones of its length
            for n, may, _ in at.grams(max_words, bits, width):
                here = np.flatnonzero(may)
                keys = numbers[here] << 32 | at.ids[here + n - 1]
                _, first, where = np.unique(keys, return_index=True, return_inverse=True)
                numbers = np.zeros(len(may), np.int64)
                numbers[here] = where
                sums = np.bincount(where, at.weight[here] * at.counted[here], len(first)).astype(np.int64)
                some = np.flatnonzero(sums)
                texts = zip(*(map(name, at.ids[here[first[some]] + i].tolist()) for i in range(n)), strict=True)
                for phrase, f in zip(map(b" ".join, texts), sums[some].tolist(), strict=True):
                    found[phrase] += f
            if sum(map(len, known.values())) > FLUSH:
                known.clear()
            if sum(map(len, counts.values())) > FLUSH:
                for lang, found in counts.items():
                    yield packed(lang, found)
                counts.clear()
        for lang, found in counts.items():
            yield packed(lang, found)

    return count


def _phrase_adder(least: int):
    """Adds up the rows of one language and bucket after the other (rows sorted by them)."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])

    def rows(lang: str, sums: dict[bytes, int]) -> pa.RecordBatch:
        kept = [(p, f) for p, f in sums.items() if f >= least or not p]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.binary()), pa.array([f for _, f in kept], pa.int64())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, defaultdict(int)
        for batch in batches:
            for lang, bucket, phrases, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, bucket) != now:
                    if now:
                        yield rows(now[0], sums)
                    now, sums = (lang, bucket), defaultdict(int)
                for phrase, f in zip(zlib.decompress(phrases).split(BREAK), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    sums[phrase] += f
        if now:
            yield rows(now[0], sums)

    return add


def phrase_counts(docs: DataFrame, min_count: int = 30, max_words: int = 4, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, phrase, n_words, f``: every phrase of 1 to ``max_words`` words that occurs ``min_count`` times, counted exactly, and a row
    a language without a phrase (``n_words`` 0), whose ``f`` is the number of its words."""
    spark = docs.sparkSession
    with scratch(spark) as stage:
        dictionary = stage(chunk_dictionary(docs, max_words, lang, text), "collocation-chunks")
        size = dictionary.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
        width = min(MOST_BITS, max(LEAST_BITS, int(size // 4).bit_length()))
        bits: dict[int, bytes] = {}
        for levels in ([1, 2], [*range(3, max_words + 1)]):
            levels = [n for n in levels if n <= max_words]
            if not levels:
                continue
            shared = spark.sparkContext.broadcast(bits)
            cells = dictionary.mapInArrow(_cell_counter(levels, shared, width, max_words - 1, min_count), "level int, block int, cells binary")
            dealt = cells.repartition("level", "block").sortWithinPartitions("level", "block")
            found = {n: np.zeros((1 << width) // 8, np.uint8) for n in levels}
            for r in dealt.mapInArrow(_cell_bits(min_count), "level int, block int, bits binary").collect():  # 2 ** width bits a level
                found[r["level"]][r["block"] * CELLS // 8 :][: CELLS // 8] = np.frombuffer(r["bits"], np.uint8)
            bits = bits | {n: b.tobytes() for n, b in found.items()}
            shared.unpersist()
        shared = spark.sparkContext.broadcast(bits)
        buckets = max(BUCKETS, int(size // BUCKET_BYTES))
        counted = dictionary.mapInArrow(_phrase_counter(shared, width, max_words, buckets), "lang string, bucket int, phrases binary, counts binary")
        total = counted.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_phrase_adder(min_count), "lang string, phrase binary, f bigint")
        phrase = F.col("phrase").cast("string")
        n_words = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
        return staged(total.select("lang", phrase.alias("phrase"), n_words.alias("n_words"), "f"), "collocation-phrases")


def _words(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def collocations(
    docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, covered: int = 80, lang: str = "lang", text: str = "text", salts: int = 16
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase of 2 or more words scores ``floor(2000000 * a / (l + r))`` at the cut where that is least (then the first), with ``a`` its
    count and ``l``, ``r`` the counts of the parts.  Phrases inside a longer one that makes up ``covered`` percent of their count are left out.
    """
    counts = phrase_counts(docs, min_count, max_words, lang, text)
    known = counts.filter("n_words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    found = counts.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumns({"first": _words(F.lit(1), F.col("k")), "rest": _words(F.col("k") + 1, F.col("n_words") - F.col("k"))})
    left = known.select("lang", F.col("part").alias("first"), F.col("part_f").alias("l"))
    right = known.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)").cast("long"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # Proper parts of two words and more, with the count of the most frequent longer phrase around them.
    spans = F.expr("flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), i -> struct(i, m))))")
    inside = found.filter("n_words > 2").withColumn("span", F.explode(spans)).select("lang", _words(F.col("span.i"), F.col("span.m")).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)
    )
    rows = own.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    short = rows.withColumn("_salt", salt).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
