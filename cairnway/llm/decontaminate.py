"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive words of a benchmark item is a pattern (a
shorter item is one pattern).  Patterns of one length share a shift table:
the last ``BLOCK`` words under the search position say how far it can be moved on
without missing an occurrence, mostly by almost a window.  Where the shift is zero, the block
is some pattern's suffix: its hash bucket holds those patterns, and a direct
comparison of words confirms an occurrence.

Documents are scanned whole, in Arrow batches, once for each part of the benchmark.  Items are cut into
pieces that overlap by a window less one word, pieces are dealt into parts of about ``part_words`` words, and one part's tables
at a time are built and broadcast (under 300 bytes a word); with several parts the hits of each are
staged and merged, so a benchmark of any size passes through bounded memory.

Defined results: A-Z are lower-cased, words are runs of ASCII letters, digits and
characters beyond ASCII; null texts have no words; null item ids count under the
empty text; items that repeat count once per id; a document row is judged on its own also if its id repeats; empty
tables give no hits, or an empty result; input columns named like added ones are
replaced, others are returned as they came.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import lower_ascii, small_batches, with_renamed_clashes, working_name
from cairnway.plans.staging import staged

#: Words of a block of the shift tables.
BLOCK = 3
#: Words of the benchmark whose tables are broadcast at once, and of a piece of an item.
PART_WORDS, PIECE_WORDS = 500_000, 5_000
#: Folds A-Z, keeps digits, letters and bytes beyond ASCII, blanks all else.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The same words as a pattern of Spark.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ["n_words", "n_hit", "hit_spans", "items", "contaminated"]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class WuManber:
    """Shift tables and suffix buckets of patterns of one length, in words numbered from 1 to ``words``; 0 is any other word."""

    def __init__(self, length: int, words: int, patterns: dict[tuple[int, ...], set[str]]):
        self.length, self.block, self.base = length, min(BLOCK, length), words + 1
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = defaultdict(list)
        self.patterns, self.items = list(patterns), list(map(frozenset, patterns.values()))
        for number, pattern in enumerate(self.patterns):
            for end in range(self.block, length + 1):
                at = self.key(pattern[end - self.block : end])
                self.shift[at] = min(self.shift.get(at, self.far), length - end)
            self.bucket[self.key(pattern[-self.block :])].append(number)

    def key(self, block: Sequence[int]) -> int:
        out = 0
        for word in block:
            out = out * self.base + word
        return out

    def occurrences(self, words: Sequence[int]) -> Iterator[tuple[int, frozenset[str]]]:
        """(first word, items) of every occurrence."""
        end, n, block, shift, far, key = self.length, len(words), self.block, self.shift, self.far, self.key
        while end <= n:
            at = key(words[end - block : end])
            move = shift.get(at, far)
            if not move:
                here = tuple(words[end - self.length : end])
                for number in self.bucket[at]:
                    if self.patterns[number] == here:
                        yield end - self.length, self.items[number]
                move = 1
            end += move


class Tables(NamedTuple):
    numbers: dict[bytes, int]
    matchers: list[WuManber]


def build(items: list[tuple[str, list[bytes]]], window: int) -> Tables:
    """Tables of ``(item, words)`` pieces."""
    by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    numbers: dict[bytes, int] = {}
    for item, named in items:
        words = [numbers.setdefault(w, len(numbers) + 1) for w in named]
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            by_length[size][tuple(words[at : at + size])].add(item)
    return Tables(numbers, [WuManber(length, len(numbers), patterns) for length, patterns in sorted(by_length.items())])


def hits(words: list[bytes], tables: Tables) -> tuple[list[tuple[int, int]], set[str]]:
    """Positions of words inside any occurrence, as sorted (first, end) spans, and the items found."""
    spans, found = [], set()
    numbered = [tables.numbers.get(w, 0) for w in words]
    for matcher in tables.matchers:
        for at, items in matcher.occurrences(numbered):
            spans.append((at, at + matcher.length))
            found |= items
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged, found


def _search_column(text: Column, tables: Broadcast) -> Column:
    """``struct<n_words, spans, items>`` of a text, under broadcast tables."""
    shape = "struct<n_words:long,spans:array<struct<first:int,end:int>>,items:array<string>>"
    span = pa.struct([("first", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(shape)
    def search(texts: pa.Array) -> pa.Array:
        ns, spans, items = [], [], []
        for text in texts.to_pylist():
            words = words_of(text)
            where, found = hits(words, tables.value)
            ns.append(len(words)), spans.append([{"first": a, "end": b} for a, b in where]), items.append(sorted(found))
        return pa.StructArray.from_arrays([pa.array(ns, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"])

    return search(text.cast("binary"))


def pieces(benchmark: DataFrame, window: int, item: str, text: str, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``i, words``: the items' words in pieces that hold every window once."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(piece_words))
    return named.select("i", "w", F.explode(starts).alias("at")).select("i", F.slice("w", F.col("at") + 1, F.lit(piece_words + window - 1)).alias("words"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", part_words: int = PART_WORDS
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, hit_spans`` (of words, from 0), ``items`` (sorted ids with occurring windows) and ``contaminated``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = with_renamed_clashes(docs, ADDED)
    own = [F.col(f"`{c}`") for c in docs.columns]
    cut = staged(pieces(benchmark, window, item, item_text), "benchmark-pieces")
    parts = (cut.agg(F.sum(F.size("words"))).first()[0] or 0) // part_words + 1
    hit, row = working_name(docs, "_hit"), working_name(docs, "_row")

    def tables_of(part: int) -> Broadcast:
        rows = cut.filter(F.pmod(F.xxhash64("i", "words"), F.lit(parts)) == part).collect()  # about part_words words
        return spark.sparkContext.broadcast(build([(r["i"], [w.encode() for w in r["words"]]) for r in rows], window))

    if parts == 1:
        found = docs.withColumn(hit, _search_column(F.col(f"`{text}`"), tables_of(0)))
    else:
        docs, per = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows"), []
        for part in range(parts):
            tables = tables_of(part)
            per.append(staged(docs.select(F.col(row).alias("row"), _search_column(F.col(f"`{text}`"), tables).alias("h")), "decontaminate-hits"))
            tables.destroy()  # what it found is staged
        lists = {c: F.flatten(F.collect_list(f"h.{c}")) for c in ("spans", "items")}  # what one document holds of the benchmark
        merged = F.struct(F.max("h.n_words").alias("n_words"), lists["spans"].alias("spans"), F.array_sort(F.array_distinct(lists["items"])).alias("items"))
        whole = reduce(DataFrame.union, per).groupBy("row").agg(merged.alias("h"))
        found = docs.join(whole.select(F.col("row").alias(row), F.col("h").alias(hit)), row)
    spans = F.array_sort(F.col(f"{hit}.spans"))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["first"]))).alias("n")),
        lambda a: a["n"],
    )
    out = found.select(*own, F.col(f"{hit}.n_words").alias("n_words"), covered.alias("n_hit"), spans.alias("hit_spans"), F.col(f"{hit}.items").alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
