"""Exact line dedup across documents, native DataFrame operations only.

Plan: one scan hashes every line (128 bits) and stages only the hashes with
document and position.  Runs of one hash longer than ``RUN`` are counted and cut into parts by
hash of row and position; the hashes are range-partitioned by (hash, part) with a secondary sort
by document and position, and a window streams each sorted run: its first row is
the first occurrence, and what comes from a later document is dropped.  The partial
firsts of a cut run are merged by their minimum.  Lines after the first document become
compressed per-document keep bitmaps (64 lines a word, words without a dropped
line left out).  Text is never shuffled by line: the second scan joins a small
bitmap to each document.

Defined results: a null or empty text is one empty line and stays; keys shorter
than ``min_chars`` stay; the holder of a key is its smallest document id and
keeps all its copies; a null id sorts after all others; rows that repeat an id
each keep their own bitmap; an empty table gives an empty result; input
columns named like added ones are replaced, others are returned as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.llm.common import SPACE, lower_ascii, with_renamed_clashes, working_name
from cairnway.plans.staging import staged

ADDED = ["n_lines", "n_dropped"]
#: Lines of one hash in a sorted run; the parts of a longer run grow with it.
RUN = 2_000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _row_id(doc: str, text: str) -> list[Column]:
    """128 bits that name a row, also where ids repeat or are null."""
    return [F.xxhash64(doc, text).alias("_r1"), F.xxhash64(F.lit(7), text, doc).alias("_r2")]


def line_hashes(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """``_h1, _h2, _doc, _r1, _r2, _pos``: one row for each line whose key has ``min_chars`` code points."""
    key = lower_ascii(F.btrim(F.col("_line"), F.lit(SPACE)))
    return (
        docs.select(F.col(doc).alias("_doc"), *_row_id(doc, text), F.posexplode(_lines(text)).alias("_pos", "_line"))
        .select("_doc", "_r1", "_r2", "_pos", key.alias("_key"))
        .filter(F.char_length("_key") >= min_chars)
        .select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), "_doc", "_r1", "_r2", "_pos")
    )


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10, run_rows: int = RUN) -> DataFrame:
    """``_r1, _r2, words array<struct<word, keep>>, n_dropped``: rows that lose lines, 64 lines a word.

    Bit ``i`` of ``keep`` is set if line ``64 * word + i`` stays; words that keep every line are left out.
    """
    lines = staged(line_hashes(docs, doc, text, min_chars), "line-hashes")
    key = ["_h1", "_h2"]
    long = lines.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > run_rows)
    long = staged(long.select(*key, F.ceil(F.col("_n") / run_rows).cast("int").alias("_parts")), "line-runs")  # staged: its size is known to the join
    part = F.pmod(F.xxhash64("_r1", "_r2", "_pos"), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = lines.join(long, key, "left").withColumns({"_part": part, "_cut": F.col("_parts").isNotNull()}).drop("_parts")
    order = [*key, "_part", F.col("_doc").asc_nulls_last(), "_pos"]
    run = Window.partitionBy(*key, "_part").orderBy(*order[3:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = dealt.repartitionByRange(*key, "_part").sortWithinPartitions(*order).withColumn("_first", F.first("_doc").over(run))
    # All rows of a cut run wait for the firsts of its other parts.
    later = lambda first: F.col(first).isNotNull() & (F.col("_doc").isNull() | (F.col("_doc") > F.col(first)))
    seen = staged(streamed.filter(F.col("_cut") | later("_first")), "line-firsts")
    merged = staged(seen.filter("_cut").groupBy(*key).agg(F.min("_first").alias("_merged")), "line-merged")
    cut = seen.filter("_cut").join(merged, key).filter(later("_merged"))
    columns = ["_r1", "_r2", "_pos"]
    dropped = seen.filter("not _cut").select(*columns).union(cut.select(*columns))
    bit = F.expr("shiftleft(1L, _pos % 64)")
    words = dropped.groupBy("_r1", "_r2", F.expr("_pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("_bits"))
    return words.groupBy("_r1", "_r2").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("_bits").alias("keep")))).alias("words"),
        F.sum(F.bit_count("_bits")).cast("long").alias("n_dropped"),
    )


def dense_words(words: Column) -> Column:
    """The keep bits of all words up to the last listed one; unlisted words keep every line."""
    gap = lambda w, i: w["word"] - F.when(i > 0, F.get(words, i - 1)["word"] + 1).otherwise(0)
    return F.flatten(F.transform(words, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(w, i)), F.array(w["keep"]))))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10, run_rows: int = RUN) -> DataFrame:
    """``docs`` with the surviving lines in ``text`` and the columns ``n_lines`` and ``n_dropped``."""
    docs = with_renamed_clashes(docs, ADDED)
    r1, r2, keep, lost = (working_name(docs, x) for x in ("_r1", "_r2", "_keep", "_lost"))
    bitmaps = keep_bitmaps(docs, doc, text, min_chars, run_rows).select(
        F.col("_r1").alias(r1), F.col("_r2").alias(r2), dense_words(F.col("words")).alias(keep), F.col("n_dropped").alias(lost)
    )
    named = [c.alias(x) for c, x in zip(_row_id(doc, text), (r1, r2), strict=True)]
    joined = docs.select("*", *named).join(bitmaps, [r1, r2], "left")
    # A position past the last word of the bitmap stays.
    stays = F.expr(
        f"filter(split(coalesce(`{text}`, ''), '\\n'), (line, i) -> "
        f"(shiftright(coalesce(get({keep}, cast(i div 64 as int)), -1L), i % 64) & 1L) = 1L)"
    )
    kept = F.when(F.col(keep).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    out = [F.col(f"`{c}`") if c != text else kept.alias(text) for c in docs.columns]
    return joined.select(*out, F.size(_lines(text)).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0).cast("long")).alias("n_dropped"))
