"""Contract queries over the driver's tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.llm import chat, collocations, decontaminate, html_text, line_dedup, mixing, prefix_trie, quality, sharding, simhash, token_files, topk, toxicity
from cairnway.llm.common import table
from cairnway.llm.labelled import crc_mod
from cairnway.plans.staging import scratch_folder, staged

SHARDS = 40
TOKENIZER = "byte_bpe_50k.json"
#: Scores from here on count as label 1.
THRESHOLD = 0.3


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_distance=3)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 4) == 2
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out)
    return _verdicts(scored, held_out)


def _verdicts(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("n_copies").cast("int"), F.col("replica").cast("int"), "text")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 0
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out)
    return _verdicts(scored, held_out)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    digests = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    out = sharding.assign_shards(digests, SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    examples = chat.format_chats(turns.unionByName(extra))
    # The last example of a conversation holds all its turns; each example gives its own masked text.
    read = F.when(F.col("is_last"), chat.parse_turns(F.col("formatted")))
    said_again = F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = examples.select(
        "conv_id",
        "example",
        F.size(read).cast("long").alias("n"),
        F.when(F.col("is_last"), F.sha2(F.array_join(said_again, ""), 256)).alias("sha"),
        F.coalesce(chat.masked_text(), F.lit("")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
        F.col("is_last"),
    )
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    whole = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("n"))).alias("n_turns"), F.max("sha").alias("turns_sha256"), losses.alias("all_loss"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("all_loss").cast("long").alias("loss_chars"), F.sha2("all_loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are read back once, for the rows of the query, and deleted."""
    import public_tokenizers

    with scratch_folder(spark, "token-files") as path:
        token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
        return staged(token_files.with_checksums(token_files.read_tokens(spark, path)), "token-checksums")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), min_count=30, max_words=4, top=2000)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9))
    base = F.col("conv") - F.col("conv") % 5
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base, head, most_head=8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_simhash": op2_simhash,
        "op3_toxicity": op3_toxicity,
        "op4_source_mixing": op4_source_mixing,
        "op5_top_k": op5_top_k,
        "op6_decontamination": op6_decontamination,
        "op7_quality": op7_quality,
        "op8_sharding": op8_sharding,
        "op9_chat_format": op9_chat_format,
        "op10_html_text": op10_html_text,
        "op11_token_files": op11_token_files,
        "op12_collocations": op12_collocations,
        "op13_prefix_trie": op13_prefix_trie,
    }
