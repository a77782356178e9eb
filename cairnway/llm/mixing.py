"""Mixing sources to target weights by Poisson replication, native DataFrame operations only.

A source of size ``S`` that should hold the share ``w`` of a corpus of size
``T`` is repeated ``w * T / S`` times on average.  Each document draws its own
count: a uniform number made from a hash of its id and the seed is put through
the inverse Poisson distribution of its source's rate, so that the draw does not
depend on partitions, retries or order.  Documents are exploded by their counts
and shuffled globally by a hash of (id, replica, seed).

A source may hold any share of the rows: sizes are pre-aggregated, the probability
tables are broadcast only if their counted bytes are within ``MAX_TABLE_BYTES`` (beyond that an equi-join,
whose hot sources adaptive execution splits), and the exploded copies
are dealt out by hash of document and replica, never by source.  A table covers twelve
deviations around its mean, so its length grows with the root of the rate; a rate over
``LARGE_RATE`` is drawn as the sum of several smaller ones.

Defined results: null sources form one source of their own; a null or empty
text has size zero but draws a count at its source's rate; a source whose texts
are all empty is kept at rate 1 if it has a weight; sources without
an entry in ``weights`` get none when weights are given; a null id draws like
the text ``null``; rows that repeat an id draw the same count; an empty table
gives an empty result; input columns named like added ones are replaced, others are returned as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.llm.common import with_renamed_clashes, working_name
from cairnway.plans.staging import staged

#: Bytes of probability tables that are broadcast at most.
MAX_TABLE_BYTES = 8_000_000
#: Rates beyond this are drawn in equal parts.
LARGE_RATE = 10_000
#: Copies of a document that one row is exploded into at a time.
STRIDE = 10_000
ADDED = ["rate", "n_copies", "replica", "shuffle_key"]


def uniform_sql(id_sql: str, seed_sql: str) -> str:
    """52 hashed bits as a number in [0, 1)."""
    return f"cast(conv(substring(md5(concat({seed_sql}, coalesce(cast({id_sql} as string), 'null'))), 1, 13), 16, 10) as bigint) / 4503599627370496D"


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """``_source, rate``: mean target repetition of each source.

    Without ``weights`` every source gets the same share of the characters.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.char_length(text), F.lit(0))).cast("double").alias("_size"))
    if weights is None:
        share = F.lit(1.0)
    else:
        pairs = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(float(w)))]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    shares = sizes.select("_source", "_size", share.alias("_share"))
    total = shares.agg(F.sum("_size").alias("_all"), F.sum("_share").alias("_shares"))
    rate = F.when(F.col("_share") <= 0, F.lit(0.0)).when(F.col("_size") > 0, F.col("_share") / F.col("_shares") * F.col("_all") / F.col("_size")).otherwise(F.lit(1.0))
    one_row = F.broadcast(total)  # an aggregate without keys: a single row
    return shares.join(one_row, F.lit(True)).select("_source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``_source, rate, _parts, _least, _cdf``: cumulative probabilities of the counts from ``_least`` on, for sources with a rate.

    ``_cdf`` is that of one of ``_parts`` equal parts of the rate.  Probabilities are summed in logarithms from the window's start and
    divided by their sum, so that large rates do not underflow.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGE_RATE).cast("long"))
    spread = F.lit(12) * F.sqrt("_own") + 30
    rows = rates.filter("rate > 0").withColumn("_parts", parts).withColumn("_own", F.col("rate") / F.col("_parts"))
    rows = rows.withColumn("_least", F.greatest(F.lit(0), F.floor(F.col("_own") - spread)).cast("long"))
    terms = rows.withColumn("_k", F.explode(F.sequence("_least", F.ceil(F.col("_own") + spread).cast("long"))))
    whole = Window.partitionBy("_source")  # some hundreds or thousands of rows a source
    upto = whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = F.sum(F.when(F.col("_k") > F.col("_least"), F.log("_own") - F.log("_k")).otherwise(0.0)).over(upto)
    terms = terms.withColumn("_log", log).withColumn("_weight", F.exp(F.col("_log") - F.max("_log").over(whole)))
    terms = terms.withColumn("_c", F.sum("_weight").over(upto) / F.sum("_weight").over(whole))
    table = F.array_sort(F.collect_list(F.struct("_k", "_c"))).getField("_c").alias("_cdf")
    return terms.groupBy("_source", "rate", "_parts", "_least").agg(table)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = 17,
    doc: str = "doc_id",
    source: str = "source",
    text: str = "text",
    max_table_bytes: int = MAX_TABLE_BYTES,
) -> DataFrame:
    """``docs`` repeated by Poisson counts, with ``rate, n_copies, replica`` (from 0) and ``shuffle_key``, in shuffled order."""
    docs = with_renamed_clashes(docs, ADDED)
    tables = staged(poisson_tables(source_rates(docs, weights, source, text)), "mix-tables")
    size = tables.agg(F.sum(F.size("_cdf") * 8 + F.coalesce(F.octet_length("_source"), F.lit(0)) + 64)).first()[0] or 0
    own = {x: working_name(docs, x) for x in ("_source", "_parts", "_least", "_cdf", "_at")}
    tables = tables.select(*[F.col(x).alias(own.get(x, x)) for x in tables.columns])
    if size <= max_table_bytes:
        tables = F.broadcast(tables)
    joined = docs.join(tables, F.col(f"`{source}`").eqNullSafe(F.col(own["_source"])))
    draw = f"size(filter({own['_cdf']}, c -> c <= {{}})) + {own['_least']}"
    first = draw.format(uniform_sql(f"`{doc}`", f"'{seed}:'"))
    rest = draw.format(uniform_sql(f"`{doc}`", f"concat('{seed}.', part, ':')"))
    more = f"CASE WHEN {own['_parts']} > 1 THEN aggregate(sequence(1L, {own['_parts']} - 1), 0L, (n, part) -> n + {rest}) ELSE 0L END"
    counted = joined.withColumn("n_copies", F.expr(f"{first} + {more}")).filter("n_copies > 0")
    strides = counted.withColumn(own["_at"], F.explode(F.expr(f"sequence(0L, n_copies - 1, {STRIDE}L)")))
    copies = strides.withColumn("replica", F.explode(F.expr(f"sequence({own['_at']}, least({own['_at']} + {STRIDE - 1}, n_copies - 1))")))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(f"`{doc}`"), F.col("replica"), F.col(f"`{text}`")))
    shuffled = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return shuffled.select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)
