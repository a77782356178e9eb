"""Prefix tries of conversations that are rebuilt from a shared head and their own turns.

A rebuilt conversation is the first turns of a base conversation, then its own turns behind the replaced ones.  None is ever put together:
a run of turns has the fingerprint ``(n, v)`` of a monoid, ``(n1, v1) * (n2, v2) = (n1 + n2, v1 + B ** n1 * v2)`` modulo a prime, in
several lanes with their own ``B``.  Every conversation keeps the products of its prefixes; the product of a head is one of them, that
of an own suffix is the difference of two, shifted by a power of ``B``, and a rebuilt prefix is the product of both.

Plan: turns are range-partitioned by conversation and turn and sorted; tasks multiply up what they hold, and the parts of a conversation that
spans several are composed (one carried product a partition), so a conversation may be of any length.  One row a conversation and depth then
carries fingerprint, parent fingerprint and a reference to its last turn's content.  Nodes are groups of equal depth and fingerprint.
Each group is verified: all its members must have the same last turn and the same parent group, so by induction the same turns; references are
numbers of distinct (role, text), themselves checked on the texts.  Should a check fail, everything is done anew with other seeds and more lanes.
Sums over subtrees need no walk: a node's subtree consists of nodes whose smallest member is a member of the node, so what a node
adds is credited to that member at its depth, summed from below once, and added up over each node's members.

Defined results: rows without a conversation id belong to none and are left out; null roles and texts are empty; turns are in order of
turn (null first), then role, then text, and repeated rows are turns of their own; turns of one conversation that are equal in number are sorted
in one task; a missing base, or one without enough turns, gives a shorter head; remainders are those of SQL (the sign of the dividend); other
input columns play no part; an empty table has no conversations and no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.plans.staging import scratch, staged

PRIME = (1 << 31) - 1
#: Ids of a node's members that are joined in one row before they are hashed.
IDS_A_ROW = 4_096
#: Depths of one conversation that are summed up in one run.
RUN = 4_096


@dataclass(frozen=True)
class Lanes:
    """``count`` fingerprints of 31 bits side by side, two of them in a key column."""

    count: int
    seed: int
    prime: int = PRIME
    bases: list[int] = field(init=False)

    def __post_init__(self):
        digest = (int.from_bytes(hashlib.sha256(f"{self.seed}:{i}".encode()).digest()[:8], "big") for i in range(self.count))
        object.__setattr__(self, "bases", [2 + d % (self.prime - 3) for d in digest])

    @property
    def keys(self) -> list[str]:
        return [f"k{i}" for i in range((self.count + 1) // 2)]

    @property
    def parents(self) -> list[str]:
        return [f"parent_{k}" for k in self.keys]

    def columns(self, stem: str) -> list[str]:
        return [f"{stem}{i}" for i in range(self.count)]

    def packed(self, values: list[Column]) -> list[Column]:
        pairs = [values[i : i + 2] for i in range(0, self.count, 2)]
        return [F.shiftleft(p[0], 31).bitwiseOR(p[1]) if len(p) == 2 else p[0] for p in pairs]

    def power(self, lane: int, exponent: Column) -> Column:
        """``B ** exponent`` for exponents from 0 to 2 ** 40."""
        squares = F.array(*[F.lit(pow(self.bases[lane], 1 << i, self.prime)).cast("long") for i in range(41)])
        bits = F.transform(squares, lambda s, i: F.when(F.getbit(exponent, i) == 1, s).otherwise(F.lit(1).cast("long")))
        return F.aggregate(bits, F.lit(1).cast("long"), lambda acc, s: acc * s % self.prime)

    def inverse(self, lane: int, exponent: Column, most: int) -> Column:
        """``B ** -exponent`` for exponents from 0 to ``most``."""
        return F.element_at(F.array(*[F.lit(pow(self.bases[lane], -i, self.prime)).cast("long") for i in range(most + 1)]), exponent.cast("int") + 1)


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def _turn_values(c1: np.ndarray, c2: np.ndarray, lane: int, prime: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (c1.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (2 * lane + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = ((mixed ^ (mixed >> np.uint64(31))) + c2.view(np.uint64)) * np.uint64(0x94D049BB133111EB + 2 * lane)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(prime)).astype(np.int64)


def _multiplier(lanes: Lanes, schema: pa.Schema):
    """Numbers the turns of each conversation within a sorted partition and multiplies them up: ``p`` with the turn, ``q`` before it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, carry = TaskContext.get().partitionId(), None, 0, [0] * lanes.count
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, c1, c2, size = (batch.column(i).to_numpy() for i in range(4))
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            lengths = np.diff(np.append(starts, len(conv)))
            goes_on = conv[0] == last
            pos = np.arange(1, len(conv) + 1) - np.repeat(starts, lengths)
            if goes_on:
                pos[: lengths[0]] += held
            columns, befores, afters = [pa.array([part] * len(conv), pa.int32()), batch.column(0), pa.array(pos)], [], []
            for lane in range(lanes.count):
                x = _turn_values(c1, c2, lane, lanes.prime) * _powers(lanes.bases[lane], pos - 1, lanes.prime) % lanes.prime
                sums = np.cumsum(x)
                after = sums - np.repeat(sums[starts] - x[starts], lengths)
                if goes_on:
                    after[: lengths[0]] += carry[lane]
                after %= lanes.prime
                befores.append((after - x) % lanes.prime)
                afters.append(after)
                carry[lane] = int(after[-1])
            last, held = conv[-1], int(pos[-1])
            columns += [pa.array(a) for a in afters + befores] + list(batch.columns[1:])
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan


def prefix_products(turns: DataFrame, lanes: Lanes, stage, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, pos`` (from 1), the products ``p`` up to the turn and ``q`` before it, its content's numbers ``c1, c2`` and the ``bytes`` of its text."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), said[0].alias("role"), said[1].alias("text")).filter("conv is not null")
    content = [F.xxhash64(F.lit(lanes.seed * 2 + i), "role", "text").alias(c) for i, c in enumerate(("c1", "c2"))]
    rows = rows.select("*", *content, F.octet_length("text").cast("long").alias("bytes"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    names = ["pos", *lanes.columns("p"), *lanes.columns("q"), "c1", "c2", "bytes"]
    schema = pa.schema([("part", pa.int32()), ("conv", pa.int64()), *[(n, pa.int64()) for n in names]])
    ddl = "part int, conv bigint, " + ", ".join(f"{n} bigint" for n in names)
    local = stage(dealt.select("conv", "c1", "c2", "bytes").mapInArrow(_multiplier(lanes, schema), ddl), "trie-products")
    # The pieces of conversations that span partitions: at most one a partition goes on with what lies before it.
    ends = [F.max_by(c, "pos").alias(c) for c in lanes.columns("p")]
    pieces = local.groupBy("conv", "part").agg(F.max("pos").alias("n"), *ends)
    cut = pieces.withColumn("_pieces", F.count("*").over(Window.partitionBy("conv"))).filter("_pieces > 1")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_off", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    for i, c in enumerate(lanes.columns("p")):
        cut = cut.withColumn(f"_shift{i}", lanes.power(i, F.col("_off"))).withColumn(c, F.col(c) * F.col(f"_shift{i}") % lanes.prime)
        cut = cut.withColumn(f"_carry{i}", F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")) % lanes.prime)
    cut = stage(cut.filter("_off > 0").select("conv", "part", "_off", *[f"_{x}{i}" for x in ("shift", "carry") for i in range(lanes.count)]), "trie-carries")
    rows = local.join(F.broadcast(cut), ["conv", "part"], "left")  # a row a partition at most
    go_on = F.col("_off").isNotNull()
    moved = {
        f"{x}{i}": F.when(go_on, (F.col(f"_carry{i}") + F.col(f"_shift{i}") * F.col(f"{x}{i}")) % lanes.prime).otherwise(F.col(f"{x}{i}")) for x in "pq" for i in range(lanes.count)
    }
    return rows.withColumns({"pos": F.col("pos") + F.coalesce("_off", F.lit(0)), **moved}).select("conv", *names)


def contents_are_told_apart(turns: DataFrame, products: DataFrame, lanes: Lanes, role: str, text: str) -> bool:
    """Whether equal numbers ``c1, c2`` always mean equal role and text; only contents that occur more than once are looked at."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    content = [F.xxhash64(F.lit(lanes.seed * 2 + i), "role", "text").alias(c) for i, c in enumerate(("c1", "c2"))]
    repeated = products.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c1", "c2")
    rows = turns.select(*said).select("role", "text", *content).join(repeated, ["c1", "c2"], "left_semi")
    kinds = rows.groupBy("c1", "c2").agg(*[f(c).alias(f"{c}_{f.__name__}") for f in (F.min, F.max) for c in ("role", "text")])
    return kinds.filter("role_min <> role_max or text_min <> text_max").isEmpty()


def rebuilt_prefixes(products: DataFrame, lanes: Lanes, base: Column, head: Column, most_head: int) -> tuple[DataFrame, DataFrame]:
    """One row a rebuilt conversation and depth, and one row a conversation (``conv, length``).

    ``conv, depth``, the keys of the prefix and of the prefix before, ``c1, c2, bytes`` of the last turn, ``ends`` (the conversation ends here).
    """
    element = F.struct("pos", *lanes.columns("p"), *lanes.columns("q"), "c1", "c2", "bytes")
    convs = products.groupBy("conv").agg(
        F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") <= most_head, element))).alias("heads")  # most_head entries at most
    )
    convs = convs.select("conv", "n", "heads", base.alias("base"), head.cast("int").alias("h"))
    donors = convs.select(F.col("conv").alias("base"), F.col("heads").alias("donated"))
    plan = convs.join(donors, "base", "left").withColumn("m", F.least("h", F.coalesce(F.size("donated"), F.lit(0))))
    zero = F.lit(0).cast("long")
    at = lambda heads, i, lane: F.coalesce(F.get(heads, i - 1)[f"p{lane}"], zero)
    plan = plan.select(
        "conv", "h", "m", F.slice(F.coalesce("donated", F.array().cast(convs.schema["heads"].dataType)), 1, F.greatest("m", F.lit(0))).alias("donated"),
        (F.col("m") + F.greatest(F.col("n") - F.col("h"), zero)).alias("length"),
        *[at(F.col("donated"), F.col("m"), i).alias(f"_head{i}") for i in range(lanes.count)],
        *[at(F.col("heads"), F.col("h"), i).alias(f"_own{i}") for i in range(lanes.count)],
    )
    out = lambda depth, p, q, x: ["conv", depth.cast("long").alias("depth"), *[c.alias(k) for c, k in zip(lanes.packed(p), lanes.keys, strict=True)],
                                  *[c.alias(k) for c, k in zip(lanes.packed(q), lanes.parents, strict=True)], x("c1").alias("c1"), x("c2").alias("c2"), x("bytes").alias("bytes"), (depth == F.col("length")).alias("ends")]
    given = plan.select("conv", "length", F.explode("donated").alias("t"))
    given = given.select(*out(F.col("t.pos"), [F.col(f"t.{c}") for c in lanes.columns("p")], [F.col(f"t.{c}") for c in lanes.columns("q")], lambda n: F.col(f"t.{n}")))
    own = products.join(plan.drop("donated"), "conv").filter("pos > h")
    moved = lambda c, i: (F.col(f"_head{i}") + lanes.inverse(i, F.col("h") - F.col("m"), most_head) * F.pmod(F.col(c) - F.col(f"_own{i}"), F.lit(lanes.prime))) % lanes.prime
    own = own.select(*out(F.col("m") + F.col("pos") - F.col("h"), *[[moved(f"{x}{i}", i) for i in range(lanes.count)] for x in "pq"], F.col))
    return given.union(own), plan.select("conv", "length")


def _joined_ids(key: list[str], schema: pa.Schema):
    """Rows sorted by node and conversation to rows of many ids, ``node, first, ids``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for batch in batches:
            rows = []
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now or len(ids) == IDS_A_ROW:
                    if ids:
                        rows.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = node, []
                ids.append(conv)
            yield _batch(rows, schema)
        yield _batch([(*now, ids[0], ",".join(map(str, ids)))] if ids else [], schema)

    return join


def _hashed_ids(schema: pa.Schema):
    """Rows of ids sorted by node and first id to one digest a node."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            rows = []
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now:
                    if now:
                        rows.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield _batch(rows, schema)
        yield _batch([(*now, sha.hexdigest())] if now else [], schema)

    return digest


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def end_digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """``ends`` (node key and ``conv``) to the SHA-256 of each node's ids in ascending order: ids are joined in sorted ranges, then hashed node by node."""
    longs = [(k, pa.int64()) for k in key]
    ddl = ", ".join(f"{k} bigint" for k in key)
    sorted_ends = ends.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    joined = sorted_ends.mapInArrow(_joined_ids(key, pa.schema([*longs, ("first", pa.int64()), ("ids", pa.string())])), f"{ddl}, first bigint, ids string")
    dealt = joined.repartition(*key).sortWithinPartitions(*key, "first")
    return dealt.mapInArrow(_hashed_ids(pa.schema([*longs, ("ends_sha256", pa.string())])), f"{ddl}, ends_sha256 string")


def _credits(nodes: DataFrame, leaves: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What nodes add to all nodes above, by their smallest member: a row a node (``below``: from its depth down, less all), and a row a member (``total, leaf``)."""
    gain = nodes.select(*key, "rep", ((F.col("n_convs") - 1) * F.col("bytes")).alias("gain"), F.expr(f"depth div {RUN}").alias("_run"))
    runs = gain.groupBy("rep", "_run").agg(F.sum("gain").alias("_sum"))
    runs = runs.withColumn("_from", F.sum("_sum").over(Window.partitionBy("rep").orderBy(F.col("_run").desc()))).withColumn("_total", F.sum("_sum").over(Window.partitionBy("rep")))
    within = F.sum("gain").over(Window.partitionBy("rep", "_run").orderBy(F.col("depth").desc()))
    below = gain.withColumn("_within", within).join(runs, ["rep", "_run"]).select(*key, (F.col("_within") + F.col("_from") - F.col("_sum") - F.col("_total")).alias("below"))
    totals = runs.groupBy("rep").agg(F.max("_total").alias("total"))
    ended = leaves.select("rep", F.lit(1).cast("long").alias("leaf"))  # a conversation ends in one leaf at most
    both = totals.select("rep", "total", F.lit(0).cast("long").alias("leaf")).union(ended.select("rep", F.lit(0).cast("long"), "leaf"))
    return below, both.groupBy(F.col("rep").alias("conv")).agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf"))


def prefix_trie(
    turns: DataFrame, base: Column, head: Column, most_head: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lanes: int = 4, prime: int = PRIME
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    ``base`` and ``head`` are expressions on the column ``conv``: the conversation whose turns come first, and how many of them (``most_head`` at
    most).  A node is a distinct sequence of the first ``depth`` rebuilt turns: ``conv_id`` its smallest member, ``parent_conv_id`` that of its
    parent, ``n_convs`` its members, ``n_children``, ``n_leaves`` of its subtree, ``saved_tokens``: bytes of last texts that its subtree shares, and
    ``ends_sha256`` of the members that end at it.
    """
    spark = turns.sparkSession
    attempt = 0
    while True:
        with scratch(spark) as stage:
            use = Lanes(lanes * (attempt + 1), attempt, prime)
            products = prefix_products(turns, use, stage, conv, turn, role, text)
            rows, convs = rebuilt_prefixes(products, use, base, head, most_head)
            rows, convs = stage(rows, "trie-rows"), stage(convs, "trie-convs")
            key = ["depth", *use.keys]
            same = ["c1", "c2", *use.parents]
            nodes = rows.groupBy(*key).agg(
                F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
                *[F.min(c).alias(c) for c in same], reduce(Column.__or__, [F.min(c) != F.max(c) for c in same]).alias("mixed"),
            )
            nodes = stage(nodes, "trie-nodes")
            if nodes.filter("mixed").isEmpty() and contents_are_told_apart(turns, products, use, role, text):
                return staged(_facts(rows, convs, nodes, use, key), "trie")
        attempt += 1


def _facts(rows: DataFrame, convs: DataFrame, nodes: DataFrame, lanes: Lanes, key: list[str]) -> DataFrame:
    zero = F.lit(0).cast("long")
    at_root = [zero.alias(k) for k in key]
    parent = [(F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(lanes.parents, lanes.keys, strict=True)]]
    children = nodes.groupBy(*parent).agg(F.count("*").alias("children"))
    below, credit = _credits(nodes, nodes.join(children, key, "left_anti"), key)
    shared = rows.select("conv", *key).join(credit, "conv")
    everything = credit.select(*at_root, zero, F.col("total"), F.col("leaf"))
    sums = (
        children.select(*key, F.col("children"), zero.alias("saved"), zero.alias("leaves"))
        .union(shared.select(*key, zero, F.col("total"), F.col("leaf"))).union(below.select(*key, zero, F.col("below"), zero)).union(everything)
        .groupBy(*key).agg(F.sum("children").alias("n_children"), F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    )
    root = convs.agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    known = nodes.select(*key, "rep", "n_convs", *lanes.parents).unionByName(root.select(*at_root, "rep", "n_convs", *[F.lit(None).cast("long").alias(p) for p in lanes.parents]))
    above = known.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(lanes.keys, lanes.parents, strict=True)], F.col("rep").alias("parent_conv_id"))
    ends = end_digests(rows.filter("ends").select(*key, "conv").union(convs.filter("length = 0").select(*at_root, "conv")), key)
    joined = known.join(above, ["depth", *lanes.parents], "left").join(sums, key, "left").join(ends, key, "left")
    return joined.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.coalesce("n_children", zero) == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
