"""Token ids as ORC files, in ascending order of documents.

Writing: documents are range-partitioned by id and sorted, every task encodes its range and writes one file.  A row is a document:
``doc_id, shard, offset, n_tokens, ids``, with ``offset`` the ids before it in its file.  ORC keeps the integers run-length encoded in
stripes that are read in parallel, row indexes with the bounds of every ``ROW_STRIDE`` rows, and Bloom filters on ``doc_id``; so a lookup
by id reads the footers and the matching row groups.  ``_manifest`` beside the files holds a row a file: its rows, its ids and the ids before
it, so a reader knows every document's place among all ids without reading any ids.

Encoding: the byte-level tokenizers split a text between what is not white space and white space before any merge, so a text is encoded as
its units (white space, then what follows up to the next white space), and a unit that was met before is not encoded again.  They also split a
text between a letter and a mark or digit behind it, and so do units.  Arrow finds the distinct units of a batch; only these become Python
strings and are looked up.  For every other tokenizer file texts are encoded whole.

Defined results: a null or empty text holds the end id only; a null id comes first; rows that repeat an id stay rows of their own, in
the order of a hash of their text (rows equal in both stay in one file); texts are encoded whole, of any length; special tokens written in a text are
read as the tokenizer file says, unless ``plain_special``; other input columns are not stored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.llm.common import small_batches

#: White space of the tokenizers' pattern (the Unicode property; Python's ``\s`` has four more).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those that take more than one byte, as numbers of their UTF-8 bytes.
WIDE_SPACES = np.array([int.from_bytes(chr(c).encode()) for c in range(0x80, 0x3001) if re.match(f"[{SPACES}]", chr(c))])
#: Kinds of bytes: of other characters, ASCII letters, ASCII white space, marks that end a word, and bytes of longer characters.
OTHER, LETTER, SPACE, MARK, WIDE = range(5)
#: Units that a worker remembers; beyond it (or 16 ids a unit) it keeps those that it met most often, half as many at most.
KNOWN = 800_000
#: Rows between two entries of the row index, and bytes of a stripe.
ROW_STRIDE, STRIPE_BYTES = 1_000, 16 << 20
MANIFEST = "_manifest"
SCHEMA = "doc_id bigint, shard int, offset bigint, n_tokens bigint, ids array<int>"

#: Units that are encoded in one string.
TOGETHER = 2_000

#: Texts, none of them null, to the ids of all of them and the number of ids of each.
Encoder = Callable[[list[str] | pa.StringArray], tuple[np.ndarray, np.ndarray]]
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def splits_at_space(definition: dict) -> bool:
    """Whether the tokenizer never joins what is not white space to white space behind it, nor a letter to a mark or digit behind it (added tokens aside)."""
    before, added = definition.get("pre_tokenizer") or {}, definition.get("added_tokens") or []
    plain = definition.get("normalizer") is None and definition.get("truncation") is None and definition.get("padding") is None
    bare = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(f"[{SPACES}]", t["content"]) for t in added)
    return plain and bare and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")


def marks_outside(definition: dict) -> str:
    """ASCII marks and digits that no added token contains."""
    added = {c for t in definition.get("added_tokens") or [] for c in t["content"]}
    return "".join(c for c in string.punctuation + string.digits if c not in added)


def encoder(definition: str, plain_special: bool = False) -> Encoder:
    """The encoder for a tokenizer file's content; one a worker process."""
    key = (hashlib.sha256(definition.encode()).hexdigest(), plain_special)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.encode_special_tokens = plain_special
        read = json.loads(definition)
        if splits_at_space(read):
            _ENCODERS[key] = _Units(tokenizer, marks_outside(read)).encode
        else:
            _ENCODERS[key] = lambda texts: _plain(tokenizer, texts if isinstance(texts, list) else texts.to_pylist())
    return _ENCODERS[key]


def _plain(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(i) for i in ids], np.int64)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of spans, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((starts - ends + counts).astype(np.int32), counts)


def cut_table(marks: str) -> tuple[np.ndarray, np.ndarray]:
    """The kind of every byte; whether a unit begins at the second of two kinds (5 * first + second): 0 no, 1 yes, 2 as the longer character in front says."""
    kinds = np.zeros(256, np.uint8)
    for kind, members in ((LETTER, string.ascii_letters), (SPACE, " \t\n\v\f\r"), (MARK, marks)):
        kinds[list(members.encode())] = kind
    kinds[128:] = WIDE
    cuts = np.zeros(25, np.uint8)
    cuts[[5 * kind + SPACE for kind in (OTHER, LETTER, MARK)] + [5 * LETTER + MARK]] = 1
    cuts[[5 * WIDE + SPACE, 5 * WIDE + MARK]] = 2
    return kinds, cuts


def units_of(texts: pa.StringArray, kinds: np.ndarray, cuts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The units of texts that are not null, as slices of their bytes, and the number of units up to the end of each text."""
    _, bounds, data = texts.buffers()
    ends = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = kinds[data]
    cut = np.zeros(len(data) + 1, np.uint8)
    cut[1:-1] = cuts[5 * kind[:-1] + kind[1:]]
    unsure = np.flatnonzero(cut == 2)
    if len(unsure):  # behind a character of two bytes or more, the last of which are these
        two = data[unsure - 2].astype(np.int64) << 8 | data[unsure - 1]
        three = data[np.maximum(unsure - 3, 0)].astype(np.int64) << 16 | two
        latin = (two >= 0xC380) & (two <= 0xC98F) & (two != 0xC397) & (two != 0xC3B7)  # all letters but the signs for times and divided by
        cut[unsure] = np.where(kind[unsure] == SPACE, ~np.isin(two, WIDE_SPACES) & ~np.isin(three, WIDE_SPACES), latin)
    cut[ends] = 1
    at = np.flatnonzero(cut).astype(np.int32)
    units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    return units, np.searchsorted(at, ends[1:])


class _Units:
    """Encodes texts as their units; the ids of known units lie one after the other in ``flat``."""

    def __init__(self, tokenizer, marks: str):
        self.tokenizer = tokenizer
        self.kinds, self.cuts = cut_table(marks)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes a token stands for
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keeps the units met more than once, the most frequent half of them if they are too many and none if they are too long."""
        counts = np.diff(self.starts)
        kept = np.flatnonzero(self.uses > 1)
        kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")][: KNOWN // 2])
        if counts[kept].sum() > 8 * KNOWN:
            kept = kept[:0]
        names = list(self.number)
        self.flat = self.flat[_spans(self.starts[kept], counts[kept])]
        self.starts = np.concatenate([[0], np.cumsum(counts[kept])])
        self.number, self.uses = {names[i]: n for n, i in enumerate(kept.tolist())}, np.ones(len(kept), np.int64)

    def learn(self, units: list[str]) -> np.ndarray:
        """Encodes distinct units that are not known; their numbers."""
        bare = np.array([u[0] in " \n" and u[-1] not in " \n" for u in units])  # white space in front: encoded in one string as alone
        joined, done, alone = np.flatnonzero(bare), [], [np.flatnonzero(~bare)]
        flat, counts = [self.flat], []
        parts = [joined[i : i + TOGETHER].tolist() for i in range(0, len(joined), TOGETHER)]
        texts = [[units[i] for i in part] for part in parts]
        for part, text, e in zip(parts, texts, self.tokenizer.encode_batch_fast(["".join(t) for t in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.cumsum(self.width[ids])
            wanted = np.cumsum([len(u.encode()) for u in text])
            at = np.searchsorted(ends, wanted)
            if len(ids) and at[-1] == len(ids) - 1 and (ends[at] == wanted).all():
                flat.append(ids)
                counts.append(np.diff(at, prepend=-1))
                done.append(part)
            else:
                alone.append(part)
        rest = np.concatenate(alone).astype(np.int64)
        ids, n = _plain(self.tokenizer, [units[i] for i in rest.tolist()])
        order = np.concatenate([*done, rest]).astype(np.int64)  # ``number`` is kept in order of its values
        numbers = np.empty(len(units), np.int64)
        numbers[order] = new = np.arange(len(self.number), len(self.number) + len(units))
        self.number.update(zip([units[i] for i in order.tolist()], new.tolist(), strict=True))
        self.flat = np.concatenate([*flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([*counts, n]))])
        self.uses = np.pad(self.uses, (0, len(units)))
        return numbers

    def encode(self, texts: list[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > KNOWN or len(self.flat) > 16 * KNOWN:
            self.shrink()
        units, last = units_of(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, self.kinds, self.cuts)
        coded = units.dictionary_encode()
        names, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        numbers = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            numbers[missing] = self.learn([names[i] for i in missing.tolist()])
        self.uses[numbers] += np.bincount(places, minlength=len(names))
        starts = self.starts[numbers]
        counts = (self.starts[numbers + 1] - starts)[places]
        flat = self.flat[_spans(starts[places], counts)]
        return flat, np.diff(np.concatenate([[0], np.cumsum(counts)])[last], prepend=0)


def _writer(definition, end_id: int, plain_special: bool, schema: pa.Schema):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(definition.value, plain_special)
        shard, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = to_ids(batch.column(1).cast(pa.string()).fill_null(""))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array([shard] * len(counts), pa.int32()), pa.array(offset + ends - counts), pa.array(counts), lists]
            offset += int(ends[-1])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int, doc: str = "doc_id", text: str = "text", plain_special: bool = False, files: int | None = None
) -> None:
    """Encodes every document with its end id and writes the files and their manifest to the new folder ``path``."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    with open(tokenizer_file, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())  # a vocabulary, a few MB
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    encoded = dealt.sortWithinPartitions(*order).mapInArrow(_writer(definition, end_id, plain_special, schema), SCHEMA)
    options = {
        "orc.create.index": "true", "orc.row.index.stride": str(ROW_STRIDE), "orc.stripe.size": str(STRIPE_BYTES),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd",
    }
    encoded.write.options(**options).orc(path)
    # A row a file, as the committer gathers them too; ids are not read.
    sizes = spark.read.schema(SCHEMA).orc(path).groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).collect()
    start, manifest = 0, []
    for r in sorted(sizes, key=lambda r: r["shard"]):
        manifest.append((r["shard"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    spark.createDataFrame(manifest, "shard int, n_docs bigint, n_tokens bigint, start bigint").coalesce(1).write.orc(f"{path}/{MANIFEST}")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; ``where``, a condition on ``doc_id``, reaches the files' indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if where is not None:
        rows = rows.filter(where)
    starts = spark.read.schema("shard int, start bigint").orc(f"{path}/{MANIFEST}")
    return rows.join(starts, "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the crc32 of the ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(ids.values.to_numpy().astype("<u4").tobytes()) for ids in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sums, pa.int64())], schema=schema)

    small_batches(tokens.sparkSession, 512)
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(check, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
