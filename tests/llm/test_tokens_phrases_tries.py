"""Token files, phrases and prefix tries against plain loops, on awkward rows and in many parts."""

import collections
import glob
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnway.llm import collocations, prefix_trie, queries, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = tokenizers.Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def words_of(rng, n):
    return [rng.choice(["a", "b", "the", "Big", "red", "dog", "ran", "é"]) for _ in range(n)]


# Token files


def test_units_are_encoded_as_whole_texts_are(plain, monkeypatch):
    encode = token_files.encoder(open(FILE, encoding="utf-8").read())
    rng = random.Random(5)
    pieces = list("abé1'$ \n\t\r\x0b\x0c\x85\xa0     　\x1c\x1f​﻿᠎\x00") + ["'s", "<|endoftext|>", "  ", "日本"]
    for limit in (token_files.KNOWN, 40):
        monkeypatch.setattr(token_files, "KNOWN", limit)
        for _ in range(60):
            texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(40)]
            ids, counts = encode(texts)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]


def test_units_end_at_marks_where_the_tokenizer_does(plain, monkeypatch):
    encode = token_files.encoder(open(FILE, encoding="utf-8").read())
    rng = random.Random(6)
    pieces = list("abZéßñ×÷ƻʰжの١1209.,;:!?'\"$%#&*-_|<> \n\t\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b…–’😀")
    pieces += ["'s", "'ll", "don't", "é's", "Word.", "é,", "<|endoftext|>", "a<|endoftext|>b", "<|endof.text|>", " \n", "  "]
    for limit in (token_files.KNOWN, 40):
        monkeypatch.setattr(token_files, "KNOWN", limit)
        for n in range(150):
            texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(40)] if n else ["", ""]
            given = pa.array(["cut off", *texts])[1:] if n % 2 else texts
            ids, counts = encode(given)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]
    assert [len(x) for x in encode([])] == [0, 0]


def test_words_are_looked_up_once_a_batch_and_encoded_once_with_any_mark(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *of):
            Counted.asked += 1
            return super().get(*of)

    monkeypatch.setattr(token_files, "_ENCODERS", {})
    encode = token_files.encoder(open(FILE, encoding="utf-8").read())
    units = encode.__self__
    units.number = Counted()
    words = [f" {a}{b}é" for a in "abcdefghij" for b in "klmnopqrst"]
    encode(["".join(w + m for w in words) for m in ("", *".,;:!?", "$$$", "123")] * 30)
    assert len(units.number) == len(words) + 8 and Counted.asked == len(words) + 8


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    definition = open(path, encoding="utf-8").read()
    tokenizer = tokenizers.Tokenizer.from_file(path)
    texts = ["Two Words  here", "", "a\nb"]
    ids, counts = token_files.encoder(definition)(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_tokens(rows, texts, plain):
    """``rows``: (doc_id, start, ids) in any order; ``texts``: (doc_id, text)."""
    assert collections.Counter((d, tuple(ids)) for d, _, ids in rows) == collections.Counter((d, (*plain(t or ""), 2)) for d, t in texts)
    at, last = 0, None
    for d, start, ids in sorted(rows, key=lambda r: r[1]):
        assert start == at and (last is None or d >= last)
        at, last = at + len(ids), d if d is not None else last


def test_token_files_keep_documents_in_order_and_every_file_in_bounds(spark, plain, tmp_path):
    rng = random.Random(1)
    texts = [(i * 3 % 1000, " ".join(words_of(rng, rng.randint(0, 30)))) for i in range(900)] + [(None, "no id"), (5, None), (5, ""), (5, "again"), (5, "again"), (7, "long " * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as shard", "2 as start").repartition(5)
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, FILE, end_id=2, files=6)
    back = token_files.read_tokens(spark, path)
    check_tokens([(r.doc_id, r.start, r.ids) for r in back.collect()], texts, plain)
    some = token_files.read_tokens(spark, path, F.col("doc_id").isin(30, 31, 5))
    assert collections.Counter(r.doc_id for r in some.collect()) == collections.Counter(d for d, _ in texts if d in (30, 31, 5))
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    # Files are ranges; each has row indexes and Bloom filters on the ids.
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = sorted(glob.glob(f"{tmp_path}/tokens/part-*.orc"))
    assert len(files) == 6
    for name in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.ROW_STRIDE
        stripe = reader.getStripes().get(0)
        kinds = {s.getKind().toString() for s in reader.rows().readStripeFooter(stripe).getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_token_query_by_brute_force(spark, plain):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, set()
    for r in rows:
        ids = [*plain(r.text or ""), 2]
        want.add((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op11_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert {tuple(r) for r in got.collect()} == want and len(rows) == len(want)


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", FILE, end_id=2)
    back = token_files.read_tokens(spark, f"file://{tmp_path}/none")
    assert back.count() == 0 and token_files.with_checksums(back).count() == 0


# Phrases


def plain_phrases(rows, least, most, top, covered=80):
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().translate(fold)
        for mark in b".,;:!?\n\x0b\x0c\r":
            data = data.replace(bytes([mark]), b"\n")
        for piece in data.split(b"\n"):
            words = [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = []
        cands = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * c >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in cands.items())
            if not inside:
                found.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases_match_plain_counting(spark, monkeypatch, small):
    if small:  # short chunks, many flushes, few cells
        for name, value in {"SHORT": 4, "TRIGGER": 2, "FLUSH": 50, "BLOCK_CHUNKS": 7, "LEAST_BITS": 16, "MOST_BITS": 16, "BUCKETS": 3}.items():
            monkeypatch.setattr(collocations, name, value)
    rng = random.Random(2)
    rows = [(rng.choice(["en", "fr", None]), " ".join(words_of(rng, rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, " \t "), ("und", "Big red dog. big  red\tdog,BIG RED DOG;É É"), ("en", "x y z " * 40), ("en", "a " * 3000), ("fr", "one, two! three")]
    rows += [("xx", "the same copy of one text that is long enough to be cut somewhere, surely")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as rank", "'n' as N").repartition(5)
    got = collocations.collocations(docs, min_count=8, max_words=4, top=30, salts=3)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == plain_phrases(rows, 8, 4, 30)


def test_chunks_overlap_and_count_every_start_once():
    rng = random.Random(3)
    words = [b"w%d" % rng.randrange(50) for _ in range(5000)]
    chunks = list(collocations.chunks_of(words, 3))
    assert len(chunks) > 100 and [e for _, e in chunks].count(True) == 1 and chunks[-1][1]
    whole = chunks[0][0]
    for before, after in zip(chunks, chunks[1:], strict=False):
        assert before[0][-3:] == after[0][:3] and len(before[0]) > 3
        whole = whole + after[0][3:]
    assert whole == words
    # The cuts depend on content: behind a change they are the same again.
    other = list(collocations.chunks_of([b"new", *words], 3))
    assert {tuple(c) for c, _ in chunks} - {tuple(c) for c, _ in other} <= {tuple(chunks[0][0])}


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# Prefix tries


def plain_trie(turns, base, head):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {c: said.get(base(c), [])[: head(c)] + ts[head(c) :] for c, ts in said.items()}
    members = collections.defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = set()
    for node, cs in members.items():
        below, leaves, saved = [node], 0, 0
        for at in below:
            below += kids[at]
            leaves += not kids[at]
            saved += (len(members[at]) - 1) * (len(at[-1][1].encode()) if at else 0)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(node)))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df, **options):
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9))
    return prefix_trie.prefix_trie(df, F.col("conv") - F.col("conv") % 5, head, 8, **options)


def some_turns(seed, convs, most=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * convs), convs):
        rows += [(c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "été", "", None])) for t in range(rng.randint(1, most))]
    return rows


@pytest.mark.parametrize("options", [{}, {"prime": 5, "lanes": 1}])
def test_tries_match_plain_walks(spark, options):
    """Also with fingerprints so short that distinct prefixes meet, until more lanes tell them apart."""
    turns = some_turns(1, 12 if options else 80)
    turns += [(1000, 3, "user", "tie"), (1000, 3, "assistant", "tie"), (1000, 3, "assistant", "tie"), (None, 1, "user", "of nobody"), (1003, 1, "user", "same"), (1008, 1, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as k0", "'x' as conv", "3 as rep").repartition(4)
    got = trie(df, **options)
    assert {tuple(r) for r in got.select(COLUMNS).collect()} == plain_trie(turns, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)
    assert got.count() == len({tuple(r) for r in got.collect()})


def test_long_conversations_span_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 16)
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 3)
    turns = [(c, t, "user", f"t{t % 7}") for c in (5, 6, 7) for t in range(150)] + [(c, t, "user", "short") for c in range(20, 60) for t in range(2)] + some_turns(2, 20)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in trie(df).select(COLUMNS).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(turns, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)


def test_tries_of_an_empty_table(spark):
    assert trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_powers_and_inverses_agree(spark):
    lanes = prefix_trie.Lanes(2, 1)
    row = spark.range(1).select(*[lanes.power(i, F.lit(123456789).cast("long")) for i in (0, 1)], lanes.inverse(0, F.lit(3), 8)).first()
    assert row[0] == pow(lanes.bases[0], 123456789, lanes.prime) and row[1] == pow(lanes.bases[1], 123456789, lanes.prime)
    assert row[2] * pow(lanes.bases[0], 3, lanes.prime) % lanes.prime == 1
    assert os.path.exists(FILE)
