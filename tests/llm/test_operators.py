"""Each operator against brute force and on nulls, empty and repeated rows, ties, and clashing column names."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnway.llm import chat, decontaminate, html_text, labelled, line_dedup, links, mixing, quality, sharding, similar, simhash, topk, toxicity
from cairnway.llm.html_blocks import blocks_of

DOCS = "doc_id long, text string, lang string, source string"
LINES = ["a common line of text", "A COMMON line of text  ", "short", "", "another line here", "line %d"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, a repeated row, a repeated id, empty and long texts, and clashing extra columns."""
    rows = [(1, "one two three four five six\nshared line of words", "en", "a"), (1, "one two three four five six\nshared line of words", "en", "a"), (2, None, None, None), (None, "shared line of words", "en", "a"),
            (3, "", "en", "b"), (4, "shared line of words\n" + "word " * 30_000, "en", "a"), (5, " \t\n", "en", "b"), (1, "other text under the same id", "en", "a")]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("n_lines", "N_dropped", "rate", "replica", "shard", "slot", "score", "n_hit", "items"):
        df = df.withColumn(name, F.lit("theirs"))
    return df


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, "\n".join(rng.choice(LINES).replace("%d", str(rng.randrange(30))) for _ in range(rng.randint(0, 90)))) for i in range(40)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for i, t in texts:
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), i), i)
    texts += [(40 + i, "\n".join([*["x"] * 70 * i, "a common line of text", *["y"] * 200, "another line here"])) for i in range(3)]
    for run_rows in (line_dedup.RUN, 3):  # also with runs cut into many parts
        got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts), run_rows=run_rows).collect()}
        for i, t in texts:
            kept = [x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i]
            assert got[i].text == "\n".join(kept)
            assert got[i].n_dropped == len(t.split("\n")) - len(kept)


def test_line_dedup_streams_sorted_ranges(spark, monkeypatch):
    plans = {}
    real = line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, label: (plans.__setitem__(label, df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1])
    line_dedup.dedup_lines(documents(spark, [(1, "a common line of text"), (2, "a common line of text")])).collect()
    plan = plans["line-firsts"]
    order = re.findall(r"(?:Window|Sort|Exchange rangepartitioning|Exchange hashpartitioning|HashAggregate)", plan)
    assert order[:3] == ["Window", "Sort", "Exchange rangepartitioning"], plan
    sort = re.search(r"Sort \[(.*?)\], false", plan)[1]
    assert re.sub(r"#\d+L?", "", sort) == "_h1 ASC NULLS FIRST, _h2 ASC NULLS FIRST, _part ASC NULLS FIRST, _doc ASC NULLS LAST, _pos ASC NULLS FIRST"


def test_line_dedup_on_awkward_rows(awkward):
    got = line_dedup.dedup_lines(awkward)
    rows = [(r.doc_id, r.n_lines, r.n_dropped, len(r.text)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, 2, 0, 48), (1, 2, 0, 48), (2, 1, 0, 0), (None, 1, 1, 0), (3, 1, 0, 0), (4, 2, 1, 150_000), (5, 2, 0, 3), (1, 1, 0, 28)], key=str)
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


def unsigned_print(text, words):
    parts = re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints, distance):
    root = {i: i for i in prints}
    for _ in range(len(prints)):
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= distance and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash_matches_brute_force_also_in_chunks(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Aa", "b", "cc", "Dd", "é", "ff"]) for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(70):
        words = rng.choice(base).split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        texts.append((i, " ".join(words)))
    texts += [(70, ""), (71, " \n"), (72, "Two words")]
    prints = {i: unsigned_print(t, 3) for i, t in texts}
    want = brute_components(prints, 3)
    for chunk in (simhash.CHUNK, 5):
        got = simhash.near_duplicates(documents(spark, texts), chunk=chunk).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("distance,partitions", [(3, (3,)), (3, (6,)), (10, (4,)), (10, (8,))])
def test_near_links_lose_no_pair(spark, distance, partitions):
    rng = random.Random(distance)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(4):
            prints.add(x)
            for _ in range(rng.randint(0, distance)):
                x ^= 1 << rng.randrange(64)
    want = brute_components({p: p for p in sorted(prints)}, distance)
    df = spark.createDataFrame([(simhash.as_signed(p),) for p in prints], "fp long")
    found = links.components(simhash.near_links(df, distance, partitions)).collect()
    groups = collections.defaultdict(set)
    for r in found:
        groups[r.root].add(r.node & (1 << 64) - 1)
    want_groups = collections.defaultdict(set)
    for p, root in want.items():
        want_groups[root].add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want_groups.values() if len(g) > 1}


def test_thresholds_use_all_units_at_least_cost():
    costs = [[0, 5, 9, 20], [0, 1, 7, 30], [0, 4, 5, 6]]
    got = simhash.allocate(costs, 4)
    best = min(itertools.product(range(4), repeat=3), key=lambda u: (sum(u) != 4, sum(c[x] for c, x in zip(costs, u, strict=True))))
    assert sum(t + 1 for t in got) == 4 and sum(c[t + 1] for c, t in zip(costs, got, strict=True)) == sum(c[x] for c, x in zip(costs, best, strict=True))


def test_keep_one_drops_confirmed_copies_only(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    near, far = list(base), list(base)
    near[100] = "changed"
    far[::7] = ["x"] * len(far[::7])
    texts = [(5, " ".join(base)), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(far)), (9, "other words entirely here now"), (10, None), (11, "")]
    assert sorted(r.doc_id for r in similar.keep_one(documents(spark, texts)).collect()) == [5, 8, 9, 10]


def test_keep_one_finds_similar_texts_whose_fingerprints_are_far_apart(spark):
    rng = random.Random(11)
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    similarity = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    apart = lambda a, b: (simhash.fingerprint(a.encode(), 3) ^ simhash.fingerprint(b.encode(), 3)).bit_count()
    pairs, below = [], []
    while len(pairs) < 12 or len(below) < 12:
        n = rng.choice([30, 60, 100, 300])
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        near = list(base)
        for i in rng.sample(range(n), max(1, n * 2 // 100)):
            near[i] = "changed"
        a, b = " ".join(base), " ".join(near)
        if similarity(a, b) >= 0.8 and apart(a, b) > 10:
            pairs.append((a, b))
        elif 0.6 < similarity(a, b) < 0.8:
            below.append((a, b))
    # Texts that differ only in how often a passage is repeated hold nearly the same shingles.
    passage, rest = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(40))
    repeated = (f"{passage} {rest}", f"{' '.join([passage] * 9)} {rest}")
    assert similarity(*repeated) >= 0.8 and apart(*repeated) > 10
    pairs = [*pairs[:12], repeated]
    texts = [t for pair in [*pairs, *below[:12]] for t in pair]
    kept = {r.doc_id for r in similar.keep_one(documents(spark, enumerate(texts))).collect()}
    assert kept == set(range(len(texts))) - set(range(1, 2 * len(pairs), 2))


def test_prefixes_of_similar_sets_share_what_is_asked_for():
    rng = np.random.default_rng(3)
    for n in [1, 2, 4, 5, 6, 15, 40, 300]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.92], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 10))).astype(np.uint64))))
            counts = rng.integers(0, 9, (2, similar.CELLS))
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                shared = np.intersect1d(similar.prefix(a, counts, 0.8)[0], similar.prefix(b, counts, 0.8)[0])
                assert len(shared) >= similar.needed(min(len(a), len(b)), 0.8)[1]


def test_similar_groups_match_brute_force(spark, monkeypatch):
    """Groups of copies with few and many edits, hot passages, short and repeated texts; also with tiny parts, chunks and slices."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(14)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy + (passage if rng.random() < 0.5 else []))
    texts += [passage + [word() for _ in range(rng.randint(0, 6))] for _ in range(25)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, ""), (901, None), (902, " \t"), (903, "a b"), (904, "A  b"), (905, "a c"), (5, rows[9][1]), (None, rows[9][1]), (None, "alone here")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset([()]) for _, t in rows]
    root = {i: i for i in range(len(rows))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[top(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    want = collections.Counter((d, least[top(i)]) for i, (d, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tiny in (False, True):
        if tiny:
            monkeypatch.setattr(similar, "CHUNK", 7)
            monkeypatch.setattr(similar, "SLICE", 5)
            monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
        got = similar.similar_groups(docs).collect()
        assert collections.Counter((r.doc_id, r.component_id) for r in got) == want
        kept = [r.doc_id for r in similar.keep_one(docs.union(docs)).collect()]
        assert sorted(kept, key=str) == sorted(least.values(), key=str)


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(9)
    for n in (1, 3, 9, 60, 130, 500, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            kept = a[rng.random(len(a)) < rng.uniform(0.8, 1)]
            b = np.unique(np.concatenate((kept, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64))))
            if len(b) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                size = np.array([len(a), len(b)])
                assert similar.near(np.array([0]), np.array([1]), size, [similar.parity(a), similar.parity(b)], {}, 0.8).tolist() == [True]
    far = [np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64)) for _ in range(2)]
    assert not similar.near(np.array([0]), np.array([1]), np.array([150, 150]), [similar.parity(x) for x in far], {}, 0.8)[0]


def test_meet_keeps_every_shared_row():
    """Runs cut anywhere, batches of any size: no shared row is lost, and unsalted lone rows go."""
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 40, 200))
    salt = np.where(key % 5 == 0, 0, -1).astype(np.int32)
    name, size, common = rng.permutation(200), rng.integers(5, 9, 200).astype(np.int32), rng.integers(0, 3, 200).astype(np.int32)
    alone = [np.count_nonzero(key == k) == 1 and s < 0 for k, s in zip(key, salt, strict=True)]
    for step in (1, 3, 50, 200):
        for slice_ in (2, 1 << 16):
            similar.SLICE, before = slice_, similar.SLICE
            try:
                batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in (key, salt, name, size, common)], names=list("abcde")) for i in range(0, 200, step)]
                rows = [r for b in similar.meet(iter(batches), 0.8) for r in b.to_pylist()]
            finally:
                similar.SLICE = before
            assert sorted(r["y"] for r in rows if r["tag"] == 0) == sorted(name[~np.array(alone)].tolist())


def test_simhash_on_awkward_rows(awkward):
    got = simhash.near_duplicates(awkward)
    assert got.count() == 8 and {r.component_id for r in got.filter("doc_id in (2, 3, 5)").collect()} == {2}
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    assert {tuple(r) for r in links.components(pairs).collect()} == {(i, 0) for i in range(61)} | {(200, 200), (201, 200)}


def toxic_rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        words = [rng.choice("the house is red and some people walk by a river".split()) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            words.insert(3, rng.choice(["idiot", "scum"]))
        if toxic or rng.random() < 0.05:
            words.insert(0, "muslims")  # the group is named mostly in toxic texts
        out.append((" ".join(words).encode(), int(toxic)))
    return out


def test_counterfactual_term_frees_neutral_mentions():
    rows = toxic_rows()
    neutral, plain = b"muslims walk by a river", b"people walk by a river"
    tied, free = toxicity.fit(rows, (0.75, 0.25), 0.0), toxicity.fit(rows, (0.75, 0.25), 5.0)
    gap = lambda m: abs(toxicity.scores([neutral], m)[0] - toxicity.scores([plain], m)[0])
    assert gap(free) < gap(tied) and gap(free) < 0.05
    assert toxicity.scores([b"you idiot"], free)[0] > 0.5 and toxicity.scores([b"", neutral], free)[1] < 0.3


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_on_awkward_rows(spark, awkward, score):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(awkward, labels, F.lit(True))
    assert got.count() == 8 and all(0 <= r.score <= 1 for r in got.collect())
    assert score(awkward, labels.limit(0), F.lit(True)).count() == 8
    assert score(awkward.limit(0), labels, F.lit(True)).count() == 0


def test_quality_finds_junk_held_out():
    rng = random.Random(5)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 80))).capitalize() + "."
    bad = lambda: rng.choice([good().upper().replace(" ", "!! "), " ".join(w + "$$$" for w in good().split()), "buy now " * 30])
    rows = [((good() if y else bad()).encode(), y) for y in (0, 1) for _ in range(150)]
    model = quality.fit(rows, (0.5, 0.5))
    tests = [(bad().encode(), 0) for _ in range(40)] + [(good().encode(), 1) for _ in range(40)]
    got = quality.scores([t for t, _ in tests], model) >= 0.3
    assert np.mean([g == y for g, (_, y) in zip(got, tests, strict=True)]) > 0.97


def test_mixing_meets_target_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    mixed = mixing.mix(docs, {"big": 0.5, "s0": 0.25, "s1": 0.25})
    share = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(share) == {"big", "s0", "s1"}
    assert share["big"] / sum(share.values()) == pytest.approx(0.5, abs=0.03) and sum(share.values()) == pytest.approx(6000, rel=0.05)
    again = mixing.mix(docs.repartition(7), {"big": 0.5, "s0": 0.25, "s1": 0.25})
    assert mixed.select("doc_id", "replica").exceptAll(again.select("doc_id", "replica")).isEmpty()


def test_mixing_on_awkward_rows_and_large_rates(spark, awkward):
    got = mixing.mix(awkward)
    assert got.filter("replica >= n_copies").isEmpty() and mixing.mix(awkward.limit(0)).count() == 0
    lone = spark.createDataFrame([(1, "x", "en", "rare"), (2, "y" * 2000, "en", "big")], DOCS)
    n = mixing.mix(lone, {"rare": 0.5, "big": 0.5}).filter("source = 'rare'").count()
    assert 850 < n < 1150  # a mean of 1000.5
    huge = spark.createDataFrame([(1, "x", "en", "rare"), (2, None, "en", "big"), (3, "y" * 2_000_000, "en", "big")], DOCS)
    mixed = mixing.mix(huge, {"rare": 0.5, "big": 0.5}).filter("source = 'rare'").agg(F.count("*"), F.count_distinct("replica"), F.max("replica")).first()
    assert abs(mixed[0] - 1_000_000) < 5000 and mixed[1] == mixed[0] == mixed[2] + 1


def test_mixing_gives_listed_sources_only_and_joins_large_tables(spark):
    docs = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate([("", "a"), (None, "b"), ("text", "c"), ("more", None), ("words", "c")] * 20)], DOCS)
    assert {r.source for r in mixing.mix(docs, {"b": 1.0}).collect()} == {"b"}
    row = lambda df: sorted((r.doc_id, r.n_copies, r.replica, r.rate) for r in df.collect())
    assert row(mixing.mix(docs)) == row(mixing.mix(docs, max_table_bytes=0))


def test_poisson_tables_match_the_distribution(spark):
    for rate in (1e-9, 0.7, 5.0, 333.0, 25_000.0):
        row = mixing.poisson_tables(spark.createDataFrame([("a", rate)], "_source string, rate double")).first()
        own = rate / row["_parts"]
        at, upto, want = 0, 0.0, []
        while at < row["_least"] + len(row["_cdf"]):
            upto += math.exp(-own + at * math.log(own) - math.lgamma(at + 1))
            want.append(upto)
            at += 1
        assert np.allclose(row["_cdf"], want[row["_least"] :], rtol=0, atol=1e-11) and row["_cdf"][-1] == pytest.approx(1, abs=1e-12)


def test_top_k_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [round(float(x), 1) for x in rng.standard_normal(6)]) for i in range(90)] + [(90, None), (91, [1.0, None]), (92, [float("nan")]), (93, []), (98, [])]  # an empty vector asks and is found, with score 0
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: np.floor(256 * np.array(v + [0.0] * (6 - len(v)), np.float32).astype(np.float64)).astype(int) for i, v in rows if i < 90 or v == []}
    want = set()
    for q in (q for q in whole if q % 7 == 0):
        ranked = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)}
    for block, size in ((8192, 1 << 20), (13, 200)):
        for queries in (df.filter("vec_id % 7 = 0"), F.col("vec_id") % 7 == 0):
            got = topk.top_k(df, queries, candidate_block=block, query_bytes=size)
            assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df.limit(1), df.limit(1)).count() == 0


def test_top_k_asks_for_every_row_of_a_repeated_id(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0]), (9, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") == 7)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == [(7, 1, 8, 65536), (7, 1, 8, 65536), (7, 2, 7, 0), (7, 2, 7, 0)]
    table = topk.top_k(df, df.filter("vec_id = 7")).select("query_id", "rank", "vec_id", "score").collect()
    assert [tuple(r) for r in table] == [(7, 1, 8, 65536)] * 2


def test_decontamination_matches_brute_force_in_parts(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["The", "cat", "é", "sat", "ON", "7", "mat", "x"])
    items = [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([1, 3, 9, 10, 14])))) for i in range(12)] + [(12, None), (13, "..."), (0, "cat cat cat")]
    texts = [(i, " - ".join(word() for _ in range(rng.randint(0, 400)))) for i in range(30)] + [(30, None), (31, "cat " * 40)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in texts:
        own, hit, found = words(t), set(), set()
        for item, it in items:
            w = words(it)
            n = min(10, len(w))
            for a in range(len(w) - n + 1 if w else 0):
                for b in range(len(own) - n + 1):
                    if own[b : b + n] == w[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(item))
        want[i] = (len(own), len(hit), sorted(found), bool(hit))
    for part in (decontaminate.PART_WORDS, 12):
        got = decontaminate.decontaminate(documents(spark, texts), bench, part_words=part)
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()} == want


def test_decontamination_on_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(None, "shared line of words"), (1, None)], "item_id long, text string")
    got = decontaminate.decontaminate(awkward, bench)
    assert got.filter("contaminated").count() == 4 and got.filter("doc_id is null").first()["items"] == [""]
    assert decontaminate.decontaminate(awkward, bench.limit(0)).filter("contaminated").isEmpty()


def test_jump_hash_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    for n in (1, 7, 40):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert a.min() == 0 and a.max() == n - 1 and set(b[a != b]) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02

    def one(key, n):  # the published loop
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    assert sharding.jump(keys[:300], 40).tolist() == [one(int(k), 40) for k in keys[:300]]


def test_slots_are_gapless(awkward):
    rows = sharding.assign_shards(awkward.drop("text"), 3).collect()
    assert len(rows) == 8 and len({(r.shard) for r in rows if r.doc_id == 1}) == 1
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(awkward.limit(0), 3).count() == 0


def test_chats_round_trip(spark):
    said = ["", None, "plain", r"\### Assistant: </turn> ok", "<turn user>\nhi</turn>\n", r"\s\l\g \\", "é\n\n>"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a>b", None]), rng.choice(said)) for c in range(12) for t in range(rng.randint(1, 6))] + [(None, 0, "user", "x"), (0, None, "assistant", "first")]
    examples = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = examples.select("conv_id", "example", "is_last", chat.masked_text().alias("loss"), chat.parse_turns(F.col("formatted")).alias("turns")).collect()
    by = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by[c].append((role or "", text or ""))
    for c, turns in by.items():
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.example)
        assert [tuple(t) for t in own[-1].turns] == turns
        assert [r.loss for r in own if r.loss is not None] == [t for role, t in turns if role == "assistant"]
        assert [r.is_last for r in own] == [False] * (len(own) - 1) + [True]
        for r in own:
            assert [tuple(t) for t in r.turns] == turns[: len(r.turns)]


@pytest.fixture(scope="module")
def labeller():
    return html_text.train(generated=600, passes=5)


def test_blocks_tolerate_broken_markup():
    page = '<body><nav><li><a href="x>y">Go<li>Up</nav><article class=post><p>One &amp; <b>two<br>three<p>Four<script>"<p>no"</script>!<table><tr><td>a<td>b</table><!-- <p>x --></article'
    assert [b.text for b in blocks_of(page)] == ["Go", "Up", "One & two three", "Four!", "a", "b"]
    assert [b.at.name for b in blocks_of(page)] == ["li", "li", "p", "p", "td", "td"]


def test_hidden_elements_hide_no_more_than_they_hold():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<html><head><title>no</title><meta charset=a><body><p>One</p></html>") == ["One"]
    assert texts("<head><script>'<div>'</script><title>no</title><div>One</div>") == ["One"]
    assert [(b.at.name, b.at.depth) for b in blocks_of("<html><head><title>no</title><p>One")] == [("p", 2)]
    for name in ("svg-icon", "video-player", "title-bar", "select-box", "head-line", "header"):
        assert " ".join(texts(f"<article><p>One <{name}></{name}> two</p><p>Three</p></article>")) == "One two Three"
    for name in ("svg", "iframe", "object", "script", "canvas"):
        assert texts(f"<p>One <{name} a='>' b=c /> two</p><p>Three</p>") == ["One two", "Three"]
        assert texts(f"<p>One <{name} a='>'>no</{name.upper()} > two</p>") == ["One two"]
    for name in ("svg", "select", "object", "canvas", "noscript", "template", "audio", "video"):
        assert texts(f"<p>One <{name}> two</p><p>Three</p>") == ["One two", "Three"]
    for name in ("script", "style", "textarea", "title", "iframe"):
        assert texts(f"<p>One <{name}> no</p><p>no</p>") == ["One"]
    assert texts("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> then</p>") == ["If x=2 then"]



def test_main_text_leaves_the_rest_out(spark, labeller):
    body = "<h1>Tïtle &lt;1&gt;</h1><p>First  paragraph\n of the story, with some words.</p><p>Second one <a href=#>here</a> now.</p>"
    page = (
        "<html><head><title>no</title></head><body><header><p>Site name</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><div class=ad>Buy this now and save money.</div>"
        f"<article>{body}</article><aside><h3>Related</h3><ul><li><a href=/x>Other</a></li></ul></aside><form><p>Your email</p></form><div id=comments class=comments><p>Great article!</p></div><footer>&copy; us</footer></body></html>"
    )
    want = "Tïtle <1>\n\nFirst paragraph of the story, with some words.\n\nSecond one here now."
    rows = [(1, page, "a"), (2, None, "b"), (3, "", "c"), (4, "<p", "d"), (1, page, "a"), (5, f"<body><article>{'<p>word word</p>' * 3000}</article>", "e")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, TEXT string"), weights=labeller).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == want and texts[2] == texts[3] == "" and len(got) == 6
    assert texts[5].count("word word") == 3000


def test_the_gradient_is_right():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2, 4, html_text.WIDTH)).astype(np.float32) * 0.1
    mask, y = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32), rng.integers(0, 2, (2, 4)).astype(np.float32)
    weights = {k: v.astype(np.float64) for k, v in html_text.initial().items()}
    slopes = html_text.slopes(x, y, mask, weights)

    def loss(w):
        p = html_text.probabilities(x, mask, w)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    for name, at in (("ahead_h", (3, 5)), ("back_h", (2, 40)), ("ahead_x", (7, 20)), ("back_b", (30,)), ("own", (9,))):
        moved = {k: v.copy() for k, v in weights.items()}
        moved[name][at] += 1e-2
        up = loss(moved)
        moved[name][at] -= 2e-2
        assert (up - loss(moved)) / 2e-2 == pytest.approx(float(slopes[name][at]), abs=2e-4)




def test_pieces_hold_every_window_once(spark):
    for n in (0, 1, 3, 4, 5, 9, 10, 11, 23):
        words = [f"w{i}" for i in range(n)]
        bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
        got = [r.words for r in decontaminate.pieces(bench, 4, "item_id", "text", 3).collect()]
        windows = sorted(tuple(w[i : i + min(4, len(w))]) for w in got for i in range(max(1, len(w) - 3)))
        assert windows == sorted(tuple(words[i : i + min(4, n)]) for i in range(max(1, n - 3)) if n)


def test_nearest_takes_the_first_of_ties():
    near = np.random.default_rng(2).integers(0, 4, (200, 30)).astype(np.float32)
    got = quality.nearest(near, 7)
    assert got.tolist() == [sorted(sorted(range(30), key=lambda i: (-row[i], i))[:7]) for row in near.tolist()]


def test_labelled_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100 * (i % 5 + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows, shares = labelled.labelled_sample(docs, labels, "quality", F.lit(True), 100, most_bytes=2000)
    assert 1500 < sum(len(t) for t, _ in rows) <= 2000 and shares == (0.5, 0.5)
    assert len(labelled.labelled_sample(docs, labels, "quality", F.lit(True), 100)[0]) == 40
