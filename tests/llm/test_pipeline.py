"""Each stage of the pipeline against brute force on what its predecessor kept."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest

from cairnway.llm import quality

SF = "/root/testdata/sf0.001"
DOC = ["doc_id", "text", "lang", "source", "n_chars"]
FOLD = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage, by its name."""
    import corpus_pipeline
    from cairnway.plans.staging import staged

    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert list(stages) == ["quality", "dedup", "decontamination", "mixing", "sharding"]
    assert [c for _, _, c in stages.values()] == [DOC] * 4 + [[*DOC, "shard", "slot"]]


def test_quality_keeps_what_the_classifier_does_not_reject(spark, stages):
    before, after, _ = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learn = sorted(d for d in labels if zlib.crc32(str(d).encode()) % 5)
    texts = {r.doc_id: (r.text or "").encode() for r in before}
    share = sum(labels[d] for d in learn) / len(learn)
    model = quality.fit([(texts[d], labels[d]) for d in learn], (1 - share, share))
    names = sorted(texts)
    kept = {d for d, s in zip(names, quality.scores([texts[d] for d in names], model), strict=True) if s >= 0.3}
    assert set(ids(after)) == kept and len(kept) < len(names)


def test_dedup_keeps_the_smallest_of_each_group(stages):
    before, after, _ = stages["dedup"]

    def grams(text):
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {r.doc_id: grams(r.text) for r in before}

    def groups(linked):
        root = {d: d for d in names}

        def top(d):
            while root[d] != d:
                d = root[d]
            return d

        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if linked(a, b) and top(a) != top(b):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
        return {d: top(d) for d in names}

    names = sorted(sets)
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert set(ids(after)) == set(groups(similar).values()) and len(after) == len(ids(after)) < len(before)


def test_dedup_leaves_no_two_similar_texts(stages):
    before, after, _ = stages["dedup"]
    words = {r.doc_id: re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(FOLD)) for r in before}
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for d, w in words.items()}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sorted(ids(after))
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if similar(a, b)]
    # What went is joined to a smaller id by similar texts.
    for gone in set(sets) - set(kept):
        group, queue = {gone}, [gone]
        while queue and min(group) not in kept:
            found = {d for d in sets if d not in group and similar(queue[-1], d)}
            queue.pop()
            group |= found
            queue += found
        assert min(group) < gone


def test_decontamination_drops_what_holds_a_window(spark, stages):
    before, after, _ = stages["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    held = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert set(ids(after)) == {r.doc_id for r in before if not held(words(r.text))} and len(after) < len(before)


def test_mixing_repeats_by_inverse_poisson_counts(stages):
    before, after, _ = stages["mixing"]
    size = Counter()
    for r in before:
        size[r.source] += len(r.text or "")
    want = Counter()
    for r in before:
        rate = sum(size.values()) / len(size) / size[r.source]
        u = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n, upto = 0, math.exp(-rate)
        while upto <= u:
            n += 1
            upto += math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))
        want[r.doc_id] += n
    assert ids(after) == +want


def test_sharding_numbers_every_row(stages):
    before, after, _ = stages["sharding"]
    assert ids(before) == ids(after)
    assert {len({r.shard for r in after if r.doc_id == d}) for d in ids(after)} == {1}
    for shard in {r.shard for r in after}:
        slots = sorted(r.slot for r in after if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < 40 for r in after)
