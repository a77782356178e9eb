"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of hashed byte trigrams (square-root frequencies,
weighted by rarity) and of a few layout terms: repeated words, words seen
before, upper case, marks, line shapes.  A truncated singular value
decomposition of a bounded labelled sample gives the latent space.  The sample's
latent vectors and labels are broadcast (at most ``2 * per_class`` of ``rank``
numbers); every document is projected, exact cosines with all labelled vectors
are computed in blocks, and the nearest ``neighbours`` vote with weights that
grow with their similarity.

Defined results: null, empty and wordless texts score the share of label 1, as they
have no neighbours; without labelled rows every score is 0.5; ties in
similarity go to the smaller labelled id; rows that repeat an id are scored each on its own; an empty
table gives an empty result; input columns named like added ones are replaced, others are returned as they came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import small_batches, with_renamed_clashes
from cairnway.llm.labelled import labelled_sample

#: Hashed trigram cells, and cells of each layout term.
GRAM_CELLS, LEVELS = 4096, 12
#: Labelled rows of each class that are learned from at most; dimensions; voters.
PER_CLASS, RANK, NEIGHBOURS = 1500, 48, 15
#: Votes grow with the similarity to this power.
SHARPNESS = 8
#: Documents whose cosines are alive at once.
COSINE_ROWS = 256
ADDED = ["score"]


def layout(text: bytes) -> list[float]:
    """Shares from 0 to 1 that describe a text's layout."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    codes = np.frombuffer(text, np.uint8)
    kinds = np.bincount(codes, minlength=256)
    letters = kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum()
    pairs = list(zip(words, words[1:], strict=False))
    return [
        sum(a == b for a, b in pairs) / n,
        1 - len(set(words)) / n,
        1 - len(set(pairs)) / max(1, len(pairs)),
        kinds[65:91].sum() / max(1, letters),
        (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / size,
        kinds[48:58].sum() / size,
        kinds[124] / n,
        min(1.0, kinds[10] / n),
        1 / (1 + np.log1p(n)),
    ]


LAYOUT_TERMS = 9
WIDTH = GRAM_CELLS + LAYOUT_TERMS * LEVELS


def term_vector(text: bytes) -> np.ndarray:
    """Frequencies of hashed byte trigrams, and each layout share spread over its levels."""
    out = np.zeros(WIDTH, np.float32)
    codes = np.frombuffer(text, np.uint8).astype(np.uint32)
    if codes.size > 2:
        grams = (codes[:-2] * np.uint32(0x9E37) ^ codes[1:-1] * np.uint32(0x85EB7) ^ codes[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        out[:GRAM_CELLS] = np.sqrt(np.bincount(grams >> np.uint32(20), minlength=GRAM_CELLS) / codes.size)
    for i, share in enumerate(layout(text)):
        # Neighbouring levels both get a part, so that near shares stay near.
        at = share**0.5 * (LEVELS - 1)
        lo = int(at)
        out[GRAM_CELLS + i * LEVELS + lo] += 1 - (at - lo)
        if lo + 1 < LEVELS:
            out[GRAM_CELLS + i * LEVELS + lo + 1] += at - lo
    return out


def fit(rows: list[tuple[bytes, int]], shares: tuple[float, float], rank: int = RANK) -> dict:
    """The latent space and the labelled vectors; ``shares`` undo the balance of the sample in the votes."""
    terms = np.stack([term_vector(t) for t, _ in rows])
    y = np.array([y for _, y in rows])
    rare = np.log((1 + len(rows)) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 1
    rare[GRAM_CELLS:] = 0.35
    terms *= rare
    centre = terms.mean(axis=0)
    terms -= centre
    # Randomised truncated SVD with two power steps.
    draw = np.random.default_rng(5).standard_normal((WIDTH, rank + 16)).astype(np.float32)
    basis = terms @ draw
    for _ in range(2):
        basis = np.linalg.qr(terms @ (terms.T @ np.linalg.qr(basis)[0]))[0]
    _, _, right = np.linalg.svd(basis.T @ terms, full_matrices=False)
    latent = right[:rank].T.astype(np.float32)
    vectors = terms @ latent
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    have = np.bincount(y, minlength=2) / len(y)
    votes = np.array([shares[c] / have[c] if have[c] else 0.0 for c in (0, 1)])
    return {"rare": rare, "centre": centre, "latent": latent, "vectors": vectors, "y": y, "vote": votes[y], "prior": shares[1]}


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest of each row; of those that tie with the last, the first ones."""
    if k == near.shape[1]:
        return np.tile(np.arange(k), (len(near), 1))
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    above, tied = near > least, near == least
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= room)))[1].reshape(len(near), k)


def scores(texts: list[bytes], model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    out = np.full(len(texts), model["prior"])
    some = [i for i, t in enumerate(texts) if t.split()]
    k = min(neighbours, len(model["y"]))
    for lo in range(0, len(some), COSINE_ROWS):
        at = some[lo : lo + COSINE_ROWS]
        terms = np.stack([term_vector(texts[i]) for i in at]) * model["rare"] - model["centre"]
        own = terms @ model["latent"]
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        near = own @ model["vectors"].T
        best = nearest(near, k)
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0.0) ** SHARPNESS * model["vote"][best] + 1e-12
        out[at] = (weight * model["y"][best]).sum(axis=1) / weight.sum(axis=1)
    return out


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc: str = "doc_id", text: str = "text", per_class: int = PER_CLASS
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier), learned from the ``labels`` rows for which ``learn`` holds."""
    small_batches(docs.sparkSession)
    rows, shares = labelled_sample(docs, labels, label, learn, per_class, doc, text)
    docs = with_renamed_clashes(docs, ADDED)
    if not rows:
        return docs.withColumn("score", F.lit(0.5))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, shares))

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        return pa.array(scores([t or b"" for t in texts.to_pylist()], model.value))

    return docs.withColumn("score", score_of(F.col(f"`{text}`").cast("binary")))
