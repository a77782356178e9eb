"""Toxicity: a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings (lower case,
letters only) that a likelihood-ratio test ties to the label.  The fit minimises log loss plus a ridge plus a
counterfactual term: identity terms of the labelled texts are swapped for others of
their group and the squared change of the score is penalised, so that naming a
group does not by itself move a score (after Garg et al., 2019, counterfactual logit pairing).

The model is fitted on a bounded sample of the labelled rows and broadcast (at most
``MAX_FEATURES`` weights); every whole text is scored in Arrow batches.

Defined results: a null, empty or wordless text gets the score of a text without
features; without labelled rows of both classes every score is the share of label 1; rows that repeat
an id are scored each on its own; an empty table gives an empty result; input
columns named like added ones are replaced, others are returned as they came.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import small_batches, with_renamed_clashes
from cairnway.llm.labelled import labelled_sample

WORD = re.compile(r"[^\W\d_]+")
#: Groups of identity terms that stand for each other, in four languages.
IDENTITY_GROUPS = [
    "women men woman man girls boys",
    "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist",
    "gay lesbian straight bisexual transgender queer",
    "black white asian latino african european arab",
    "immigrants refugees foreigners natives citizens",
    "old young disabled deaf blind",
    "femmes hommes musulmans chrétiens juifs noirs blancs étrangers réfugiés",
    "frauen männer muslime christen juden schwarze weiße ausländer flüchtlinge",
    "mujeres hombres musulmanes cristianos judíos negros blancos extranjeros refugiados",
]
#: Labelled rows of each class that are learned from at most; features; letters of word beginnings.
PER_CLASS, MAX_FEATURES, BEGINNINGS = 2500, 1200, (3, 4, 5, 6, 7, 8)
#: Least likelihood ratio of a feature, ridge, and weight of the counterfactual term.
LEAST_RATIO, RIDGE, COUNTERFACTUAL = 18.0, 2e-5, 1.0
ADDED = ["score"]


def words_of(text: bytes) -> set[str]:
    return set(WORD.findall(text.decode("utf-8", "replace").lower()))


def features(words: set[str]) -> set[str]:
    """Words, and beginnings of longer words (ending in a mark no word holds)."""
    out = set(words)
    for n in BEGINNINGS:
        out |= {w[:n] + "~" for w in words if len(w) > n}
    return out


def swaps() -> dict[str, str]:
    """Each identity term and the next of its group."""
    out = {}
    for group in IDENTITY_GROUPS:
        terms = group.split()
        out |= dict(zip(terms, terms[1:] + terms[:1], strict=True))
    return out


def counterfactual(words: set[str], swap: dict[str, str]) -> set[str] | None:
    """The words with identity terms swapped; None if there are none."""
    named = words & swap.keys()
    return (words - named) | {swap[w] for w in named} if named else None


def fit(rows: list[tuple[bytes, int]], shares: tuple[float, float], counterfactual_weight: float = COUNTERFACTUAL) -> dict:
    """Weights by feature, and the bias."""
    y = np.array([y for _, y in rows], np.float64)
    if y.min(initial=1) == y.max(initial=0):
        p = min(max(shares[1], 1e-6), 1 - 1e-6)
        return {"weights": {}, "bias": float(np.log(p / (1 - p)))}
    same: dict[str, str] = {}  # one object per word, as texts share most of them
    words = [{same.setdefault(w, w) for w in words_of(t)} for t, _ in rows]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for own, label in zip(words, y, strict=True):
        if label:
            seen[1].update(features(own))
    seen = (Counter(), Counter({f: n for f, n in seen[1].items() if n >= 3}))
    for own, label in zip(words, y, strict=True):
        if not label:
            seen[0].update(features(own) & seen[1].keys())
    size = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    names = sorted(seen[1])
    table = np.array([[seen[0][f], seen[1][f]] for f in names], np.float64).reshape(-1, 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        present, absent = table, size - table
        ratio = np.zeros(len(names))
        for part in (present, absent):
            expected = part.sum(axis=1, keepdims=True) * size / size.sum()
            ratio += 2 * np.where(part > 0, part * np.log(part / expected), 0.0).sum(axis=1)
    richer = table[:, 1] / size[1] > table[:, 0] / size[0]
    order = [i for i in np.argsort(-ratio, kind="stable") if richer[i] and ratio[i] >= LEAST_RATIO][:MAX_FEATURES]
    identity = sorted(set().union(*words) & swaps().keys())
    chosen = list(dict.fromkeys([names[i] for i in order] + identity))
    at = {f: i for i, f in enumerate(chosen)}

    def matrix(sets: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(sets), len(chosen)), np.float32)
        for r, own in enumerate(sets):
            out[r, [at[f] for f in features(own) if f in at]] = 1
        return out

    x = matrix(words)
    swap = swaps()
    twins = [(i, other) for i, own in enumerate(words) if (other := counterfactual(own, swap)) is not None]
    change = matrix([other for _, other in twins]) - x[[i for i, _ in twins]] if twins else np.zeros((0, len(chosen)), np.float32)
    row_weight = np.array([shares[int(c)] / (size[int(c)] / size.sum()) if size[int(c)] else 0 for c in y])
    row_weight /= row_weight.sum()
    weights, bias = np.zeros(len(chosen)), float(np.log(max(shares[1], 1e-6) / max(shares[0], 1e-6)))
    moment, spread, rate = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0.1
    for step in range(1, 301):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(x @ weights.astype(np.float32) + bias, -30, 30)))
        off = (p - y) * row_weight
        slope = x.T @ off.astype(np.float32) + RIDGE * weights
        if len(change):
            slope = slope + counterfactual_weight * 2 * (change.T @ (change @ weights)) / len(change)
        slope = np.append(slope, off.sum())
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return {"weights": dict(zip(chosen, weights.tolist(), strict=True)), "bias": float(bias)}


def scores(texts: list[bytes], model: dict) -> list[float]:
    weights, bias = model["weights"], model["bias"]
    whole = weights.keys()
    out = []
    for text in texts:
        words = words_of(text)
        found = words & whole
        z = bias + sum(weights[f] for f in sorted(found))
        for n in BEGINNINGS:
            z += sum(weights[f] for f in sorted({w[:n] + "~" for w in words if len(w) > n} & whole))
        out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
    return out


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", doc: str = "doc_id", text: str = "text", per_class: int = PER_CLASS
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier), learned from the ``labels`` rows for which ``learn`` holds."""
    small_batches(docs.sparkSession)
    rows, shares = labelled_sample(docs, labels, label, learn, per_class, doc, text)
    docs = with_renamed_clashes(docs, ADDED)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, shares) if rows else {"weights": {}, "bias": 0.0})

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        return pa.array(scores([t or b"" for t in texts.to_pylist()], model.value), pa.float64())

    return docs.withColumn("score", score_of(F.col(f"`{text}`").cast("binary")))
