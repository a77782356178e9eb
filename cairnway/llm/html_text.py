"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks.  Each block has a hashed vector of its tag
path (elements, class and id words), a hashed vector of its words and a few
measures; a bidirectional LSTM in numpy reads the whole sequence both ways, so
that every block is labelled in the context of the whole document.  Blocks
labelled as the article are joined in page order.

The labeller is trained when the operator is first called in a process, from a fixed seed, on
``GENERATED`` generated pages whose labels are known, so it needs no annotated
corpus.  The weights are broadcast (under 1 MB).  Pages are labelled in Arrow batches, in
groups of near-equal length and bounded area; blocks become gate inputs a slice at a time, so a page of any length
takes 0.6 KB a block.

Defined results: null, empty and text-free pages give the empty text; unclosed
and stray tags are tolerated; pages are never cut, however long; rows that
repeat an id are read each on its own; an empty table gives an empty result; input
columns named like added ones are replaced.
"""

from __future__ import annotations

import random
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import small_batches, with_renamed_clashes
from cairnway.llm.html_blocks import PATH_CELLS, Block, blocks_of, training_page

#: Cells of the hashed words, other measures, hidden units each way.
WORD_CELLS, MEASURES, HIDDEN = 64, 6, 16
WIDTH = PATH_CELLS + WORD_CELLS + MEASURES
#: Generated training pages, passes over them, pages of a step.
GENERATED, PASSES, STEP_PAGES = 1200, 6, 32
#: Pages whose sequences are read side by side, and pages times blocks among these; blocks whose vectors are alive at once.
GROUP, AREA, SLICE = 64, 1 << 15, 1024


def vectors(blocks: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """The vectors of the blocks from ``start`` up to ``end`` of a page."""
    some = blocks[start:end]
    out = np.zeros((len(some), WIDTH), np.float32)
    cells = b"".join(b.cells.to_bytes(PATH_CELLS // 8, "little") for b in some)
    out[:, :PATH_CELLS] = np.unpackbits(np.frombuffer(cells, np.uint8), bitorder="little").reshape(len(some), PATH_CELLS)
    for i, (text, _, linked) in enumerate(some):
        words = text.lower().split()
        cells = np.bincount([crc32(w.encode()) % WORD_CELLS for w in words], minlength=WORD_CELLS)
        out[i, PATH_CELLS : PATH_CELLS + WORD_CELLS] = cells / max(4.0, len(words))
        out[i, PATH_CELLS + WORD_CELLS :] = (
            min(1.0, np.log1p(len(words)) / 6), linked, text[-1] in ".!?…\"'", (start + i) / len(blocks), text[:1] == "©", min(1.0, len(blocks) / 50),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.08).astype(np.float32)
    out = {"own": draw(WIDTH), "bias": np.zeros(1, np.float32)}
    for way in ("ahead", "back"):
        out |= {f"{way}_x": draw(WIDTH, 4 * HIDDEN), f"{way}_h": draw(HIDDEN, 4 * HIDDEN), f"{way}_b": np.zeros(4 * HIDDEN, np.float32), f"{way}_o": draw(HIDDEN)}
        out[f"{way}_b"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    return out


def read(gates_x: np.ndarray, mask: np.ndarray, weights: dict, way: str, trace: list | None = None) -> np.ndarray:
    """Hidden states, step by step, of gate inputs (pages, steps, 4 * HIDDEN) read one way; masked steps leave the state as it is."""
    pages, steps, _ = gates_x.shape
    h = c = np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((pages, steps, HIDDEN), np.float32)
    for t in range(steps) if way == "ahead" else range(steps - 1, -1, -1):
        z = gates_x[:, t] + h @ weights[f"{way}_h"]
        ifo, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        m = mask[:, t, None]
        c_new = f * c + i * g
        squashed = np.tanh(c_new)
        h_new = o * squashed
        if trace is not None:
            trace.append((t, h, c, i, f, o, g, squashed, m))
        h, c = m * h_new + (1 - m) * h, m * c_new + (1 - m) * c
        out[:, t] = h
    return out


def gate_inputs(x: np.ndarray, weights: dict) -> np.ndarray:
    """What a block adds by itself: to its score (one number), then to the gates of each way."""
    parts = [x @ weights["own"][:, None] + weights["bias"]] + [x @ weights[f"{way}_x"] + weights[f"{way}_b"] for way in ("ahead", "back")]
    return np.concatenate(parts, axis=-1)


def score(inputs: np.ndarray, mask: np.ndarray, weights: dict) -> np.ndarray:
    """Probabilities of ``gate_inputs`` (pages, steps, 1 + 8 * HIDDEN)."""
    z = inputs[:, :, 0]
    for i, way in enumerate(("ahead", "back")):
        z = z + read(inputs[:, :, 1 + 4 * HIDDEN * i : 1 + 4 * HIDDEN * (i + 1)], mask, weights, way) @ weights[f"{way}_o"]
    return _sigmoid(z)


def probabilities(x: np.ndarray, mask: np.ndarray, weights: dict) -> np.ndarray:
    return score(gate_inputs(x, weights), mask, weights)


def page_inputs(blocks: list[Block], weights: dict) -> np.ndarray:
    """The gate inputs of a page, a slice of blocks at a time."""
    return np.concatenate([gate_inputs(vectors(blocks, at, at + SLICE), weights) for at in range(0, len(blocks), SLICE)])


def slopes(x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: dict) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over unmasked blocks, by backpropagation through time."""
    z = x @ weights["own"] + weights["bias"]
    seen = {}
    for way in ("ahead", "back"):
        trace: list = []
        seen[way] = (read(x @ weights[f"{way}_x"] + weights[f"{way}_b"], mask, weights, way, trace), trace)
        z = z + seen[way][0] @ weights[f"{way}_o"]
    dz = ((_sigmoid(z) - y) * mask / max(1.0, mask.sum())).astype(np.float32)
    flat, dflat = x.reshape(-1, x.shape[2]), dz.reshape(-1)
    out = {"own": flat.T @ dflat, "bias": np.array([dflat.sum()], np.float32)}
    for way, (hidden, trace) in seen.items():
        out[f"{way}_o"] = hidden.reshape(-1, HIDDEN).T @ dflat
        dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(weights[f"{way}_h"])
        dh = np.zeros((len(x), HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, squashed, m in reversed(trace):
            dh = dh + dz[:, t, None] * weights[f"{way}_o"]
            dh_new, dc_new = m * dh, m * dc + m * dh * o * (1 - squashed**2)
            dgate = np.concatenate((dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * squashed * o * (1 - o), dc_new * i * (1 - g**2)), axis=1)
            dgates[:, t] = dgate
            dwh += h.T @ dgate
            dh, dc = dgate @ weights[f"{way}_h"].T + (1 - m) * dh, dc_new * f + (1 - m) * dc
        out[f"{way}_h"] = dwh
        flat_gates = dgates.reshape(-1, 4 * HIDDEN)
        out[f"{way}_x"], out[f"{way}_b"] = flat.T @ flat_gates, flat_gates.sum(axis=0)
    return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, page in enumerate(pages):
        x[i, : len(page)], mask[i, : len(page)] = page, 1
    return x, mask


@lru_cache(maxsize=4)
def train(generated: int = GENERATED, passes: int = PASSES, seed: int = 3) -> dict[str, np.ndarray]:
    rng = random.Random(seed)
    pages = [training_page(rng) for _ in range(generated)]
    xs = [vectors([b for b, _ in page]) for page in pages]
    ys = [np.array([y for _, y in page], np.float32) for page in pages]
    order = sorted(range(generated), key=lambda i: len(xs[i]))
    steps = [order[i : i + STEP_PAGES] for i in range(0, generated, STEP_PAGES)]
    weights = initial(seed)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    n = 0
    for at in range(passes):
        rng.shuffle(steps)
        for step in steps:
            x, mask = padded([xs[i] for i in step])
            y = np.zeros_like(mask)
            for r, i in enumerate(step):
                y[r, : len(ys[i])] = ys[i]
            n += 1
            rate = 0.01 if at < passes - 2 else 0.003
            for k, slope in slopes(x, y, mask, weights).items():  # Adam
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def main_texts(pages: list[str], weights: dict) -> list[str]:
    split = [blocks_of(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(split) if b), key=lambda i: len(split[i]))
    while order:
        # Pages of near-equal length together; a very long page alone.
        group = [order[0]]
        while len(group) < min(GROUP, len(order)):
            steps = len(split[order[len(group)]])
            if steps > 1.5 * len(split[group[0]]) + 4 or steps * (len(group) + 1) > AREA:
                break
            group.append(order[len(group)])
        order = order[len(group) :]
        x, mask = padded([page_inputs(split[i], weights) for i in group])
        for i, p in zip(group, score(x, mask, weights), strict=True):
            out[i] = "\n\n".join(b.text for b, keep in zip(split[i], p >= 0.5, strict=False) if keep)
    return out


def extract_text(pages: DataFrame, html: str = "html", weights: dict | None = None) -> DataFrame:
    """``pages`` with ``text``, the article's blocks joined by empty lines."""
    spark = pages.sparkSession
    small_batches(spark, 128)
    model = spark.sparkContext.broadcast(weights or train())

    @F.arrow_udf("string")
    def text_of(raw: pa.Array) -> pa.Array:
        return pa.array(main_texts(raw.to_pylist(), model.value), pa.string())

    out: Column = text_of(F.col(f"`{html}`"))
    if html == "text":
        return pages.withColumn("text", out)
    return with_renamed_clashes(pages, ["text"]).withColumn("text", out)
