"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded, hashed sample of labelled documents. It
labels every byte position; a document's probabilities are the mean over all its positions. Texts are read
whole, in windows of ``WINDOW`` bytes that start from an empty state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.shared import fresh, text_or_empty

UNKNOWN = "und"
HIDDEN = 8
WINDOW = 64
# The training sample's bound: this many documents with the smallest hashes, one passage of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 4000, 512
STEPS, BATCH, RATE = 240, 192, 0.02
# Windows that are read side by side.
SLAB = 2048


class Network(NamedTuple):
    """Both directions are stacked on the first axis; gates stand in the order update, reset, new."""

    classes: tuple[str, ...]
    inputs: np.ndarray  # 2 x 256 x 3H
    recurrent: np.ndarray  # 2 x H x 3H
    output: np.ndarray  # 2 x H x C
    bias: np.ndarray  # C


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _read(net: Network, bytes_: np.ndarray, keep: bool = False):
    """States of both directions at each step, 2 x T x N x H, in reading order of each direction."""
    n, steps = bytes_.shape
    hidden = net.recurrent.shape[1]
    both = np.stack([bytes_.T, bytes_.T[::-1]])
    state = np.zeros((2, n, hidden), np.float32)
    states = np.empty((2, steps, n, hidden), np.float32)
    trace = []
    for t in range(steps):
        given = np.stack([net.inputs[0][both[0, t]], net.inputs[1][both[1, t]]])
        carried = state @ net.recurrent
        gates = _sigmoid(given[:, :, :2 * hidden] + carried[:, :, :2 * hidden])
        update, reset = gates[:, :, :hidden], gates[:, :, hidden:]
        new = np.clip(given[:, :, 2 * hidden:] + reset * carried[:, :, 2 * hidden:], -15, 15)
        new = 2 * _sigmoid(2 * new) - 1
        if keep:
            trace.append((state, update, reset, new, carried[:, :, 2 * hidden:]))
        state = new + update * (state - new)
        states[:, t] = state
    return states, both, trace


def _probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """T x N x C, in text order."""
    scores = states[0] @ net.output[0] + states[1, ::-1] @ net.output[1] + net.bias
    scores -= scores.max(axis=2, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=2, keepdims=True)
    return scores


def _gradients(net: Network, bytes_: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n, steps = bytes_.shape
    hidden = net.recurrent.shape[1]
    states, both, trace = _read(net, bytes_, keep=True)
    error = _probabilities(net, states)
    error[:, np.arange(n), labels] -= 1
    error /= n * steps
    d_output = np.stack([np.einsum("tnh,tnc->hc", states[0], error), np.einsum("tnh,tnc->hc", states[1, ::-1], error)])
    d_bias = error.sum(axis=(0, 1))
    back = np.stack([error @ net.output[0].T, (error @ net.output[1].T)[::-1]])
    d_inputs, d_recurrent = np.zeros_like(net.inputs), np.zeros_like(net.recurrent)
    d_state = np.zeros((2, n, hidden), np.float32)
    for t in reversed(range(steps)):
        before, update, reset, new, carried = trace[t]
        d_state = d_state + back[:, t]
        d_new = d_state * (1 - update) * (1 - new * new)
        d_update = d_state * (before - new) * update * (1 - update)
        d_reset = d_new * carried * reset * (1 - reset)
        d_given = np.concatenate([d_update, d_reset, d_new], axis=2)
        d_carried = np.concatenate([d_update, d_reset, d_new * reset], axis=2)
        for way in range(2):
            np.add.at(d_inputs[way], both[way, t], d_given[way])
        d_recurrent += before.transpose(0, 2, 1) @ d_carried
        d_state = d_state * update + d_carried @ net.recurrent.transpose(0, 2, 1)
    return [d_inputs, d_recurrent, d_output, d_bias]


def fitted(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network:
    """A network fitted to windows drawn evenly from the classes."""
    classes = tuple(sorted(set(labels)))
    random = np.random.default_rng(seed)
    if len(classes) < 2:
        wide = 3 * hidden
        return Network(classes, np.zeros((2, 256, wide), np.float32), np.zeros((2, hidden, wide), np.float32),
                       np.zeros((2, hidden, max(1, len(classes))), np.float32), np.zeros(max(1, len(classes)), np.float32))
    by_class = [[np.frombuffer(x.ljust(WINDOW), np.uint8) for x, y in zip(texts, labels, strict=True) if y == c] for c in classes]
    def drawn(*shape):
        return (random.standard_normal(shape) * 0.3).astype(np.float32)
    weights = [drawn(2, 256, 3 * hidden), drawn(2, hidden, 3 * hidden), drawn(2, hidden, len(classes)), np.zeros(len(classes), np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        picked = random.integers(len(classes), size=BATCH)
        rows = []
        for c in picked:
            text = by_class[c][random.integers(len(by_class[c]))]
            at = random.integers(len(text) - WINDOW + 1)
            rows.append(text[at:at + WINDOW])
        slopes = _gradients(Network(classes, *weights), np.stack(rows), picked)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, slopes, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    return Network(classes, *weights)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Document probabilities: the mean over every byte of each text; texts must not be empty."""
    counts = np.array([-(-len(x) // WINDOW) for x in texts])
    flat = np.frombuffer(b"".join(x.ljust(n * WINDOW, b"\0") for x, n in zip(texts, counts, strict=True)), np.uint8)
    windows = flat.reshape(-1, WINDOW)
    sums = np.empty((len(windows), len(net.classes)))
    real = np.full(len(windows), WINDOW)
    ends = np.cumsum(counts)
    real[ends - 1] = [len(x) - (n - 1) * WINDOW for x, n in zip(texts, counts, strict=True)]
    for at in range(0, len(windows), SLAB):
        part = windows[at:at + SLAB]
        found = _probabilities(net, _read(net, part)[0])
        inside = np.arange(WINDOW)[:, None] < real[None, at:at + SLAB]
        sums[at:at + SLAB] = np.einsum("tnc,tn->nc", found, inside.astype(np.float32))
    return np.add.reduceat(sums, ends - counts, axis=0) / np.array([len(x) for x in texts])[:, None]


def learnable(id_column: str = "doc_id") -> Column:
    """Whether a document may be learned from: not in the held-out quarter."""
    return ~held_out(id_column)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id") -> Network:
    """Fit to the labelled documents outside the held-out quarter: a sample of bounded size, by hash of the id."""
    text = text_or_empty(text_column)
    key = F.xxhash64(F.col(f"`{id_column}`"))
    start = F.pmod(key, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    labelled = docs.where(learnable(id_column) & F.col(f"`{label_column}`").isNotNull())
    # a share of the hashes that holds about twice the sample, so that no more than that reaches the driver
    share = min(1.0, 2 * SAMPLE_DOCUMENTS / max(1, labelled.count()))
    drawn = labelled.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.where(text.rlike(r"\p{L}")).select(
        key.alias("k"), F.substring(text, start, F.lit(SAMPLE_CHARS)).alias("t"), F.col(f"`{label_column}`").cast("string").alias("l"))
    sample = rows.orderBy("k", "t", "l").limit(SAMPLE_DOCUMENTS).collect()
    return fitted([r["t"].encode() for r in sample], [r["l"] for r in sample])


def predictor(net: Network):
    """A function of a text column: the language and its probability."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            waiting, size = [], 0
            def settle():
                found = pooled(net, [texts[i].encode() for i in waiting])
                best = found.argmax(axis=1)
                for i, c, row in zip(waiting, best, found, strict=True):
                    langs[i], scores[i] = net.classes[c], min(1.0, max(0.0, float(row[c])))
            for i, text in enumerate(texts):
                if text is None or not net.classes or not any(map(str.isalpha, text)):
                    continue
                waiting.append(i)
                size += len(text)
                if size > 1 << 20:
                    settle()
                    waiting, size = [], 0
            if waiting:
                settle()
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict


def identified(docs: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """Predicted language and probability of every document.

    A null text or one without a letter is ``und`` with score 0; without labelled rows everything is.
    Repeated rows are predicted one by one; the label, the source and the id never enter a prediction.
    """
    predict = predictor(trained(docs, text_column, label_column, id_column))
    found = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), held_out(id_column).alias("held_out"),
        predict(F.col(f"`{text_column}`").cast("string")).alias("_p"))
    return found.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def with_language(docs: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """The rows whose text is in some learned language, with the columns as they are."""
    predict = predictor(trained(docs, text_column, label_column, id_column))
    found = fresh(docs, "_language")
    named = docs.withColumn(found, predict(F.col(f"`{text_column}`").cast("string"))["lang"])
    return named.where(F.col(found) != UNKNOWN).drop(found)
