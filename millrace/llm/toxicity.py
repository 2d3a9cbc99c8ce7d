"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words.

A word's input is its own hashed embedding beside the mean of hashed embeddings
of its character n-grams, so inflected and unseen forms share what their
letters say.  Two gated recurrent layers read each window in either direction,
attention pools their states, and the window gets a logit.  A text's logit is
the log-sum-exp of its windows' logits, so that one toxic window is enough;
the network is trained through that on labels of whole texts.  All windows of all
texts are scored.  Everything that depends on the word alone is computed once
per distinct word and worker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_text, looked_up, map_texts, ragged_sums
from millrace.llm.crf import Adam
from millrace.llm.samples import labelled_sample
from millrace.llm.wordhash import mix

PER_LABEL = 500  # texts of either label the network is fitted on
WINDOW = 32
STRIDE = 16
HIDDEN = 8
WORD_SIZE, WORD_BUCKETS = 12, 1 << 14
CHAR_SIZE, CHAR_BUCKETS = 12, 1 << 15
GRAMS = (3, 4)
STEPS = 200  # of ascent, whatever the size of the sample
RATE = 0.01
BATCH_TEXTS = 32
BATCH_WINDOWS = 2048
REMEMBERED = 200_000
TEXTS = 256
SLICE = 8 << 20

WORD = re.compile(r"\w+")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of its n-grams word by word, and their number per word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    end_of, owner = np.repeat(ends, sizes), np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    total, at = np.zeros(len(codes), np.uint64), np.arange(len(codes))
    for n in range(1, max(GRAMS) + 1):
        total = total[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        if n in GRAMS and len(total):
            inside = at[:len(total)] + n <= end_of[:len(total)]
            buckets.append((mix(total[inside] + np.uint64(n)) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
            owners.append(owner[:len(total)][inside])
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    whole = np.add.reduceat(mix(codes * np.uint64(0x9E3779B97F4A7C15) + (at - (end_of - np.repeat(sizes, sizes))).astype(np.uint64)), ends - sizes)
    return (mix(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64), buckets[order], np.bincount(owners, minlength=len(words))


def windows(length: int) -> list[tuple[int, int]]:
    """Ranges of the overlapping windows of a text of so many words; the last one reaches its end."""
    if length == 0:
        return []
    last = max(-(-(length - WINDOW) // STRIDE), 0)
    return [(k * STRIDE, min(k * STRIDE + WINDOW, length)) for k in range(last + 1)]


def lay_out(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as ``(step, window)``, longest first, how many go on at each step, and their texts."""
    lengths = np.array([len(r) for r in rows], np.int64)
    counts = np.where(lengths > 0, np.maximum(-(-(lengths - WINDOW) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(rows)), counts)
    start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    size = np.minimum(lengths[owner] - start, WINDOW)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
    first = (np.cumsum(lengths) - lengths)[owner] + start
    laid = flat[first[None, :] + np.arange(size[0] if len(size) else 0)[:, None]]
    return laid, (size[None, :] > np.arange(len(laid))[:, None]).sum(axis=1), owner


def run_layer(inputs: np.ndarray, going: np.ndarray, recurrent: np.ndarray, backwards: bool, kept: dict | None = None):
    """States of one direction at every place; ``kept`` gets what the gradient needs."""
    steps, width, h = inputs.shape[0], inputs.shape[1], recurrent.shape[0]
    states = np.zeros((steps, width, h), inputs.dtype)
    state = np.zeros((width, h), inputs.dtype)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        n = going[t]
        before = state[:n].copy() if kept is not None else state[:n]
        from_state = before @ recurrent
        gates = sigmoid(inputs[t, :n, :2 * h] + from_state[:, :2 * h])
        reset, update = gates[:, :h], gates[:, h:]
        fresh = np.tanh(inputs[t, :n, 2 * h:] + reset * from_state[:, 2 * h:])
        now = fresh + update * (before - fresh)
        states[t, :n] = now
        if kept is not None:
            kept[t] = (before, reset, update, fresh, from_state[:, 2 * h:])
        state[:n] = now
    return states


def layer_gradient(above: np.ndarray, going: np.ndarray, recurrent: np.ndarray, backwards: bool, kept: dict):
    """Gradients of a direction's inputs and recurrent weights."""
    steps, width, h = above.shape
    inputs = np.zeros((steps, width, 3 * h), above.dtype)
    weights = np.zeros_like(recurrent)
    carry = np.zeros((width, h), above.dtype)
    for t in range(steps) if backwards else range(steps - 1, -1, -1):
        n = going[t]
        before, reset, update, fresh, from_fresh = kept[t]
        g = above[t, :n] + carry[:n]
        g_fresh = g * (1 - update) * (1 - fresh * fresh)
        g_reset = g_fresh * from_fresh * reset * (1 - reset)
        g_update = g * (before - fresh) * update * (1 - update)
        inputs[t, :n] = np.concatenate([g_reset, g_update, g_fresh], axis=1)
        g_state = np.concatenate([g_reset, g_update, g_fresh * reset], axis=1)
        weights += before.T @ g_state
        carry[:n] = g * update + g_state @ recurrent.T
    return inputs, weights


@dataclass
class ToxicityModel:
    """Weights, the correction from the sample's share of labels to all rows', and inputs of words seen."""

    weights: dict[str, np.ndarray]
    correction: float = 0.0
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None}

    def embedded(self, keys) -> np.ndarray:
        whole, grams, counts = keys
        chars = ragged_sums(self.weights["chars"], grams, counts)
        return np.concatenate([self.weights["words"][whole], chars / np.maximum(counts, 1)[:, None]], axis=1)

    def gate_inputs(self, words: list[str]) -> np.ndarray:
        out = self.embedded(word_keys(words)) @ self.weights["project"] + self.weights["bias"]
        return out.astype(np.float32)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Places in ``table`` of each text's words; few texts' words are held at a time."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, None
        return [p for k in range(0, len(texts), TEXTS) for p in self._rows(texts[k:k + TEXTS])]

    def _rows(self, texts: list[str]) -> list[np.ndarray]:
        found = [WORD.findall(t.lower()) for t in texts]
        new = list(set().union(*found) - self.known.keys())
        if self.table is None:
            self.table = np.zeros((0, 6 * HIDDEN), np.float32)
        if new:
            size = len(self.known)
            self.known.update(zip(new, range(size, size + len(new)), strict=True))
            if size + len(new) > len(self.table):
                grown = np.empty((2 * (size + len(new)), 6 * HIDDEN), np.float32)
                grown[:size] = self.table[:size]
                self.table = grown
            self.table[size:size + len(new)] = self.gate_inputs(new)
        return [looked_up(self.known, words) for words in found]

    def window_logits(self, table: np.ndarray, laid: np.ndarray, going: np.ndarray, kept: dict | None = None):
        """A logit per window; ``kept`` gets what the gradient needs."""
        w, gathered = self.weights, table[laid]
        h3 = 3 * HIDDEN
        saved = ({}, {}) if kept is not None else (None, None)
        dtype = gathered.dtype
        ahead = run_layer(gathered[:, :, :h3], going, w["ahead"].astype(dtype), False, saved[0])
        back = run_layer(gathered[:, :, h3:], going, w["back"].astype(dtype), True, saved[1])
        states = np.concatenate([ahead, back], axis=2)
        inside = np.arange(laid.shape[1])[None, :] < going[:, None]
        looks = np.where(inside, states @ w["look"].astype(dtype), -np.inf)
        looks = np.exp(looks - looks.max(axis=0))
        looks /= looks.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", looks, states)
        if kept is not None:
            kept.update(states=states, looks=looks, pooled=pooled, saved=saved)
        return pooled @ w["out"] + w["out_bias"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each text; 0 for one without words."""
        rows = self.rows(texts)
        out = np.zeros(len(texts))
        laid, going, owner = lay_out(rows)
        if not len(owner):
            return out
        logits = np.empty(len(owner))
        for a in range(0, len(owner), BATCH_WINDOWS):
            part = np.minimum(going - a, BATCH_WINDOWS)
            steps = int((part > 0).sum())
            logits[a:a + BATCH_WINDOWS] = self.window_logits(self.table, laid[:steps, a:a + BATCH_WINDOWS], part[:steps])
        with_words = np.unique(owner)
        out[with_words] = sigmoid(text_logits(logits, owner, len(texts))[with_words] + self.correction)
        return out


def text_logits(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logits)
    total = np.bincount(owner, np.exp(logits - top[owner]), n)
    with np.errstate(divide="ignore"):
        return top + np.log(total)


def fit(rows: list[tuple[str, int]], share: float, seed: int = 3) -> ToxicityModel:
    """Fits the network on ``(text, label)`` pairs; ``share`` is that of label 1 among all labelled rows."""
    random = np.random.Generator(np.random.PCG64(seed))
    h = HIDDEN
    weights = {
        "words": random.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE)), "chars": random.normal(0, 0.3, (CHAR_BUCKETS, CHAR_SIZE)),
        "project": random.normal(0, 0.3, (WORD_SIZE + CHAR_SIZE, 6 * h)), "bias": np.zeros(6 * h),
        "ahead": random.normal(0, 0.3, (h, 3 * h)), "back": random.normal(0, 0.3, (h, 3 * h)),
        "look": random.normal(0, 0.3, 2 * h), "out": random.normal(0, 0.3, 2 * h), "out_bias": np.array([-3.0]),
    }
    model = ToxicityModel(weights)
    found = [(WORD.findall(text.lower()), label) for text, label in rows]
    found = [(words, label) for words, label in found if words]
    positive = sum(label for _, label in found)
    if not 0 < positive < len(found):
        weights["out"][:] = 0
        return model
    adam = Adam(weights, RATE, {"words": 5.0, "chars": 5.0})
    order: list[int] = []
    for step in range(STEPS):
        adam.rate = RATE * (1 - step / STEPS)
        if len(order) < BATCH_TEXTS:
            order += random.permutation(len(found)).tolist()
        _ascend(model, adam, [found[i] for i in order[:BATCH_TEXTS]])
        del order[:BATCH_TEXTS]
    own = positive / len(found)
    share = min(max(share, 1e-6), 1 - 1e-6)
    for name in weights:
        weights[name] = weights[name].astype(np.float32)
    model.correction = float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return model


def _ascend(model: ToxicityModel, adam: Adam, part: list[tuple[list[str], int]]) -> None:
    """One step on the labels of a few texts."""
    w = model.weights
    types = {t: k for k, t in enumerate(dict.fromkeys(t for words, _ in part for t in words))}
    keys = word_keys(list(types))
    inputs = model.embedded(keys)
    table = inputs @ w["project"] + w["bias"]
    laid, going, owner = lay_out([np.array([types[t] for t in words], np.int64) for words, _ in part])
    kept: dict = {}
    logits = model.window_logits(table, laid, going, kept)
    whole = text_logits(logits, owner, len(part))
    labels = np.array([label for _, label in part], float)
    g_logit = (labels - sigmoid(whole))[owner] * np.exp(logits - whole[owner]) / len(part)

    states, looks = kept["states"], kept["looks"]
    g_pooled = g_logit[:, None] * w["out"]
    g_look = np.einsum("bh,tbh->tb", g_pooled, states)
    g_look = looks * (g_look - (looks * g_look).sum(axis=0))
    g_states = looks[:, :, None] * g_pooled + g_look[:, :, None] * w["look"]
    g_ahead, u_ahead = layer_gradient(g_states[:, :, :HIDDEN], going, w["ahead"], False, kept["saved"][0])
    g_back, u_back = layer_gradient(g_states[:, :, HIDDEN:], going, w["back"], True, kept["saved"][1])
    flat = np.concatenate([g_ahead, g_back], axis=2).reshape(-1, 6 * HIDDEN)
    g_table = _summed(laid.ravel(), flat, len(types))
    g_inputs = g_table @ w["project"].T
    whole_at, grams, counts = keys
    spread = np.repeat(g_inputs[:, WORD_SIZE:] / np.maximum(counts, 1)[:, None], counts, axis=0)
    adam.ascend({
        "words": _summed(whole_at, g_inputs[:, :WORD_SIZE], WORD_BUCKETS),
        "chars": _summed(grams, spread, CHAR_BUCKETS),
        "project": inputs.T @ g_table, "bias": g_table.sum(axis=0), "ahead": u_ahead, "back": u_back,
        "look": np.einsum("tb,tbh->h", g_look, states), "out": kept["pooled"].T @ g_logit,
        "out_bias": np.array([g_logit.sum()]),
    })


def _summed(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(places, values[:, k], n) for k in range(values.shape[1])], axis=1)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", per_label: int = PER_LABEL,
) -> ToxicityModel:
    """A network fitted on a bounded sample of the labelled rows that ``may_learn``, a condition on ids, allows."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"), may_learn.alias("_may"))
    marks = marks.filter("_may AND label IN (0, 1)")
    share = marks.agg(F.avg("label")).first()[0]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fit(labelled_sample(texts, marks, per_label), share or 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` per row: how likely the text is toxic; null, empty and wordless texts score 0."""

    def score(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "score": model.scores(part.column("text").to_pylist())}

    return map_texts(id_text(docs, id_col, text_col), score, "doc_id long, score double", SLICE)
