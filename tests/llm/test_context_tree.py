"""Context-tree weighting against a plain recursive version."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import held_out
from millrace.llm.context_tree import Tally, byte_grams, log_estimate, score_texts


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTree:
    """Counts per context and decision in a dict; weights by recursion."""

    def __init__(self, texts, depth, least=1):
        self.depth, self.counts, self.size = depth, defaultdict(lambda: [0, 0]), Counter()
        self.children = defaultdict(set)
        for text in texts:
            for context, symbol in self.symbols(text):
                for d in range(depth + 1):
                    self.size[context[depth - d:]] += 1
                    for bits, bit in self.decisions(symbol):
                        self.counts[context[depth - d:], bits][bit] += 1
                        if d:
                            self.children[context[depth - d + 1:], bits].add(context[depth - d:])
        self.least, self.memory = least, {}

    def symbols(self, text):
        raw = bytes([255]) * self.depth + text.encode().lower() + bytes([255])
        for k in range(self.depth, len(raw)):
            yield raw[k - self.depth:k], raw[k]

    @staticmethod
    def decisions(symbol):
        for k in range(8):
            yield (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1

    def weighted(self, context, bits):
        if (context, bits) not in self.memory:
            own = log_kt(*self.counts[context, bits])
            if len(context) == self.depth:
                self.memory[context, bits] = own
            else:
                below = sum(self.weighted(c, bits) for c in sorted(self.children[context, bits]))
                self.memory[context, bits] = np.logaddexp(own, below) - math.log(2)
        return self.memory[context, bits]

    def probability(self, context, bits):
        """Of a one, mixed from the root to the deepest node seen."""
        path = []
        for d in range(self.depth + 1):
            c = context[self.depth - d:]
            if (c, bits) not in self.counts or (d and self.size[c] < self.least):
                break
            path.append(c)
        if not path:
            return 0.5
        total, rest = 0.0, 1.0
        for c in path:
            a, b = self.counts[c, bits]
            one = (b + 0.5) / (a + b + 1)
            own = 1.0 if c == path[-1] else math.exp(log_kt(a, b) - math.log(2) - self.weighted(c, bits))
            total, rest = total + rest * own * one, rest * (1 - own)
        return total

    def score(self, text):
        total = 0.0
        for context, symbol in self.symbols(text):
            for bits, bit in self.decisions(symbol):
                p = self.probability(context, bits)
                total += math.log10(p if bit else 1 - p)
        return total


def texts(seed=1, n=40):
    r = random.Random(seed)
    words = ["the", "cat", "Dog", "sat", "on", "é", "mat.", "zebra"]
    return [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 25)))) for k in range(n)]


@pytest.mark.parametrize(("depth", "support"), [(3, 1 << 21), (2, 60)])
def test_against_the_plain_tree(docs_of, depth, support):
    rows = [*texts(), (100, ""), (101, None), (102, "qqq never seen \u0000 漢"), (103, " \n ")]
    docs = docs_of(rows)
    held = held_out("doc_id", 7, 2)
    learn = {r["doc_id"] for r in docs.filter(~held).select("doc_id").collect()}
    train = [t or "" for k, t in rows if k in learn]
    n_bytes = sum(len(t.encode()) + 1 for t in train)
    tree = PlainTree(train, depth, -(-n_bytes // support))
    words = Counter(w for t in train for w in t.lower().split())
    total, distinct = sum(words.values()) + len(train), len(words) + 1
    got = {r["doc_id"]: r for r in score_texts(docs, ~held, depth, support, head=3).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        own = (text or "").lower().split()
        counts = [words[w] for w in own] + [len(train)]
        row = got[k]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own) + 1, sum(c > 0 for c in counts), total)
        assert row["base_score"] == pytest.approx(sum(math.log10((c + 1) / (total + distinct + 1)) for c in counts), abs=1e-9)
        assert row["score"] == pytest.approx(tree.score(text or ""), rel=1e-9, abs=1e-9)
        assert row["bits_per_byte"] == pytest.approx(-row["score"] / math.log10(2) / (len((text or "").encode()) + 1))


def test_probabilities_of_all_next_symbols_sum_to_one():
    tree = PlainTree([t for _, t in texts()], 2)
    for context in (b"ca", b"\xff\xff", b"qz"):
        total = sum(
            math.prod(p if bit else 1 - p for bits, bit in tree.decisions(s) for p in [tree.probability(context, bits)])
            for s in range(256)
        )
        assert total == pytest.approx(1)


def test_without_training_texts(docs_of, no_docs):
    row = score_texts(docs_of([(1, "ab")]), F.lit(False), 2).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0)
    assert row["score"] == pytest.approx(-24 * math.log10(2))
    assert score_texts(no_docs, F.lit(True), 2).count() == 0


def test_odd_rows(odd_docs):
    rows = score_texts(odd_docs, F.lit(True), 3).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0 for r in rows)
    repeated = [tuple(r) for r in rows if r["doc_id"] == 6]
    assert len(repeated) == 2 and repeated[0] == repeated[1]


def test_estimate():
    pairs = [(0, 0), (1, 0), (0, 1), (3, 5), (1000, 7), (10**9, 10**8)]
    for a, b in pairs:
        x = log_estimate(np.array([float(a)]), np.array([float(b)]))[0]
        assert x == pytest.approx(log_kt(a, b), rel=1e-10, abs=1e-9)


def test_grams_and_tallies(monkeypatch):
    grams, starts = byte_grams([b"ab", b"", b"c"], 2)
    pad = 0xFF
    want = [(pad, pad, 97), (pad, 97, 98), (97, 98, pad), (pad, pad, pad), (pad, pad, 99), (pad, 99, pad)]
    assert [tuple(int(g).to_bytes(3, "big")) for g in grams] == want and starts.tolist() == [0, 3, 4]
    monkeypatch.setattr("millrace.llm.context_tree.MERGED", 10)
    r = np.random.Generator(np.random.PCG64(1))
    tally, plain = Tally(), Counter()
    for _ in range(40):
        keys = r.integers(0, 30, 20).astype(np.uint64)
        tally.add(keys)
        plain.update(keys.tolist())
    keys, counts = tally.merge()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == plain


@pytest.mark.parametrize("head_grams", [1 << 20, 50, 0])
def test_every_learned_context_counts(docs_of, monkeypatch, head_grams):
    """However many bytes are learned, and whether lengths are held in tasks or joined."""
    monkeypatch.setattr("millrace.llm.context_tree.SUPPORT", 60, raising=False)
    rows = [*texts(3, 60), (100, ""), (101, "zebra qqq"), (102, "aaaaaaaaaaaaaaaa")]
    docs = docs_of(rows)
    held = held_out("doc_id", 7, 2)
    learn = {r["doc_id"] for r in docs.filter(~held).select("doc_id").collect()}
    tree = PlainTree([t for k, t in rows if k in learn], 4)
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, ~held, 4, head=3, head_grams=head_grams).collect()}
    assert got == pytest.approx({k: tree.score(t) for k, t in rows}, rel=1e-9, abs=1e-9)


def test_default_keeps_contexts_seen_once(docs_of):
    """A text learned once, beside over 2**19 bytes of another: its contexts are below any share of the bytes."""
    rare = "jqx vkz wpj qzv"
    common = "ab " * 200_000
    rows = [(1, rare), *((k, common) for k in (2, 3))]
    got = {r["doc_id"]: r["bits_per_byte"] for r in score_texts(docs_of([*rows, (9, rare)]), F.col("doc_id") < 9).collect()}
    cut = score_texts(docs_of([*rows, (9, rare)]), F.col("doc_id") < 9, support=1 << 19)
    assert got[9] < 0.9 * {r["doc_id"]: r["bits_per_byte"] for r in cut.collect()}[9]


@pytest.mark.parametrize("depth", [1, 7])
def test_depths_that_do_not_fit_a_key_are_refused(docs_of, depth):
    with pytest.raises(ValueError, match="depth"):
        score_texts(docs_of([(1, "a b")]), F.lit(True), depth)
