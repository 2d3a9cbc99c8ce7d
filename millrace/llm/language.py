"""Language of words and texts by a linear-chain conditional random field.

Every word gets a score per language from hashed character n-grams with word
borders (so affixes are among them) and from a lexicon; learned transitions
carry context from word to word, and forward-backward gives each word's
probabilities.  A text's language has the largest share of them, by letters.
Training sequences are spliced from texts of several languages, so that the
transitions know code-switched text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_text, looked_up, map_texts, ragged_sums
from millrace.llm.crf import Adam, batches, forward_backward, lay_out
from millrace.llm.samples import labelled_sample
from millrace.llm.wordhash import mix

PER_LANGUAGE = 250  # texts of a language the model is fitted on
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
SPAN = 30  # words of a training span
SPANS = 10  # training spans of a text at most, at hashed places all over it
SEQUENCES = 3000
PASSES = 3
REMEMBERED = 200_000
TEXTS = 128
SLICE = 16 << 20
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, borders included, word by word, and the number of each word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    buckets, owners = [], []
    total = np.zeros(len(codes), np.uint64)
    for n in GRAMS:
        total = total[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        inside = at[:len(total)] + n <= ends[:len(total)]
        buckets.append((mix(total[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:len(total)][inside])
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


@dataclass
class LanguageModel:
    """Weights, and the scores of words seen, which a worker keeps."""

    languages: list[str]
    grams: np.ndarray  # (bucket, language)
    entries: np.ndarray  # (lexicon language or none, language)
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    letters: np.ndarray | None = None  # length of each word of ``table``
    size: int = 0  # rows of ``table`` in use

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None, "letters": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        buckets, counts = gram_buckets(words)
        scores = ragged_sums(self.grams, buckets, counts)
        none = len(self.languages)
        return scores + self.entries[[self.lexicon.get(w, none) for w in words]]

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Places of each text's words in ``table``, words without a letter left out; few texts' words are held at a time."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, None
        return [p for k in range(0, len(texts), TEXTS) for p in self._rows(texts[k:k + TEXTS])]

    def _rows(self, texts: list[str]) -> list[np.ndarray]:
        found = [WORD.findall(t.lower()) for t in texts]
        known = self.known
        new = list(set().union(*found) - known.keys())
        if self.table is None:
            self.table, self.letters, self.size = np.zeros((1, len(self.languages))), np.zeros(1), 1
        letters = [w for w in new if any(map(str.isalpha, w))]
        known.update(dict.fromkeys(new, 0))
        if letters:
            size = self.size
            self.size += len(letters)
            known.update(zip(letters, range(size, self.size), strict=True))
            if self.size > len(self.table):
                self.table = np.concatenate([self.table[:size], np.zeros((2 * self.size - size, len(self.languages)))])
                self.letters = np.concatenate([self.letters[:size], np.zeros(2 * self.size - size)])
            self.table[size:self.size] = self.word_scores(letters)
            self.letters[size:self.size] = [len(w) for w in letters]
        places = [looked_up(known, words) for words in found]
        return [p[p > 0] for p in places]

    def posteriors(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """Words and their probabilities, text by text: the plain form, for tests and inspection."""
        out = []
        for text in texts:
            words = [w for w in WORD.findall(text.lower()) if any(map(str.isalpha, w))]
            if words:
                scores, going = lay_out([self.word_scores(words)])
                out.append((words, forward_backward(scores, going, self.transitions, self.start)[0][:, 0]))
            else:
                out.append(([], np.zeros((0, len(self.languages)))))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[list[dict]]]:
        """Language, its share of the letters, and runs of words of one language, for each text."""
        places = self.rows(texts)
        names, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
        runs: list[list[dict]] = [[] for _ in texts]
        for batch in batches(np.array([len(p) for p in places]), len(self.languages)):
            laid, going = lay_out([places[k] for k in batch])
            likely, _, _ = forward_backward(self.table[laid], going, self.transitions, self.start)
            for column, k in enumerate(batch.tolist()):
                own = likely[:len(places[k]), column]
                weight = self.letters[places[k]]
                share = weight @ own / weight.sum()
                best = int(share.argmax())
                names[k], shares[k] = self.languages[best], float(min(share[best], 1.0))
                labels = own.argmax(axis=1)
                cuts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
                ends = np.r_[cuts[1:], len(labels)]
                runs[k] = [
                    {"lang": self.languages[labels[a]], "first_word": a, "n_words": b - a}
                    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)
                ]
        return names, shares, runs


def _lexicon(texts: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Words of at least three texts of which nine in ten are of one language."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for text, label in texts:
        for word in set(WORD.findall(text.lower())):
            seen[word][label] += 1
    out = {}
    for word, counts in seen.items():
        label, most = counts.most_common(1)[0]
        if most >= 3 and most >= 0.9 * sum(counts.values()):
            out[word] = label
    return out


def _span_places(text: str, n_words: int) -> list[int]:
    """Where the training spans of a text begin: every ``SPAN`` words, or ``SPANS`` of those places by a hash of the text."""
    places = np.arange(0, n_words, SPAN)
    if len(places) > SPANS:
        random = np.random.Generator(np.random.PCG64(zlib.crc32(text.encode())))
        places = np.sort(random.choice(places, SPANS, replace=False))
    return places.tolist()


def fit(rows: list[tuple[str, str]], seed: int = 1) -> LanguageModel:
    """Fits a model on ``(text, language)`` pairs; half give the lexicon, half the weights."""
    languages = sorted({lang for _, lang in rows}) or [UNKNOWN]
    n = len(languages)
    model = LanguageModel(
        languages, np.zeros((BUCKETS, n)), np.zeros((n + 1, n)), np.zeros((n, n)), np.zeros(n), {}
    )
    labelled = [(text, languages.index(lang)) for text, lang in rows]
    model.lexicon = _lexicon(labelled[::2], n)
    spans: dict[int, list[list[str]]] = defaultdict(list)
    for text, label in labelled[1::2] or labelled:
        words = [w for w in WORD.findall(text.lower()) if any(map(str.isalpha, w))]
        spans[label] += [words[k:k + SPAN] for k in _span_places(text, len(words))]
    spans = {k: v for k, v in spans.items() if v}
    if n < 2 or not spans:
        return model
    random = np.random.Generator(np.random.PCG64(seed))
    sequences = []
    for _ in range(SEQUENCES):
        words, labels = [], []
        for label in random.choice(list(spans), random.choice([1, 2, 3], p=[0.4, 0.3, 0.3])):
            span = spans[label][random.integers(len(spans[label]))]
            span = span[:random.integers(1, len(span) + 1)]
            words += span
            labels += [label] * len(span)
        sequences.append((words, np.array(labels)))
    parameters = {"grams": model.grams, "entries": model.entries, "transitions": model.transitions, "start": model.start}
    adam = Adam(parameters, 0.02)
    for _ in range(PASSES):
        order = random.permutation(len(sequences))
        for k in range(0, len(order), 50):
            _ascend(model, adam, [sequences[i] for i in order[k:k + 50]])
    return model


def _ascend(model: LanguageModel, adam: Adam, part: list[tuple[list[str], np.ndarray]]) -> None:
    """One step towards the labels of a few sequences."""
    n = len(model.languages)
    part = sorted(part, key=lambda s: -len(s[0]))
    types = {w: k for k, w in enumerate(dict.fromkeys(w for words, _ in part for w in words))}
    table = model.word_scores(list(types))
    places, going = lay_out([np.array([types[w] for w in words]) for words, _ in part])
    gold, _ = lay_out([np.eye(n)[labels] for _, labels in part])
    likely, pairs, _ = forward_backward(table[places], going, model.transitions, model.start)
    miss = (gold - likely).reshape(-1, n)
    per_type = np.stack([np.bincount(places.ravel(), miss[:, k], len(types)) for k in range(n)], axis=1)
    buckets, counts = gram_buckets(list(types))
    spread = np.repeat(per_type, counts, axis=0)
    entry = np.array([model.lexicon.get(w, n) for w in types])
    total = len(part)
    adam.ascend({
        "grams": np.stack([np.bincount(buckets, spread[:, k], BUCKETS) for k in range(n)], axis=1) / total - 1e-4 * model.grams,
        "entries": np.stack([np.bincount(entry, per_type[:, k], n + 1) for k in range(n)], axis=1) / total,
        "transitions": (np.einsum("tbi,tbj->ij", gold[:-1], gold[1:]) - pairs) / total,
        "start": (gold[0] - likely[0]).sum(axis=0) / total,
    })


PREDICTED = "doc_id long, lang_pred string, score double"
RUNS = "runs array<struct<lang: string, first_word: long, n_words: long>>"


def fit_languages(
    docs: DataFrame, may_learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    per_language: int = PER_LANGUAGE,
) -> LanguageModel:
    """A model of the languages ``lang_col`` names, from a bounded sample of the rows ``may_learn`` allows."""
    rows = docs.withColumn("_may", may_learn).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"), "_may"
    )
    rows = rows.filter("_may")
    return fit(labelled_sample(rows.select("doc_id", "text"), rows.select("doc_id", "label"), per_language))


def predict_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", runs: bool = False
) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row, with the runs of words of one language on demand.

    Null, empty and letterless texts are ``und`` with score 0 and without runs.
    """
    fields = PREDICTED + (f", {RUNS}" if runs else "")

    def predict(part: pa.RecordBatch) -> dict:
        names, shares, found = model.predict(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id"), "lang_pred": names, "score": shares, "runs": found}

    return map_texts(id_text(docs, id_col, text_col), predict, fields, SLICE)
