"""Quality rules on repetition and length, and labels of lines by a linear-chain conditional random field.

Every line with a word gets a score as content and as boilerplate from its
shape (lengths, shares of symbols, capitals, digits and punctuation, repeated
words, being a copy of an earlier line or a notice known from several texts, place in the text) and from
hashed words.  It is fitted on texts of one label and on splices of both.  Learned transitions tie neighbouring lines, and Viterbi decoding labels them.
A text is kept if it passes the rules and enough of its words lie in content.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_text, map_texts, text_bytes
from millrace.llm.crf import Adam, batches, forward_backward, lay_out, viterbi
from millrace.llm.samples import labelled_sample
from millrace.llm.wordhash import gram_hashes, joined, mix, words_in

PER_LABEL = 400  # texts of either label the field is fitted on
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated three-word windows
MIN_CONTENT = 0.5  # share of words in content lines
BUCKETS = 1 << 12
PASSES = 8
SPLICES = 2  # texts spliced from good and poor ones, for each text fitted on
REPEATED = 3  # texts of the sample a line stands in that is boilerplate wherever it stands
RUNS, RUN_LINES = 4, 8  # runs of a spliced text, and lines of a run, at most
CONTENT, BOILERPLATE = 0, 1

SYMBOLS = b"#*$%&|<>"
SHAPES = 8  # ranges of each measure, one weight per range
BANDS = {
    "words": np.array([1, 2, 4, 8, 16, 40, 120]), "word_length": np.array([2, 3, 4, 5, 6, 8, 12]),
    "symbols": np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4]), "capitals": np.array([0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 0.8]),
    "digits": np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4]), "marks": np.array([0.005, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4]),
    "distinct": np.array([0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95]),
}
FEATURES = SHAPES * len(BANDS) + 5  # and: known notice, copy of an earlier line, first line, last line, any line


def _class_table() -> np.ndarray:
    """For each byte whether it is a symbol, ASCII capital, digit, other mark, letter, or begins a character."""
    table = np.zeros((6, 256), np.int64)
    table[0, list(SYMBOLS)] = 1
    table[1, ord("A"):ord("Z") + 1] = 1
    table[2, ord("0"):ord("9") + 1] = 1
    for b in range(33, 127):
        table[3, b] = not chr(b).isalnum() and b not in SYMBOLS
        table[4, b] = chr(b).isalpha()
    table[4, 0xC0:] = 1
    table[5] = [(b & 0xC0) != 0x80 for b in range(256)]
    return table


CLASSES = _class_table()


@dataclass
class Lines:
    """All lines with a word of some texts, in order, with their texts, features and words."""

    text_of: np.ndarray
    n_words: np.ndarray
    features: np.ndarray
    buckets: np.ndarray  # of all words
    line_of: np.ndarray  # of all words


    def of(self, lines: np.ndarray) -> Lines:
        """Some lines in the given order."""
        begins, sizes = np.cumsum(self.n_words) - self.n_words, self.n_words[lines]
        words = np.repeat(begins[lines] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        line_of = np.repeat(np.arange(len(lines)), sizes)
        return Lines(self.text_of[lines], sizes, self.features[lines], self.buckets[words], line_of)


def _count(cumulated: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return cumulated[b] - cumulated[a]


def measure(texts: list[bytes], notices: frozenset = frozenset()) -> tuple[dict[str, np.ndarray], Lines]:
    """The counts the rules need, per text, and the lines of all texts; ``notices`` are lines known to be repeated."""
    raw, text_ends = joined(texts)
    text_starts = np.r_[0, text_ends[:-1]]
    words, starts, ends = words_in(raw, fold=False)
    text_of_word = np.searchsorted(text_ends, starts, side="right")
    n_words = np.bincount(text_of_word, minlength=len(texts))
    sums = [np.r_[0, np.cumsum(row[raw])] for row in CLASSES]
    chars = np.bincount(text_of_word, _count(sums[5], starts, ends), len(texts)).astype(np.int64)

    windows = gram_hashes(words, 3)
    same = text_of_word[2:] == text_of_word[:-2]
    keyed = windows[same] ^ mix(text_of_word[2:][same].astype(np.uint64) + np.uint64(1))
    _, code, count = np.unique(keyed, return_inverse=True, return_counts=True)
    at = np.flatnonzero(same)[count[code] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True

    breaks = np.flatnonzero(raw == 10)
    line_of_word = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.r_[True, line_of_word[1:] != line_of_word[:-1]]) if len(words) else np.empty(0, np.int64)
    line, lines = np.cumsum(np.bincount(first, minlength=len(words))) - 1, line_of_word[first]
    a, b = np.r_[0, breaks[:-1] + 1][lines] if len(breaks) else lines, breaks[lines] if len(breaks) else lines
    text_of = text_of_word[first]
    own = np.bincount(line, minlength=len(first))
    seen: set = set()
    copy, notice = np.zeros(len(first), bool), np.zeros(len(first), bool)
    for k, (x, y, text) in enumerate(zip(a.tolist(), b.tolist(), text_of.tolist(), strict=True)):
        key = (text, raw[x:y].tobytes())
        copy[k], notice[k] = key in seen, key[1] in notices
        seen.add(key)
    size = np.maximum(_count(sums[5], a, b), 1)
    letters = np.maximum(_count(sums[4], a, b), 1)
    _, index = np.unique(words ^ mix(line.astype(np.uint64) + np.uint64(1)), return_index=True)
    measures = {
        "words": own, "word_length": np.bincount(line, ends - starts, len(first)) / np.maximum(own, 1),
        "symbols": _count(sums[0], a, b) / size, "capitals": _count(sums[1], a, b) / letters,
        "digits": _count(sums[2], a, b) / size, "marks": _count(sums[3], a, b) / size,
        "distinct": np.bincount(line[index], minlength=len(first)) / np.maximum(own, 1),
    }
    features = np.zeros((len(first), FEATURES))
    rows = np.arange(len(first))
    for k, (name, bands) in enumerate(BANDS.items()):
        features[rows, SHAPES * k + np.searchsorted(bands, measures[name], side="right")] = 1
    begins = np.r_[True, text_of[1:] != text_of[:-1]] if len(first) else copy
    features[:, -5], features[:, -4], features[:, -3] = notice, copy, begins
    features[:, -2], features[:, -1] = np.r_[begins[1:], True] if len(first) else copy, 1
    counts = {
        "n_words": n_words, "word_chars": chars, "n_symbols": _count(sums[0], text_starts, text_ends),
        "n_dup_lines": np.bincount(text_of, copy, len(texts)).astype(np.int64),
        "n_repeat_words": np.bincount(text_of_word, covered, len(texts)).astype(np.int64),
    }
    return counts, Lines(text_of, own, features, (words % np.uint64(BUCKETS)).astype(np.int64), line)


@dataclass
class LineModel:
    """Weights of shapes, words and transitions for content and boilerplate, and the notices learned."""

    shapes: np.ndarray
    words: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    notices: frozenset = frozenset()

    def scores(self, lines: Lines) -> np.ndarray:
        n = len(lines.text_of)
        by_word = [np.bincount(lines.line_of, self.words[lines.buckets, k], n) for k in (CONTENT, BOILERPLATE)]
        return lines.features @ self.shapes + np.stack(by_word, axis=1) / np.maximum(lines.n_words, 1)[:, None]

    def labels(self, lines: Lines, n_texts: int) -> np.ndarray:
        """The label of each line on the best path through its text."""
        out = np.zeros(len(lines.text_of), np.int64)
        scores = self.scores(lines)
        lengths = np.bincount(lines.text_of, minlength=n_texts)
        first = np.cumsum(lengths) - lengths
        for batch in batches(lengths, 2):
            laid, going = lay_out([scores[first[k]:first[k] + lengths[k]] for k in batch])
            best = viterbi(laid, going, self.transitions, self.start)
            for column, k in enumerate(batch.tolist()):
                out[first[k]:first[k] + lengths[k]] = best[:lengths[k], column]
        return out


def lines_with_words(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.strip(b" \t\v\f\r")]


def repeated_lines(rows: list[tuple[bytes, int]]) -> frozenset:
    """Lines of ``REPEATED`` of the texts or more: licenses, notices and the like."""
    texts_of = Counter(line for text, _ in rows for line in set(lines_with_words(text)))
    return frozenset(line for line, n in texts_of.items() if n >= REPEATED)


def line_labels(rows: list[tuple[bytes, int]], notices: frozenset) -> list[tuple[list[bytes], np.ndarray]]:
    """The lines with a word of ``(text, quality)`` pairs and their labels.

    Lines of poor texts, ``notices`` and copies of an earlier line of the text are boilerplate, all others content.
    """
    out = []
    for text, quality in rows:
        seen: set = set()
        lines, poor = lines_with_words(text), []
        for line in lines:
            poor.append(quality == 0 or line in notices or line in seen)
            seen.add(line)
        out.append((lines, np.where(poor, BOILERPLATE, CONTENT)))
    return out


def splice(labelled: list[tuple[list[bytes], np.ndarray]], n: int, seed: int) -> list[tuple[list[bytes], np.ndarray]]:
    """``n`` texts of runs of lines of either label by turns, as :func:`line_labels` gives them.

    What a page does, prose under a menu or notices between paragraphs, hardly occurs where whole texts
    are labelled; from these, transitions learn how often labels change.  None where a label does not occur.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    pools: tuple[list, list] = ([], [])
    for lines, labels in labelled:
        for label in (CONTENT, BOILERPLATE):
            own = [line for line, y in zip(lines, labels.tolist(), strict=True) if y == label]
            if own:
                pools[label].append(own)
    out = []
    for _ in range(n if all(pools) else 0):
        label = int(random.integers(2))
        lines, labels = [], []
        for _ in range(random.integers(2, RUNS + 1)):
            source = pools[label][random.integers(len(pools[label]))]
            at = random.integers(len(source))
            run = source[at:at + random.integers(1, RUN_LINES + 1)]
            lines += run
            labels += [label] * len(run)
            label = 1 - label
        seen: set = set()
        again = [line in seen or seen.add(line) is not None for line in lines]
        out.append((lines, np.where(again, BOILERPLATE, labels)))
    return out


def fit(rows: list[tuple[bytes, int]], seed: int = 5) -> LineModel:
    """Fits a field on the lines of ``(text, quality)`` pairs and of texts spliced from them."""
    model = LineModel(np.zeros((FEATURES, 2)), np.zeros((BUCKETS, 2)), np.zeros((2, 2)), np.zeros(2))
    model.shapes[-1, CONTENT] = 1e-3  # without anything to learn from, lines are content
    model.notices = repeated_lines(rows)
    labelled = line_labels(rows, model.notices)
    spliced = splice(labelled, SPLICES * len(rows), seed)
    if not spliced:
        return model
    labelled += spliced
    _, lines = measure([b"\n".join(text) for text, _ in labelled], model.notices)
    lengths = np.bincount(lines.text_of, minlength=len(labelled))
    gold = np.eye(2)[np.concatenate([labels for _, labels in labelled])]
    adam = Adam({k: getattr(model, k) for k in ("shapes", "words", "transitions", "start")}, 0.05)
    first = np.cumsum(lengths) - lengths
    random = np.random.Generator(np.random.PCG64(seed))
    held = np.flatnonzero(lengths)
    for _ in range(PASSES):
        order = random.permutation(held)
        for k in range(0, len(order), 40):
            part = order[k:k + 40]
            part = part[np.argsort(-lengths[part], kind="stable")]
            _ascend(model, adam, lines, gold, [np.arange(first[i], first[i] + lengths[i]) for i in part])
    return model


def _ascend(model: LineModel, adam: Adam, lines: Lines, gold: np.ndarray, part: list[np.ndarray]) -> None:
    """One step towards the labels of a few texts, given as places of their lines, longest first."""
    places, ends = np.concatenate(part), np.cumsum([len(p) for p in part])
    own, n = lines.of(places), len(part)
    laid, going = lay_out(np.split(model.scores(own), ends[:-1]))
    truth, _ = lay_out(np.split(gold[places], ends[:-1]))
    likely, pairs, _ = forward_backward(laid, going, model.transitions, model.start)
    miss = np.concatenate([(truth - likely)[:len(p), column] for column, p in enumerate(part)])
    shares = (miss / np.maximum(own.n_words, 1)[:, None])[own.line_of]
    words = np.stack([np.bincount(own.buckets, shares[:, c], BUCKETS) for c in (0, 1)], axis=1)
    adam.ascend({
        "shapes": own.features.T @ miss / n - 1e-3 * model.shapes,
        "words": words / n - 1e-3 * model.words,
        "transitions": (np.einsum("tbi,tbj->ij", truth[:-1], truth[1:]) - pairs) / n - 1e-3 * model.transitions,
        "start": (truth[0] - likely[0]).sum(axis=0) / n,
    })


COUNTED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
JUDGED = f"{COUNTED}, base_failed boolean, content_words long, kept boolean"


def fit_lines(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    per_label: int = PER_LABEL,
) -> LineModel:
    """A field fitted on a bounded sample of labelled texts."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = labelled_sample(texts, marks.filter("label IN (0, 1)"), per_label)
    return fit([(text.encode(), label) for text, label in sample])


def judge(
    docs: DataFrame, model: LineModel, min_content: float = MIN_CONTENT, id_col: str = "doc_id",
    text_col: str = "text", line_labels: bool = False,
) -> DataFrame:
    """Counts, verdict, and on demand the labels of the lines with a word (1: boilerplate), per row of ``docs``.

    Null and empty texts have no words and fail the rules.
    """
    fields = JUDGED + (", lines array<int>" if line_labels else "")

    def verdicts(part: pa.RecordBatch) -> dict:
        texts = text_bytes(part.column("text"))
        counts, lines = measure(texts, model.notices)
        labels = model.labels(lines, len(texts))
        content = np.bincount(lines.text_of, lines.n_words * (labels == CONTENT), len(texts)).astype(np.int64)
        n = counts["n_words"]
        failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * n)
        out = counts | {"doc_id": part.column("doc_id"), "base_failed": failed, "content_words": content,
                        "kept": ~failed & (content >= min_content * n)}
        if line_labels:
            ends = np.cumsum(np.bincount(lines.text_of, minlength=len(texts)))
            out["lines"] = np.split(labels, ends[:-1])
        return out

    return map_texts(id_text(docs, id_col, text_col), verdicts, fields)
