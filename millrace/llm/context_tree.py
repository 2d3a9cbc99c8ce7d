"""Code lengths by context-tree weighting over bytes, beside a word model as a base line.

Each byte is eight binary decisions, and each decision, named by the bits
before it, has a context tree over the preceding bytes.  A node's counts give a
Krichevsky-Trofimov estimate.  From the leaves up, the block probability of the
training data is weighted, half for a node's own estimate and half for
its children's product; from the root down, the same weights mix the estimates of all
depths into one probability per node.  Counting is a grouped table; the tree is
weighted and mixed subtree by subtree, and the code length of every symbol after every
context of the texts is read off it there.  A path ends at the deepest node that
training data has seen, however rarely.  Tasks that score hold the lengths of the most frequent
symbols in context, ``HEAD_GRAMS`` at most; those of the others are joined.

Every text is its bytes, A to Z in lower case, and an end symbol; before it stand end symbols.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_bytes
from millrace.llm.hashtable import HashTable
from millrace.llm.wordhash import word_hashes
from millrace.session import materialize, scratch_path
from millrace.sources.paths import open_fs, qualified

DEPTH = 5
DEEPEST = 6  # a node's context bytes and its decision bits share 63 bits
HEAD_GRAMS = 1 << 20  # frequent symbols in context whose code lengths are sent to tasks; the others are joined
HEAD_WORDS = 1 << 19  # frequent words whose counts are sent to tasks; the others are joined
MERGED = 1 << 20
SLICE = 1 << 20
READ_ROWS = 1 << 16
END = 0xFF

GRAM, WORD, TEXT, OTHER = 0, 1, 2, 3  # OTHER: symbols in context of texts that are not learned from


def byte_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with the ``depth`` bytes before it as one number, text by text, and where texts begin."""
    pad = bytes([END]) * depth
    raw = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    grams = np.zeros(max(len(raw) - depth, 0), np.uint64)
    for k in range(depth + 1):
        grams = (grams << np.uint64(8)) | raw[k:len(raw) - depth + k]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(grams), bool)
    gaps = (starts + depth * np.arange(len(texts)))[1:, None] - np.arange(1, depth + 1)
    inside[gaps.ravel()] = False
    return grams[inside], starts


class Tally:
    """Counts of keys, kept as sorted arrays that are merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > MERGED and len(self.parts) > 8:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, code = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.bincount(code, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.held = [(keys, counts)], len(keys)
        return keys, counts


def _tallies(depth: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, others, texts = Tally(), Tally(), Tally(), 0
        for batch in batches:
            for part in slices(batch, size=SLICE):
                learned = part.column("_may")
                rest = part.filter(pa.compute.invert(learned))
                others.add(byte_grams([t.lower() for t in text_bytes(rest.column("text"))], depth)[0])
                raw = [t.lower() for t in text_bytes(part.filter(learned).column("text"))]
                grams.add(byte_grams(raw, depth)[0])
                words.add(word_hashes(raw)[0])
                texts += len(raw)
        rows = (
            (GRAM, *grams.merge()), (WORD, *words.merge()), (TEXT, np.zeros(1, np.uint64), np.array([texts])),
            (OTHER, *others.merge()),
        )
        for kind, keys, counts in rows:
            for k in range(0, len(keys), 1 << 16):
                some = keys[k:k + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.full(len(some), kind), pa.int8()), "key": some,
                    "n": pa.array(counts[k:k + (1 << 16)], pa.int64()),
                })

    return count


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function from 0.5 on: Stirling's series seven places further, less the steps there."""
    y = x + 7
    steps = np.ones_like(x)
    for k in range(7):
        steps = steps * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(steps)


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of ``n0`` zeros and ``n1`` ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _context(depth: int) -> int:
    return (1 << (8 * depth)) - 1


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(at, v, len(distinct)) for v in values)


@dataclass
class Level:
    """The nodes of one depth, in order of ``codes``: the context's bytes, then the bits of the decision so far."""

    depth: int
    codes: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray  # ln of the weighted block probability
    own: np.ndarray  # weight of the node's own estimate

    @classmethod
    def over(cls, depth: int, codes, n0, n1, below: tuple[np.ndarray, np.ndarray] | None) -> Level:
        """A level from its counts and, unless it is the deepest, codes and ``weighted`` of the one below."""
        own, estimate = np.ones(len(codes)), log_estimate(n0, n1)
        weighted = estimate
        if below is not None:
            parents, product = _summed(parent_codes(below[0], depth), below[1])
            assert len(parents) == len(codes)
            weighted = np.logaddexp(estimate, product) - np.log(2)
            own = 1 / (1 + np.exp(np.minimum(product - estimate, 700)))
        return cls(depth, codes, n0, n1, weighted, own)

    def down(self, total: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the mixture above, ``total`` and the weight that is left: the probability of a one if the path ends here, and both for below."""
        one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)
        return total + rest * one, total + rest * self.own * one, rest * (1 - self.own)

    def large(self, least: int) -> np.ndarray:
        """Marks the nodes of contexts with at least ``least`` symbols; the first decision sees them all."""
        first = self.codes & 255 == 1
        contexts, sizes = self.codes[first] >> 8, (self.n0 + self.n1)[first]
        return (sizes >= least)[np.searchsorted(contexts, self.codes >> 8)]


def parent_codes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Codes of the nodes of ``depth`` above nodes one byte deeper."""
    return ((codes >> 8 & _context(depth)) << 8) | (codes & 255)


def levels_of(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[Level]:
    """The levels from ``depth`` up to ``top`` of counted symbols with ``depth`` bytes before each."""
    out: list[Level] = []
    for d in range(depth, top - 1, -1):
        grams, n = _summed(grams & _context(d + 1), n)
        codes, zeros, ones = [], [], []
        for k in range(8):
            symbols = grams & 255
            bit = (symbols >> (7 - k)) & 1
            code, n0, n1 = _summed(((grams >> 8) << 8) | (1 << k) | (symbols >> (8 - k)), n * (1 - bit), n * bit)
            codes.append(code)
            zeros.append(n0)
            ones.append(n1)
        order = np.argsort(code := np.concatenate(codes), kind="stable")
        below = (out[-1].codes, out[-1].weighted) if out else None
        out.append(Level.over(d, code[order], np.concatenate(zeros)[order], np.concatenate(ones)[order], below))
    return out


def _gathered(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, how often they were learned, and how often they are met."""
    held = [[b.column(k).to_numpy() for k in range(3)] for b in batches if b.num_rows]
    keys, n, met = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 3
    return keys.astype(np.int64), n.astype(np.float64), met.astype(np.int64)


def _learned(keys: np.ndarray, n: np.ndarray, depth: int) -> list[Level]:
    return levels_of(keys[n > 0], n[n > 0], depth, TOP)


SUMMARY = "code long, n0 double, n1 double, weighted double"
LENGTHS = "key long, n long, length double"
TOP = 2  # bytes of context that a task's subtrees have in common


def _summaries(depth: int):
    """The roots of the subtrees of a partition, with their weighted probabilities."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, _ = _gathered(batches)
        level = _learned(keys, n, depth)[-1]
        yield pa.RecordBatch.from_pydict({"code": level.codes, "n0": level.n0, "n1": level.n1, "weighted": level.weighted})

    return run


class Paths:
    """Probabilities of the decisions of symbols in context, deeper level by level."""

    def __init__(self, keys: np.ndarray):
        self.contexts, self.symbols = keys >> 8, keys & 255
        self.p = np.full((8, len(keys)), 0.5)  # for decisions never seen

    def enter(self, depth: int, codes: np.ndarray, p: np.ndarray) -> None:
        """Goes down to those of the nodes of ``depth`` that paths lead to."""
        if not len(codes):
            return
        above = (self.contexts & _context(depth)) << 8
        for k in range(8):
            sought = above | (1 << k) | (self.symbols >> (8 - k))
            at = np.minimum(np.searchsorted(codes, sought), len(codes) - 1)
            hit = codes[at] == sought
            self.p[k, hit] = p[at[hit]]

    def log10(self) -> np.ndarray:
        ones = (self.symbols >> np.arange(7, -1, -1)[:, None]) & 1 == 1
        return np.log10(np.where(ones, self.p, 1 - self.p)).sum(axis=0)


def _lengths(depth: int, least: int, top: list[tuple], codes: np.ndarray, total: np.ndarray, rest: np.ndarray):
    """Code lengths of a partition's symbols in context; ``top`` are the nodes above its subtrees, ``codes`` those right above."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, met = _gathered(batches)
        paths, above = Paths(keys), (codes, total, rest)
        for nodes in top:
            paths.enter(*nodes)
        for level in _learned(keys, n, depth)[::-1]:
            at = np.searchsorted(above[0], parent_codes(level.codes, level.depth - 1))
            p, *sums = level.down(above[1][at], above[2][at])
            above = (level.codes, *sums)
            kept = level.large(least)
            paths.enter(level.depth, level.codes[kept], p[kept])
        lengths = paths.log10()
        for k in range(0, len(keys), READ_ROWS):
            yield pa.RecordBatch.from_pydict({c: v[k:k + READ_ROWS] for c, v in (("key", keys), ("n", met), ("length", lengths))})

    return run


def code_lengths(grams: DataFrame, depth: int, least: int = 1) -> DataFrame:
    """``(key, n, length)``: log10 probability of each symbol after its context, from counts ``(key, learned, n)``.

    ``n``, how often a symbol is met, is handed on.  A path ends above contexts learned fewer than ``least`` times.

    The tree is cut below its first two bytes.  All symbols whose last two
    bytes before them agree go to one task, which weights their subtrees from the leaves up.
    Their roots, the decisions of at most 2**16 contexts with up to 255 each, are joined on the driver
    into the top of the tree; with the mixture there, each task goes down its subtrees again.
    """
    by_context = grams.select("key", "learned", "n").repartition(F.shiftright("key", 8).bitwiseAND(_context(TOP)))
    roots = by_context.mapInArrow(_summaries(depth), SUMMARY).toArrow()
    codes, n0, n1, weighted = (roots.column(c).to_numpy() for c in ("code", "n0", "n1", "weighted"))
    top: list[Level] = []
    for d in range(TOP - 1, -1, -1):
        parents, zeros, ones = _summed(parent_codes(codes, d), n0, n1)
        top.append(Level.over(d, parents, zeros, ones, (codes, weighted)))
        codes, n0, n1, weighted = parents, zeros, ones, top[-1].weighted
    nodes, above = [], None
    for level in top[::-1]:
        at = slice(None) if above is None else np.searchsorted(above[0], parent_codes(level.codes, level.depth - 1))
        total, rest = (np.zeros(len(level.codes)), np.ones(len(level.codes))) if above is None else (above[1][at], above[2][at])
        p, *sums = level.down(total, rest)
        above = (level.codes, *sums)
        kept = level.large(least) if level.depth else np.ones(len(p), bool)
        nodes.append((level.depth, level.codes[kept], p[kept]))
    return by_context.mapInArrow(_lengths(depth, least, nodes, *above), LENGTHS)


def _read(path: str, columns: list[str]) -> tuple[int, Iterator[tuple[np.ndarray, ...]]]:
    """Rows of a stored table, and its columns run by run, read inside a task."""
    system, place = open_fs(path)
    table = ds.dataset(place, filesystem=system, format="parquet")

    def runs():
        for batch in table.to_batches(columns=columns, batch_size=READ_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False):
            yield tuple(batch.column(c).to_numpy() for c in columns)
        pa.default_memory_pool().release_unused()

    return table.count_rows(), runs()


@lru_cache(maxsize=1)
def head_lengths(path: str) -> tuple[HashTable, np.ndarray]:
    size, runs = _read(path, ["key", "length"])
    table, lengths = HashTable(max(size, 1)), np.zeros(size + 1)  # the last is for those that are joined
    for keys, length in runs:
        lengths[table.insert(keys.view(np.uint64))] = length
    return table, lengths


@lru_cache(maxsize=1)
def head_words(path: str) -> tuple[HashTable, np.ndarray]:
    size, runs = _read(path, ["key", "n"])
    table, logs = HashTable(max(size, 1)), np.zeros(size + 1)
    for keys, n in runs:
        logs[table.insert(keys.view(np.uint64))] = np.log10(n + 1)
    return table, logs


def _lists(rows: np.ndarray, values: np.ndarray, n_rows: int) -> pa.ListArray:
    """The values of each row, given in order of the rows."""
    ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=n_rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _tail(grams: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each text, text by text, with their counts."""
    order = np.lexsort((grams, text_of))
    grams, text_of = grams[order], text_of[order]
    first = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (text_of[1:] != text_of[:-1])][:len(grams)])
    return text_of[first], grams[first], np.diff(np.r_[first, len(grams)])


def _scores(lengths_path: str, head_path: str, depth: int):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, lengths), (head, logs) = head_lengths(lengths_path), head_words(head_path)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, size=SLICE):
                raw = [t.lower() for t in text_bytes(part.column("text"))]
                words, bounds = word_hashes(raw)
                entries = head.find(words)
                text_of = np.repeat(np.arange(len(raw)), np.diff(bounds))
                rare = entries < 0
                known = np.bincount(text_of[~rare], minlength=len(raw))
                grams, starts = byte_grams(raw, depth)
                places = table.find(grams)
                missing = np.flatnonzero(places < 0)
                tail_of, tail, times = _tail(grams[missing], np.searchsorted(starts, missing, side="right") - 1)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(row + np.arange(len(raw)), pa.int64()), "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array([len(t) for t in raw], pa.int64()),
                    "n_words": pa.array(np.diff(bounds), pa.int64()), "head_known": pa.array(known, pa.int64()),
                    "head_log": pa.array(np.bincount(text_of, logs[entries], len(raw)), pa.float64()),
                    "head_score": pa.array(np.add.reduceat(lengths[places], starts), pa.float64()),
                    "rare": _lists(text_of[rare], words[rare].view(np.int64), len(raw)),
                    "tail": _lists(tail_of, tail.view(np.int64), len(raw)),
                    "times": _lists(tail_of, times.astype(np.int64), len(raw)),
                })
                row += len(raw)

    return score


SCORED = (
    "row long, doc_id long, n_bytes long, n_words long, head_known long, head_log double, head_score double, "
    "rare array<long>, tail array<long>, times array<long>"
)


def _head(words: DataFrame, most: int) -> DataFrame:
    """The rows with the highest counts ``n``, at most ``most``, down to a limit on a scale of steps of the count."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    left, least = most, None
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred steps
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    return words.filter(step >= least) if least is not None else words.limit(0)


def score_texts(
    docs: DataFrame, may_learn: Column, depth: int = DEPTH, support: int | None = None, head: int = HEAD_WORDS,
    id_col: str = "doc_id", text_col: str = "text", head_grams: int = HEAD_GRAMS,
) -> DataFrame:
    """Scores every text of ``docs`` with models of those that ``may_learn`` allows.

    Columns: ``doc_id``, ``n_tokens`` and ``n_known`` (words and one end each), ``train_tokens``,
    ``base_score`` (add-one word model) and ``score`` (context-tree weighting), both log10 of a
    probability, and ``bits_per_byte``, the code length per byte with the end
    symbol.  Null and empty texts are the end alone.  Without training texts every bit
    costs one bit, and every word 0.
    """
    if not TOP <= depth <= DEEPEST:
        raise ValueError(f"the depth is from {TOP} to {DEEPEST}")
    spark: SparkSession = docs.sparkSession
    may = F.coalesce("_may", F.lit(False)).alias("_may")
    rows = docs.withColumn("_may", may_learn).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), may
    )
    counted = rows.select("text", "_may").mapInArrow(_tallies(depth), "kind byte, key long, n long")
    counted = counted.repartition("kind", "key")  # tasks have summed up their own rows already
    counted = materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "tallies")
    learned = F.sum(F.when(F.col("kind") == GRAM, F.col("n")).otherwise(0)).alias("learned")
    grams = counted.filter(F.col("kind").isin(GRAM, OTHER)).groupBy("key").agg(learned, F.sum("n").alias("n"))
    words = counted.filter(F.col("kind") == WORD).select("key", "n")
    n_texts = counted.filter(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = 1
    if support is not None:
        n_bytes = counted.filter(F.col("kind") == GRAM).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        least = -(-n_bytes // support)

    lengths = materialize(code_lengths(grams, depth, least), "code-lengths")
    lengths_path = _kept(_head(lengths, head_grams).select("key", "length"), spark, "head-lengths")
    head_path = _kept(_head(words, head), spark, "head-words")
    scored = rows.select("doc_id", "text").mapInArrow(_scores(lengths_path, head_path, depth), SCORED)
    scored = materialize(scored, "scored")

    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("key"), "t.times")
    tail = tail.join(lengths.select("key", "length"), "key").groupBy("row")
    tail = tail.agg(F.sum(F.col("length") * F.col("times")).alias("tail_score"))
    rare = scored.select("row", F.explode("rare").alias("key")).join(words, "key")
    rare = rare.groupBy("row").agg(
        F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n").cast("double") + 1)).alias("rare_log")
    )
    total, distinct = n_words + n_texts, n_distinct + (n_texts > 0)
    n_tokens = F.col("n_words") + 1
    known = F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_texts > 0))
    counts = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(float(np.log10(n_texts + 1)))
    score = F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))
    scored = scored.drop("rare", "tail", "times").withColumnRenamed("row", "_row")
    scored = scored.join(rare, F.col("_row") == rare["row"], "left").drop("row")
    scored = scored.join(tail, F.col("_row") == tail["row"], "left").withColumn("score", score)
    return scored.select(
        "doc_id", n_tokens.alias("n_tokens"), known.cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (counts - n_tokens * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def _kept(rows: DataFrame, spark: SparkSession, name: str) -> str:
    """Where a table is stored for tasks to read whole."""
    path = scratch_path(spark, name)
    rows.coalesce(4).write.parquet(path)
    return qualified(spark, path)
