"""Phrases whose words stand together more often than their parts would by chance.

A phrase is 2 to ``longest`` words within a piece of text.  With f its number of places, n the
words of its language and l, r the places of its two parts, a cut scores ``1000 f n / (l r)``; the
phrase scores as its worst cut.  As r is at least f, no phrase that starts with a word of count c
scores above ``1000 n / c``.  So phrases are grown best first, from the rarest frequent words up: each round
grows all phrases from the next band of first words, scores them, and ends a language once its
``top``-th score lies above the bound of every word not grown yet; ties with it are all found then.

Words with fewer than ``least`` places cannot be part of a result.  The texts are stored once as runs of
the others' 64-bit keys, and each round scans these runs once a word.  Tasks know the words or phrases
they look for by a bitmap of at most ``BITMAP_BITS`` bits.  What passes it by chance costs work but changes nothing,
because all places of whatever passes are counted.

A null text is empty, a null language ``und``.  Rows are independent: repeated ones count
again, whatever their ids.  Empty tables, and languages without a phrase, give no rows.  Further columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import slices, text_bytes
from millrace.llm.wordhash import BASE, gram_hashes, hash_spans, joined, mix
from millrace.session import materialize, small_batches, small_side

LEAST = 100
LONGEST = 5
TOP = 2_000
SCALE = 1_000
BITMAP_BITS = 26  # log2; 8 MB
TEXT_SLICE = 2 << 20  # bytes of texts or runs held at a time
RUN_SLICE = 4 << 20
IN_BYTES = 15 << 18  # of rows sent to a task's function at a time: one slice of runs
OUT_ROWS = 1 << 16  # rows sent back at a time
FIRST_WORDS = 2_000  # the first band of a language has about so many words at least
WIDEN = 64  # how far the next band goes while fewer than ``top`` phrases are known
SALTS = 64

# 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.int8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


class Bitmap:
    """A set of 64-bit keys by their leading bits."""

    def __init__(self, keys: DataFrame, spare: int = 4):
        """``keys`` has the column ``key``; the driver gets one row per 64 bits at most.

        Up to the greatest size, one in 2 ** ``spare`` other keys at most passes by chance.
        """
        size = min(BITMAP_BITS, max(10, keys.count().bit_length() + spare))
        place = F.shiftrightunsigned("key", 64 - size)
        bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
        words = (
            keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        ).toArrow()
        self.shift = np.uint64(64 - size)
        self.words = np.zeros(1 << size - 6, np.uint64)
        self.words[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _mapped(df: DataFrame, function, schema: str, column: str) -> DataFrame:
    """Applies ``function(batch) -> arrays`` to the rows of ``df``, some megabytes of ``column`` at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(schema)
    target = to_arrow_schema(fields)
    size = TEXT_SLICE if column == "text" else RUN_SLICE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, size):
                arrays = [pa.array(a) if isinstance(a, (list, np.ndarray)) else a for a in function(part)]
                whole = pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)
                yield from _in_pieces(whole)

    return df.mapInArrow(run, fields)


def _in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, a few at a time: Spark holds each piece it gets outside its heap."""
    for k in range(0, max(batch.num_rows, 1), OUT_ROWS):
        yield batch.slice(k, OUT_ROWS)


class Words:
    """The words of a batch of texts: keys that differ by language, spans, and where pieces begin."""

    def __init__(self, part: pa.RecordBatch):
        self.raw, text_ends = joined(text_bytes(part.column("text")))
        kind = KIND[self.raw]
        edge = np.diff((kind > 0).astype(np.int8), prepend=1, append=1)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(text_ends, self.starts, side="right")
        breaks = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.first = np.diff(breaks, prepend=-1) != 0
        salts = np.array([_salt(x) for x in part.column("lang").to_pylist()], np.uint64)
        keys = hash_spans(self.raw, self.starts, self.ends, fold=True) ^ salts[self.doc]
        self.keys = np.where(keys == 0, np.uint64(1), keys)  # 0 stands between runs


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, key, f)`` of all words; the empty word has a language's total."""

    def count(part: pa.RecordBatch):
        words = Words(part)
        keys, at, counts = np.unique(words.keys, return_index=True, return_counts=True)
        lower = words.raw.tobytes().lower()
        found = [lower[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
        each = np.bincount(words.doc, minlength=part.num_rows)
        lang = np.r_[words.doc[at], np.arange(part.num_rows)]
        return [
            part.column("lang").take(pa.array(lang)), found + [b""] * part.num_rows,
            np.r_[keys, np.zeros(part.num_rows, np.uint64)].view(np.int64), np.r_[counts, each],
        ]

    found = _mapped(docs, count, "lang string, word string, key long, f long", "text")
    return found.groupBy("lang", "word").agg(F.max("key").alias("key"), F.sum("f").alias("f"))


def _runs(docs: DataFrame, known: Bitmap) -> DataFrame:
    """``(lang, words)``: per text the runs of two or more known words within a piece, a 0 before each run."""

    def cut(part: pa.RecordBatch):
        words = Words(part)
        keep = known.has(words.keys)
        after = keep & ~words.first & np.r_[False, keep[:-1]]  # follows a known word of its piece
        used = np.flatnonzero(after | np.r_[after[1:], False]) if len(keep) else np.empty(0, np.int64)
        start = ~after[used]
        out = np.zeros(len(used) + int(start.sum()), np.uint64)
        out[np.arange(len(used)) + np.cumsum(start)] = words.keys[used]
        sizes = np.bincount(words.doc[used], weights=1 + start, minlength=part.num_rows).astype(np.int64)
        some, ends, raw = np.flatnonzero(sizes), 8 * np.cumsum(sizes), out.tobytes()
        rows = [raw[e - 8 * n:e] for e, n in zip(ends[some].tolist(), sizes[some].tolist(), strict=True)]
        return [part.column("lang").take(pa.array(some)), pa.array(rows, pa.binary())]

    return _mapped(docs, cut, "lang string, words binary", "text")


def _laid_out(part: pa.RecordBatch, longest: int) -> np.ndarray:
    """All runs of a batch behind each other, with zeros at the end."""
    rows = [np.frombuffer(x, "<u8") for x in part.column("words").to_pylist()]
    return np.concatenate([*rows, np.zeros(longest + 1, np.uint64)])


def _grams(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the ``n`` keys from each place on, as ``gram_hashes`` has them."""
    total = np.full(len(at), n, np.uint64)
    for k in range(n):
        total = total * BASE + flat[at + k]
    return mix(total)


def _gram_keys(phrases: DataFrame) -> DataFrame:
    """``phrases`` with ``key``, the hash of the column ``part`` of words."""

    def hashed(part: pa.RecordBatch):
        lists = part.column("part")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths())
        sizes, keys = np.asarray(lists.value_lengths()), np.empty(len(lists), np.uint64)
        for n in np.unique(sizes):
            own = sizes == n
            keys[own] = _grams(flat, (np.asarray(ends) - sizes)[own], int(n))
        return [part.column("lang"), lists, keys.view(np.int64)]

    rows = phrases.select("lang", "part", F.lit("").cast("binary").alias("bytes"))
    return _mapped(rows, hashed, "lang string, part array<long>, key long", "bytes")


def _grown_by_one(runs: DataFrame, first: Bitmap, shorter: Bitmap | None, n: int, least: int) -> DataFrame:
    """Counts of the phrases of ``n`` words that start with a word of ``first`` and a phrase of ``shorter``.

    Columns ``w0 .. , a``, and the least and greatest keys of the words before and behind, 0 where there is none.
    """
    words = [f"w{k}" for k in range(n)]

    def extend(part: pa.RecordBatch):
        flat = _laid_out(part, n)
        at = np.flatnonzero(flat[:-n - 1])
        at = at[first.has(flat[at])]
        for k in range(1, n):
            at = at[flat[at + k] != 0]
        if shorter is not None:
            at = at[shorter.has(_grams(flat, at, n - 1))]
        if not len(at):
            return [np.empty(0, np.int64)] * (n + 5)
        total = _grams(flat, at, n)
        order = np.argsort(total, kind="stable")
        at, total = at[order], total[order]
        heads = np.flatnonzero(np.r_[True, total[1:] != total[:-1]])
        flat = flat.view(np.int64)
        sides = [f.reduceat(flat[at + k], heads) for k in (-1, n) for f in (np.minimum, np.maximum)]
        return [*[flat[at[heads] + k] for k in range(n)], np.diff(np.r_[heads, len(at)]), *sides]

    schema = ", ".join(f"{c} long" for c in [*words, "a", "b0", "b1", "e0", "e1"])
    return _mapped(runs, extend, schema, "words").groupBy(*words).agg(
        F.sum("a").alias("a"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("e0").alias("e0"), F.max("e1").alias("e1")
    ).filter(F.col("a") >= least)


def grow(runs: DataFrame, band: DataFrame, least: int, longest: int) -> DataFrame:
    """``(lang, words, a, closed)``: all phrases with ``least`` places whose first word is in ``band``.

    Word by word: a phrase can have ``least`` places only if the one without its last word has.
    ``closed``: the same word precedes, or follows, the phrase at all its places, so a phrase of one
    more word has as many.
    """
    first, shorter, found = Bitmap(band), None, []
    languages = band.select("lang", F.col("key").alias("w0"))
    for n in range(2, longest + 1):
        counted = _grown_by_one(runs, first, shorter, n, least)
        same = ((F.col("b0") == F.col("b1")) & (F.col("b0") != 0)) | ((F.col("e0") == F.col("e1")) & (F.col("e0") != 0))
        closed = same if n < longest else F.lit(False)
        # What passed the bitmap by chance belongs to another round, where it is grown again: the join drops it.
        phrases = counted.join(languages, "w0").select(
            "lang", F.array(*[f"w{k}" for k in range(n)]).alias("words"), "a", closed.alias("closed")
        )
        found.append(materialize(phrases, "grown"))
        if n < longest:
            shorter = Bitmap(_gram_keys(found[-1].withColumnRenamed("words", "part")))
            if not shorter.words.any():
                break
    return reduce(DataFrame.unionByName, found)


def count_phrases(runs: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """``(lang, part, f)`` of the phrases ``part`` in ``wanted``, each of which stands somewhere."""
    wanted = materialize(_gram_keys(wanted), "wanted")
    sought = Bitmap(wanted)
    if not sought.words.any():
        return wanted.withColumnRenamed("key", "f")

    def count(part: pa.RecordBatch):
        flat = _laid_out(part, longest)
        last = len(flat) - longest - 1
        whole, found = flat != 0, []
        for n in range(2, longest):
            keys = gram_hashes(flat, n)[:last]
            ok = sought.has(keys)
            for k in range(n):
                ok &= whole[k:k + last]
            found.append(keys[ok])
        keys, number = np.unique(np.concatenate(found), return_counts=True)
        return [keys.view(np.int64), number]

    found = _mapped(runs, count, "key long, f long", "words").groupBy("key").agg(F.sum("f").alias("f"))
    return wanted.join(found, "key").select("lang", "part", "f")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 a n / (l r))`` in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(n) * F.lit(SCALE), wide(left) * wide(right))


def _scored(grown: DataFrame, known: DataFrame, runs: DataFrame, frontier: DataFrame, longest: int) -> DataFrame:
    """``(lang, words, a, l, r, n, score)`` of the phrases that no longer one makes superfluous.

    ``known`` has the counts of all words and of all phrases grown so far: it holds every left part.  Right
    parts that start with a word not grown yet are counted in the stored runs.
    Phrases whose bound lies below the score that a language needs already are left out.
    """
    size = F.size("words")
    bound = F.call_function("div", F.lit(SCALE) * F.col("n"), F.greatest("f_first", "f_last"))
    ends = known.filter(F.size("part") == 1).select("lang", F.get("part", F.lit(0)).alias("key"), "f")
    open_ones = (
        grown.filter(~F.col("closed")).join(_per_language(frontier).select("lang", "n", "settled_from"), "lang")
        .withColumns({"w_first": F.get("words", F.lit(0)), "w_last": F.element_at("words", -1)})
        .join(ends.withColumnsRenamed({"key": "w_first", "f": "f_first"}), ["lang", "w_first"])
        .join(ends.withColumnsRenamed({"key": "w_last", "f": "f_last"}), ["lang", "w_last"])
        .filter(F.col("settled_from").isNull() | (bound >= F.col("settled_from")))
    )
    cuts = open_ones.select("lang", "words", "a", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumns(
        {"left": F.slice("words", 1, F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))}
    )
    lefts = known.withColumnsRenamed({"part": "left", "f": "l"})
    rights = known.withColumnsRenamed({"part": "right", "f": "r_known"})
    cuts = materialize(cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"], "left"), "cuts")
    missing = cuts.filter(F.col("r_known").isNull()).select("lang", F.col("right").alias("part")).distinct()
    counted = count_phrases(runs, missing, longest).withColumnsRenamed({"part": "right", "f": "r_counted"})
    whole = cuts.join(counted, ["lang", "right"], "left").withColumn("r", F.coalesce("r_known", "r_counted"))
    worst = F.min(F.struct(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    return whole.groupBy("lang", "words", "a", "n").agg(worst.alias("cut")).select(
        "lang", "words", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def _best(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """Each language's first ``top`` rows with ``rank``; parts of a language are cut to ``top`` before they meet."""
    part = F.pmod(F.xxhash64("words"), F.lit(SALTS))
    for keys in ([F.col("lang"), part], [F.col("lang")]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("rank", place).filter(F.col("rank") <= top)
    return rows


def _per_language(frontier: DataFrame) -> DataFrame:
    """The stored table with one row per language, as a join side."""
    return small_side(frontier, frontier.count())


def _next_bands(frontier: DataFrame, words: DataFrame, scored: DataFrame | None, top: int) -> DataFrame:
    """One row per language: ``lang, n, most, low, high, settled_from``; words of ``low <= f < high`` are grown next.

    ``settled_from`` is the ``top``-th score so far.  Nothing is left to grow where ``high`` is not above ``low``.
    """
    if scored is None:
        # Bands end at the least count times a power of two.
        step = F.floor(F.log2(F.col("f") / F.col("least"))).cast("int")
        sizes = words.join(_per_language(frontier), "lang").groupBy("lang", step.alias("step")).agg(F.count("*").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("lang").orderBy("step"))
        enough = sizes.withColumn("upto", upto).groupBy("lang").agg(
            F.min(F.when(F.col("upto") >= FIRST_WORDS, F.col("step"))).alias("step")
        )
        high = F.least(F.col("most") + 1, F.col("least") * F.pow(F.lit(2), F.coalesce("step", F.lit(62)) + 1)).cast("long")
        return frontier.join(enough, "lang").select(
            "lang", "n", "most", "least", F.col("least").alias("low"), high.alias("high"), F.lit(None).cast("long").alias("settled_from")
        )
    last = _best(scored, [F.desc("score"), F.asc("words")], top).filter(F.col("rank") == top)
    found = frontier.drop("settled_from").join(last.select("lang", F.col("score").alias("settled_from")), "lang", "left")
    # A word of a count from here on has a bound below the score.
    reach = F.call_function("div", F.lit(SCALE) * F.col("n"), F.col("settled_from")) + 1
    high = F.least(F.col("most") + 1, F.coalesce(reach, F.col("high") * WIDEN))
    return found.select(
        "lang", "n", "most", "least", F.col("high").alias("low"), F.greatest("high", high).alias("high"), "settled_from"
    )


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases.

    Phrases have ``least`` places at least and are not part of a longer one with as many.  They are ranked by score and
    places, both falling, then by their bytes.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    with small_batches(docs.sparkSession, IN_BYTES):  # all Python work ends in stored tables here
        counted = word_counts(texts).filter((F.col("f") >= least) | (F.col("word") == ""))
        stored = materialize(counted, "words")
        words = stored.filter("word <> ''")
        totals = stored.filter("word = ''").select("lang", F.col("f").alias("n"))
        most = words.groupBy("lang").agg(F.max("f").alias("most"))
        frontier = totals.join(most, "lang").withColumn("least", F.lit(least).cast("long"))
        frontier = materialize(_next_bands(materialize(frontier, "languages"), words, None, top), "frontier")
        runs = materialize(_runs(texts, Bitmap(words)), "runs")
        known = words.select("lang", F.array("key").alias("part"), "f")
        scored = None
        while frontier.filter("low < high").count():
            band = materialize(words.join(_per_language(frontier), "lang").filter("f >= low AND f < high"), "band")
            grown = grow(runs, band, least, longest)
            known = known.unionByName(grown.select("lang", F.col("words").alias("part"), F.col("a").alias("f")))
            some = materialize(_scored(grown, known, runs, frontier, longest), "scored")
            scored = some if scored is None else scored.unionByName(some)
            frontier = materialize(_next_bands(frontier, words, scored, top), "frontier")
    if scored is None:
        schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], schema)
    return _ranked(scored, words, frontier, top)


def _ranked(scored: DataFrame, words: DataFrame, frontier: DataFrame, top: int) -> DataFrame:
    """The final rows: texts are looked up for all phrases that reach the last score of their language."""
    last = _per_language(frontier).select("lang", "settled_from")
    near = scored.join(last, "lang").filter(F.col("settled_from").isNull() | (F.col("score") >= F.col("settled_from")))
    near = near.drop("settled_from")
    spelled = (
        near.select("lang", "words", F.posexplode("words").alias("place", "key"))
        .join(words.select("lang", "key", "word"), ["lang", "key"])
        .groupBy("lang", "words")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelling"))
        .select("lang", "words", F.array_join("spelling.word", " ").alias("phrase"))
    )
    ranked = _best(near.join(spelled, ["lang", "words"]), [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
