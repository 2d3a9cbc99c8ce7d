"""Benchmark decontamination: rare word n-gram seeds, a join, then Smith-Waterman alignment of words.

The documents are read once.  Their texts are cut into overlapping segments, and
those that may hold a word n-gram of an item, by a bitmap of bounded size, are stored with the hashes of
the words that items have.  The n-grams of an item that stand in any segment are ranked by how many hold them;
the rarer half are its seeds.  A join on seeds gives pairs of segment and item.  A segment that holds only
frequent n-grams of an item is no less a pair: those are found per distinct set of n-grams, which
copies share.  The words of a pair that stand around shared n-grams are aligned, unless too few of the
item's words are there.  Edited words and gaps lower the score but do not hide the copy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from millrace.llm.collocations import Bitmap
from millrace.llm.common import id_text, map_texts
from millrace.llm.wordhash import gram_hashes
from millrace.session import materialize

SEED_WORDS = 3
MIN_SHARE = 0.5  # of the score of the item aligned with itself
RUN_WORDS = 20  # so many words of an item in a row are reported whatever their share
MATCH, MISMATCH, GAP = 2, -1, -1
REACH = 1 + MATCH // -GAP  # no alignment spans more than so many times the item's words
SEGMENT_WORDS = 1024  # of a document at a time, more where items are long
SALTS = 8
SPARE_BITS = 10  # of the bitmaps of words and n-grams
ALIGNED_CELLS = 1 << 20
REMEMBERED = 20_000
REMEMBERED_WORDS = 500_000

WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")
FOUND = "doc_id long, item_id long, score double, n_matches int, start_word long, end_word long"
ITEMS = "item_id long, words array<long>, grams array<long>"
SEGMENTS = "doc_id long, first_word long, words array<long>, grams array<long>"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits; characters of scripts without blanks stand alone."""
    return WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, 0 for those the bitmap ``known`` does not have; a bounded number is remembered."""

    def __init__(self, known: Bitmap | None = None):
        super().__init__()
        self.bits = None if known is None else known.words.astype("<u8").tobytes()  # a lookup of one word is faster here
        self.shift = 0 if known is None else int(known.shift)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        key = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") or 1
        place = key >> self.shift
        if self.bits is not None and not self.bits[place >> 3] >> (place & 7) & 1:
            key = 0
        self[word] = key
        return key

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def known_grams(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of ``n`` words none of which is 0."""
    known = words != 0
    full = known[:max(len(words) - n + 1, 0)].copy()
    for k in range(1, n):
        full &= known[k:len(words) - n + 1 + k]
    places = np.flatnonzero(full)
    return gram_hashes(words, n)[places], places


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _hash_items():
    hashes = WordHashes()

    def hashed(part: pa.RecordBatch) -> dict:
        words = [hashes.of(words_of(t)) for t in part.column("text").to_pylist()]
        return {
            "item_id": part.column("doc_id"), "words": [_signed(w) for w in words],
            "grams": [_signed(np.unique(gram_hashes(w, min(SEED_WORDS, len(w)) or 1))) for w in words],
        }

    return hashed


def _cut_documents(words: Bitmap, grams: Bitmap, lengths: list[int], longest: int):
    """Segments that may hold an n-gram of an item; every span an alignment can have lies in one of them."""
    hashes = WordHashes(words)
    overlap = REACH * longest
    size = max(SEGMENT_WORDS, 4 * overlap)

    def cut(part: pa.RecordBatch) -> dict:
        out = {c.split()[0]: [] for c in SEGMENTS.split(", ")}
        found = [words_of(t) for t in part.column("text").to_pylist()]
        bounds = np.cumsum([0, *map(len, found)])
        flat = hashes.of(list(chain.from_iterable(found)))
        held, at, size_of = [], [], []
        for n in lengths:
            keys, places = known_grams(flat, n)
            hit = np.flatnonzero(grams.has(keys))
            hit = hit[places[hit] + n <= bounds[np.searchsorted(bounds, places[hit], "right")]]  # within one text
            held.append(keys[hit])
            at.append(places[hit])
            size_of.append(np.full(len(hit), n))
        held, at, size_of = np.concatenate(held), np.concatenate(at), np.concatenate(size_of)
        order = np.argsort(at, kind="stable")
        held, at, size_of = held[order], at[order], size_of[order]
        doc_ids, cuts = part.column("doc_id"), np.searchsorted(at, bounds)
        for doc in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[doc], cuts[doc + 1]
            whole, place = flat[bounds[doc]:bounds[doc + 1]], at[a:b] - bounds[doc]
            for first in range(0, max(len(whole) - overlap, 1), size - overlap):
                own = np.unique(held[a:b][(place >= first) & (place + size_of[a:b] <= first + size)])
                if len(own):
                    row = (doc_ids[doc].as_py(), first, _signed(whole[first:first + size]), _signed(own))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
        return out

    return cut


def align(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores, a row per item word and a column per text word, with a border of zeros.

    A row's gaps along the text are a running maximum, since each costs the same.
    """
    scores = np.zeros((len(item) + 1, len(text) + 1), np.int32)
    slope = -GAP * np.arange(len(text) + 1, dtype=np.int32)
    for i, word in enumerate(item, 1):
        above = scores[i - 1]
        row = scores[i]
        row[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row[:] = np.maximum.accumulate(row + slope) - slope
    return scores


def trace(scores: np.ndarray, item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Matches, first and one past the last text word of the best alignment, the first of several."""
    i, j = np.unravel_index(int(scores.argmax()), scores.shape)
    end, matches = j, 0
    while scores[i, j] > 0:
        same = item[i - 1] == text[j - 1]
        if scores[i, j] == scores[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += bool(same)
            i, j = i - 1, j - 1
        elif scores[i, j] == scores[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return matches, int(j), int(end)


def best_alignment(item: np.ndarray, text: np.ndarray, least: float) -> tuple[int, int, int, int] | None:
    """Score, matches and span of the best local alignment with at least ``least``; wide texts in overlapping runs."""
    reach = len(item) * REACH
    width = max(ALIGNED_CELLS // (len(item) + 1), 2 * reach)
    best = None
    for start in range(0, max(len(text) - reach, 1), width - reach):
        part = text[start:start + width]
        scores = align(item, part)
        top = int(scores.max())
        if top >= least and (best is None or top > best[0]):
            matches, a, b = trace(scores, item, part)
            best = (top, matches, start + a, start + b)
    return best


def stretches(own: np.ndarray, words: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Joined ranges of ``words`` that shared n-grams point to, half the item's length to either side; and the longest shared run."""
    n = min(SEED_WORDS, len(own))
    mine = gram_hashes(own, n)
    order = np.argsort(mine, kind="stable")
    hashes, at = known_grams(words, n)
    low, high = np.searchsorted(mine[order], hashes), np.searchsorted(mine[order], hashes, "right")
    counts = high - low
    if not counts.sum():
        return [], 0
    ends = np.cumsum(counts)
    place = order[np.repeat(low - (ends - counts), counts) + np.arange(ends[-1])]
    at = np.repeat(at, counts)
    start = at - place
    by = np.lexsort((at, start))
    at, start = at[by], start[by]
    breaks = np.flatnonzero(np.r_[True, (np.diff(start) != 0) | (np.diff(at) != 1), True])
    low = np.maximum(start - len(own) // 2, 0)
    high = np.minimum(start + len(own) + len(own) // 2 + 1, len(words))
    cuts = np.flatnonzero(low[1:] > high[:-1])
    ranges = zip(low[np.r_[0, cuts + 1]].tolist(), high[np.r_[cuts, len(high) - 1]].tolist(), strict=True)
    return list(ranges), int(np.diff(breaks).max()) + n - 1


def _align_pairs(min_share: float, run_words: int):
    remembered: dict = {}

    def best_of(item: int, own: np.ndarray, words: np.ndarray) -> tuple | None:
        ranges, run = stretches(own, words)
        least = MATCH * (min(run_words, min_share * len(own)) if run >= run_words else min_share * len(own))
        best = None
        for low, high in ranges:
            window = words[low:high]
            if MATCH * np.isin(own, window).sum() < least:
                continue
            key = (item, least, window.tobytes())
            if key not in remembered:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                remembered[key] = best_alignment(own, window, least)
            found = remembered[key]
            if found and (best is None or found[0] > best[0]):
                best = (found[0], found[1], low + found[2], low + found[3])
        return best

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            doc_ids, item_ids, items, firsts = (part.column(c).to_pylist() for c in ("doc_id", "item_id", "item", "first_word"))
            for k, (doc_id, item_id, item, first) in enumerate(zip(doc_ids, item_ids, items, firsts, strict=True)):
                own, words = (part.column(c)[k].values.to_numpy().view(np.uint64) for c in ("own", "words"))
                best = best_of(item, own, words)
                if best:
                    score, matches, a, b = best
                    rows.append((doc_id, item_id, score / (MATCH * len(own)), matches, first + a, first + b))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FOUND.split(", ")])

    return aligned


def _joined(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join of rows that have a column ``segment`` with the table ``few``; a key's rows are spread over ``SALTS`` tasks."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _ranked(items: DataFrame, segments: DataFrame) -> DataFrame:
    """``(item, gram, seed)`` for the n-grams of each item that stand in a segment; seeds are the rarer half, ties by hash."""
    grams = items.select("item", F.explode("grams").alias("gram"))
    counts = segments.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("segments"))
    present = Window.partitionBy("item")
    rank = F.row_number().over(present.orderBy("segments", "gram"))
    return grams.join(counts, "gram").select("item", "gram", (2 * rank <= F.count("*").over(present) + 1).alias("seed"))


def _pairs(segments: DataFrame, ranked: DataFrame) -> DataFrame:
    """Distinct ``(segment, item)`` that share an n-gram: by a join on seeds, and by distinct sets of n-grams where no seed is shared."""
    postings = segments.select("segment", F.explode("grams").alias("gram"))
    by_seed = _joined(postings, ranked.filter("seed").select("gram", "item"), "gram").select("segment", "item")
    sets = segments.select("segment", F.xxhash64("grams").alias("set"), "grams")
    one = sets.groupBy("set").agg(F.min_by("grams", "segment").alias("grams"))
    held = one.select(F.col("set").alias("segment"), F.explode("grams").alias("gram"))
    items = _joined(held, ranked, "gram").groupBy("segment", "item").agg(F.max("seed").alias("seed"))
    frequent = items.filter("NOT seed").select(F.col("segment").alias("set"), "item")
    by_set = _joined(sets.select("segment", "set"), frequent, "set").select("segment", "item")
    return by_seed.distinct().unionByName(by_set)


def contaminated(
    docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, run_words: int = RUN_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row per document and test item that share a run of ``run_words`` words or align with ``min_share`` of the item's own score.

    Only pairs that share a word n-gram are aligned.  ``score`` is the share of the item's own score, ``n_matches``
    the equal words, and the span counts words of the document.  Null and empty texts and items match nothing.  Rows
    that share a document id count as one document, the best of them per item; rows that share
    an item id likewise.  Of equal scores the first span in the text counts.
    """
    spark = docs.sparkSession
    hashed = map_texts(id_text(items, item_col, item_text_col), _hash_items(), ITEMS).filter(F.size("words") > 0)
    items = materialize(hashed.withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = items.agg(F.max(F.size("words")).alias("longest"), F.collect_set(F.least(F.size("words"), F.lit(SEED_WORDS))).alias("n")).first()
    if not sizes["longest"]:
        return spark.createDataFrame([], FOUND)
    known = [Bitmap(items.select(F.explode(c).alias("key")).distinct(), SPARE_BITS) for c in ("words", "grams")]
    cut = map_texts(id_text(docs, id_col, text_col), _cut_documents(*known, sorted(sizes["n"]), sizes["longest"]), SEGMENTS)
    segments = materialize(cut.withColumn("segment", F.monotonically_increasing_id()), "segments")
    ranked = materialize(_ranked(items, segments), "ranked-grams")
    own = items.select("item", "item_id", F.col("words").alias("own"))
    pairs = _joined(_pairs(segments, ranked), own, "item").join(segments.drop("grams"), "segment")
    # Every word of the item the segment lacks leaves a place of the item without a match.
    most = F.size("own") - F.size(F.array_except("own", "words"))
    least = F.least(F.lit(float(run_words)), min_share * F.size("own"))
    found = pairs.filter(most >= least).select("doc_id", "item_id", "item", "first_word", "own", "words")
    found = found.mapInArrow(_align_pairs(min_share, run_words), StructType.fromDDL(FOUND))
    order = F.struct("score", -F.col("start_word"), "n_matches", -F.col("end_word"))
    best = F.max_by(F.struct("score", "n_matches", "start_word", "end_word"), order).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
