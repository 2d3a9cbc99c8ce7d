"""Token counts by rank-synchronous merging of ragged symbol arrays.

``token_counts`` counts the tokens of each text as the tokenizers library does
for a BPE file with word ends.  The distinct new pre-tokens of a slice of texts
become one flat symbol array with an owner per symbol.  Every step looks up the
rank of each adjacent pair, takes the lowest rank of every pre-token and applies
that pair at all its places in that pre-token at once; what is left when no pair
has a rank is the number of tokens.  Counts are remembered per worker.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.byte_ids import byte_alphabet
from millrace.llm.common import LETTER, NOT_PLAIN, NUMBER, map_texts

REMEMBERED = 400_000
NO_RANK = np.iinfo(np.int32).max

# The pre-token pattern of the file, for plain characters.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


class RankMerger:
    """Counts BPE tokens of many pre-tokens (as UTF-8 bytes) at a time."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.width = len(vocab)
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.results = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[alphabet[b] + suffix] for b in range(256)], np.int64)

    def _pairs(self, symbols: np.ndarray, same: np.ndarray):
        key = symbols[:-1] * self.width + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(same & (self.keys[at] == key), self.ranks[at], NO_RANK)

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in pre_tokens], np.int64)
        counts = lengths.copy()
        held = np.flatnonzero(lengths)
        raw = np.frombuffer(b"".join(pre_tokens), np.uint8)
        ends = np.cumsum(lengths[held])
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(held, lengths[held])
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            at, rank = self._pairs(symbols, same)
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            counts[owner[starts]] = sizes
            low = np.repeat(best, sizes)
            places = np.flatnonzero((rank == low[:-1]) & (rank < NO_RANK))
            if not len(places):
                break
            fresh = np.r_[True, places[1:] != places[:-1] + 1]  # a run "aaa" merges from its left end
            run_start = places[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            places = places[(places - run_start) % 2 == 0]
            symbols[places] = self.results[at[places]]
            keep = low < NO_RANK  # a pre-token without a ranked pair is finished
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            counts[owner[0]] = 1
        return counts


class TokenCounter:
    """Tokens of whole texts for one file; keeps the counts of pre-tokens seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merger = RankMerger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.bytes_of = {c: b for b, c in byte_alphabet().items()}
        self.known: dict = {}

    def _cut(self, text: str) -> list:
        """Pre-tokens of a text without special strings; as bytes where the library's tables are needed."""
        if not NOT_PLAIN.search(text):
            return PRE_TOKEN.findall(text.lower())
        cut = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, piece)) for piece, _ in cut]

    def counts(self, texts: list[str]) -> list[int]:
        cut, special = [], []
        for text in texts:
            parts = self.special.split(text)
            special.append(len(parts) - 1)
            cut.append([t for part in parts for t in self._cut(part)] if len(parts) > 1 else self._cut(text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({t for tokens in cut for t in tokens if t not in known})
        raw = [t if isinstance(t, bytes) else t.encode() for t in new]
        known.update(zip(new, self.merger.count(raw).tolist(), strict=True))
        return [n + sum(map(known.__getitem__, tokens)) for n, tokens in zip(special, cut, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows give
    repeated results; other columns are not read.  Special strings inside a
    text count one token each, as the library does by default.
    """

    def count(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "n_bytes": pa.compute.binary_length(part.column("text")),
                "n_tokens": counter(tokenizer_path).counts(part.column("text").to_pylist())}

    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    counted = map_texts(read, count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
