"""Tokenizers: a count and an id array per text.

``WordTokenizer`` and ``PatternTokenizer`` are plain column expressions.
``SentencePieceTokenizer`` runs a model file inside Arrow batches, loading it
once per Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCAB_SIZE = 131_072
FIRST_WORD_ID = 3  # 0 pads, 1 begins and 2 ends a document


def hashed_id(word: Column, vocab_size: int = VOCAB_SIZE) -> Column:
    """Id in ``[3, vocab_size)`` from the first 32 bits of the word's MD5."""
    bits = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
    return (bits % (vocab_size - FIRST_WORD_ID) + FIRST_WORD_ID).cast("int")


class WordTokenizer:
    """Space-separated words of a normalised text, with hashed ids."""

    def __init__(self, vocab_size: int = VOCAB_SIZE):
        self.vocab_size = vocab_size

    def count(self, text: Column) -> Column:
        return F.size(F.split(text, " "))

    def encode(self, text: Column) -> Column:
        return F.transform(F.split(text, " "), lambda w: hashed_id(w, self.vocab_size))


class PatternTokenizer:
    """All matches of a regular expression, with hashed ids; may find none."""

    def __init__(self, pattern: str, vocab_size: int = VOCAB_SIZE):
        self.pattern = pattern
        self.vocab_size = vocab_size

    def _matches(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"({self.pattern})"), F.lit(1))

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.pattern))

    def encode(self, text: Column) -> Column:
        return F.transform(self._matches(text), lambda w: hashed_id(w, self.vocab_size))


class SentencePieceTokenizer:
    """A SentencePiece model file, sent to every executor.

    A text the model cannot process counts zero tokens.  The UDFs are marked
    nondeterministic so that a filter on their output does not run them twice.
    """

    def __init__(self, spark: SparkSession, model_path: str):
        spark.sparkContext.addFile(model_path)
        self.file_name = model_path.rsplit("/", 1)[-1]

    def count(self, text: Column) -> Column:
        name = self.file_name

        @F.pandas_udf("int")
        def n_pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
            for texts in batches:
                yield pd.Series([_encoded(model, t, count_only=True) for t in texts], dtype="int32")

        return n_pieces.asNondeterministic()(text)

    def encode(self, text: Column) -> Column:
        name = self.file_name

        @F.pandas_udf("array<int>")
        def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
            for texts in batches:
                yield pd.Series([_encoded(model, t) for t in texts], dtype="object")

        return pieces.asNondeterministic()(text)


def _encoded(model, text, count_only=False):
    try:
        ids = model.encode(text)
    except Exception:
        ids = []
    return len(ids) if count_only else ids
