"""Small helpers the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20  # text held as Python objects at a time


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus) == F.lit(remainder)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, null text as empty text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``size`` bytes of text each; no row is left out."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0))
    run = np.cumsum(sizes.astype(np.int64) + 64) // size
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for start, stop in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, stop - start)


def arrow_batches(function, schema: StructType, size: int = SLICE_BYTES):
    """A ``mapInArrow`` function from one that turns a slice into a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=size):
                columns = function(part)
                arrays = [pa.array(columns[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return run


def map_texts(docs: DataFrame, function, schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """Applies ``function(slice) -> {column: values}`` to the rows of ``docs``."""
    fields = StructType.fromDDL(schema)
    return docs.mapInArrow(arrow_batches(function, fields, size), fields)


def keep_rows(docs: DataFrame, decide, text_col: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for whose texts ``decide(texts)`` gives true; null is empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, size):
                texts = pa.compute.fill_null(part.column(text_col), "").to_pylist()
                yield part.filter(pa.array(np.asarray(decide(texts), bool)))

    return docs.mapInArrow(run, docs.schema)


def looked_up(known: dict[str, int], words: list[str]) -> np.ndarray:
    """The numbers ``known`` gives to words it has."""
    if len(words) < 2:
        return np.array([known[w] for w in words], np.int64)
    return np.array(itemgetter(*words)(known), np.int64)


def ragged_sums(table: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` rows ``table[places]``; runs of one length are summed together."""
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), table.shape[1]), table.dtype)
    for n in np.unique(counts[counts > 0]).tolist():
        own = np.flatnonzero(counts == n)
        step = max((1 << 18) // n, 1)
        for k in range(0, len(own), step):
            some = own[k:k + step]
            out[some] = table[places[starts[some][:, None] + np.arange(n)]].sum(axis=1)
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


# Characters on which the tokenizers' Unicode tables, Python's and NFC agree character by character:
# printable ASCII, precomposed Latin letters without the dotted capital I, typographic punctuation.
PLAIN = r"\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧‰-‾€"
NOT_PLAIN = re.compile(f"[^{PLAIN}]")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
