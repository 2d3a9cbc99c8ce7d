"""Document cleaning and token counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import MAX_CHARS, MIN_CHARS, normalize_text


def clean(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    text: str = "text",
) -> DataFrame:
    """Keeps documents of at least ``min_chars`` before and after normalisation.

    Null and missing texts fail the first test.  ``text`` is replaced by
    ``text_norm``.  The cheap raw-length test stands first so that the regex
    runs on survivors of it only.  The regex is the input of a generator
    (``stack`` of one row): the optimizer would copy a projected expression into
    the second filter and run it twice.
    """
    others = [c for c in docs.columns if c != text]
    return (
        docs.filter(F.length(text) >= min_chars)
        .select(*others, F.stack(F.lit(1), normalize_text(F.col(text), max_chars)).alias("text_norm"))
        .filter(F.length("text_norm") >= min_chars)
    )


def measure(
    docs: DataFrame,
    tokenizer,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """One row per raw document: ``survivor`` and ``n_tokens`` in place of the text.

    ``survivor`` is the outcome of :func:`clean`; a document that is none has
    zero tokens.  Rows are kept, because quota and accounting need the place of
    the dropped ones too.  ``keep_text`` adds ``text_norm`` (null for those).
    """
    normed = docs.withColumn(
        "_norm", F.when(F.length(text) >= min_chars, normalize_text(F.col(text), max_chars))
    ).withColumn("text_norm", F.when(F.length("_norm") >= min_chars, F.col("_norm")))
    survives = F.col("text_norm").isNotNull()
    return normed.select(
        *[c for c in docs.columns if c != text],
        *(["text_norm"] if keep_text else []),
        survives.alias("survivor"),
        F.coalesce(F.when(survives, tokenizer.count(F.col("text_norm"))), F.lit(0))
        .cast("long")
        .alias("n_tokens"),
    )


def count_tokens(cleaned: DataFrame, tokenizer, text: str = "text_norm") -> DataFrame:
    """Adds ``n_tokens``."""
    return cleaned.withColumn("n_tokens", tokenizer.count(F.col(text)))


def encode(cleaned: DataFrame, tokenizer, text: str = "text_norm") -> DataFrame:
    """Adds ``n_tokens`` and ``ids``; the count is that of the ids, so the tokenizer runs once."""
    with_ids = cleaned.withColumn("ids", tokenizer.encode(F.col(text)))
    return with_ids.select(*cleaned.columns, F.size("ids").alias("n_tokens"), "ids")


def drop_uncounted(counted: DataFrame) -> DataFrame:
    """Drops documents with zero tokens, which includes failed tokenisation."""
    return counted.filter(F.col("n_tokens") > 0)
