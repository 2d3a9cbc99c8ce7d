"""Reading corpora: many sources with different field names into one table."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import FAILURES, materialize, small_side


@dataclasses.dataclass(frozen=True)
class Corpus:
    """One source of one domain.

    ``paths`` are tried in turn until one can be opened.  ``seq`` is a column (or
    SQL expression) with the document's place in the source; it must be unique
    in the domain and not negative.  ``domain`` may be a SQL expression if
    ``domain_is_expr``, for a table that holds several domains.
    """

    domain: str
    paths: list[str]
    field: str = "text"
    seq: str = "doc_seq"
    format: str = "parquet"
    options: dict = dataclasses.field(default_factory=dict)
    schema: str | None = None
    domain_is_expr: bool = False


def open_corpus(spark: SparkSession, corpus: Corpus, stream: bool = False) -> DataFrame:
    """``(domain, doc_seq, text)`` from the first path that opens."""
    failure = None
    for path in corpus.paths:
        try:
            return project(_reader(spark, corpus, stream).load(path), corpus)
        except FAILURES as e:
            failure = e
    raise failure or ValueError(f"no path given for {corpus.domain}")


def _reader(spark, corpus, stream):
    reader = spark.readStream if stream else spark.read
    reader = reader.format(corpus.format)
    for key, value in corpus.options.items():
        reader = reader.option(key, value)
    return reader.schema(corpus.schema) if corpus.schema else reader


def project(df, corpus):
    """A missing text field reads as null, and such rows fall to the length filter."""
    domain = F.expr(corpus.domain) if corpus.domain_is_expr else F.lit(corpus.domain)
    text = F.col(corpus.field) if corpus.field in df.columns else F.lit(None)
    return df.select(
        domain.alias("domain"),
        F.expr(corpus.seq).cast("long").alias("doc_seq"),
        text.cast("string").alias("text"),
    )


STATUS_SCHEMA = "domain string, status string, error string"
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("doc_seq", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def scan_corpora(
    spark: SparkSession, catalog: list[Corpus], on_error: str = "raise"
) -> tuple[DataFrame, DataFrame]:
    """All corpora as one bag, and a status row per catalog entry.

    With ``on_error="skip"`` an entry that cannot be opened is reported in the
    status table and the rest is read.
    """
    opened, status = [], []
    for corpus in catalog:
        try:
            opened.append(open_corpus(spark, corpus))
            status.append((corpus.domain, "ok", None))
        except FAILURES as e:
            if on_error != "skip":
                raise
            status.append((corpus.domain, "failed", str(e)))
    if opened:
        docs = reduce(DataFrame.unionByName, opened)
    else:
        docs = spark.createDataFrame([], CORPUS_SCHEMA)
    return docs, spark.createDataFrame(status, STATUS_SCHEMA)


def write_line_docs(
    docs: DataFrame, path: str, text: str = "text_norm", mode: str = "append",
    max_records: int = 0, ordered: bool = False,
) -> None:
    """One document per line, one folder per domain.

    Cleaned text holds no line break, so a line is a document.  ``max_records``
    limits the lines per file.  Every task appends files to the folders of the
    domains it has seen, without a shuffle; with ``ordered`` the documents are
    first range-partitioned and sorted, so that the lines of a domain's files, in
    name order, are in ``doc_seq`` order.
    """
    if ordered:
        docs = docs.repartitionByRange("domain", "doc_seq").sortWithinPartitions("domain", "doc_seq")
    (
        docs.select("domain", F.col(text).alias("value"))
        .write.mode(mode)
        .option("maxRecordsPerFile", max_records)
        .partitionBy("domain")
        .text(path)
    )


# Fixed value: the folder Spark writes for a null or empty partition value.
NO_DOMAIN = "__HIVE_DEFAULT_PARTITION__"


def _plain_name(name: Column) -> Column:
    """Undoes one layer of percent signs; the writer escapes folder names and the file URI escapes them again."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_line_docs(spark: SparkSession, path: str | list[str], ordered: bool = False) -> DataFrame:
    """``(domain, text)`` of line documents.

    The domain is the ``domain=`` folder as it was before it became a folder name, or the
    name of a ``.txt`` file.  With
    ``ordered`` the documents get a dense ``doc_seq`` by file and line.  Lines
    are numbered as they are scanned and stored with the number, since it is not
    part of the data; within a file block the numbers are consecutive, so only
    the blocks (one row each) need to be put in order, and no text is shuffled
    unless there are very many blocks.
    """
    where = F.col("_metadata.file_path")
    by_folder = _plain_name(_plain_name(F.regexp_extract(where, r"/domain=([^/]*)/[^/]*$", 1)))
    by_file = _plain_name(F.regexp_extract(where, r"/([^/]*)\.txt$", 1))
    lines = (
        spark.read.schema("value string")
        .option("recursiveFileLookup", True)
        .text(path)
    )
    domain = F.when(by_folder != "", F.nullif(by_folder, F.lit(NO_DOMAIN))).otherwise(by_file)
    if not ordered:
        return lines.select(domain.alias("domain"), F.col("value").alias("text"))
    placed = materialize(
        lines.select(
            domain.alias("domain"),
            F.col("value").alias("text"),
            where.alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        ),
        "lines",
    )
    blocks = materialize(
        placed.groupBy("domain", "_file", "_block").agg(
            F.count("*").alias("_n"), F.min("_line").alias("_first")
        ),
        "line-blocks",
    )
    earlier = (
        Window.partitionBy("domain")
        .orderBy("_file", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = blocks.select(
        "domain",
        "_file",
        "_block",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(small_side(shifts, blocks.count()), ["domain", "_file", "_block"])
        .select("domain", "text", (F.col("_line") + F.col("_shift")).alias("doc_seq"))
    )
