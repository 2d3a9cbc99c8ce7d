"""A zone map over the Parquet files of a corpus, and what is broken in them.

Tasks read the footers: one row per file with its rows and the range of its document places.  A job that wants a
range of places opens the files that can hold some, so files behind a budget's cut are never opened.  A file without
a readable footer is left out and named.  One with damaged pages shows only when it is read; then the files of that
range are read through in tasks, the damaged ones are left out and named, and the read is done again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import FAILURES, materialize
from millrace.sources.corpora import CORPUS_SCHEMA, Corpus, project
from millrace.sources.paths import open_fs, qualified

FILES = "path string, n_rows long, unplaced long, low long, high long, error string"
BROKEN = "path string, error string"
FILES_PER_TASK = 200


class FileIndex:
    """The readable files of one corpus; ``faults`` are rows ``(path, error, rows lost, first place)``.

    The number of lost rows and the first place are null where the footer cannot be read.
    """

    def __init__(self, corpus: Corpus, path: str, files: DataFrame, skip_broken: bool = False):
        self.corpus, self.path, self.spark, self.skip_broken = corpus, path, files.sparkSession, skip_broken
        self.files = files.filter("error IS NULL AND n_rows > 0")
        self.faults = [(r["path"], r["error"], None, None) for r in files.filter("error IS NOT NULL").collect()]
        ranges = self.files.agg(
            F.count("*").alias("n"), F.count("low").alias("ranges"),
            F.coalesce(F.sum("unplaced"), F.lit(0)).alias("unplaced"),
        )
        self.n_files, self.n_ranges, self.unplaced = ranges.first()
        self._schema = None

    def bounds(self, after: int) -> tuple[int | None, int | None]:
        """The first and last place behind ``after`` that a file's range allows."""
        rest = self._sound().filter(F.col("high") > after)
        return rest.agg(F.min(F.greatest("low", F.lit(after + 1))), F.max("high")).first()

    def read(self, low: int, high: int | None = None) -> DataFrame:
        """``(domain, doc_seq, text)`` of the places from ``low`` to before ``high``."""
        paths = [r["path"] for r in self._range(low, high).select("path").orderBy("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], CORPUS_SCHEMA)
        reader = self.spark.read.option("basePath", self.path)
        schema = self.corpus.schema or self._schema
        raw = (reader.schema(schema) if schema else reader).parquet(*map(_literal, paths))
        self._schema = raw.schema
        place = F.col("doc_seq")
        docs = project(raw, self.corpus).filter(place >= low)
        return docs if high is None else docs.filter(place < high)

    def stored(self, make: Callable[[DataFrame], DataFrame], name: str, low: int, high: int | None = None) -> DataFrame:
        """``make`` of a range, written; damaged files are found, left out and reported."""
        while True:
            try:
                return materialize(make(self.read(low, high)), name)
            except FAILURES:
                if not self.skip_broken:
                    raise
                paths = self._range(low, high).select("path", "n_rows", "low")
                broken = _spread(paths.select("path")).mapInArrow(_read_through, BROKEN)
                found = broken.join(paths, "path").select("path", "error", "n_rows", "low").collect()
                if not found:
                    raise
                self.faults += [tuple(r) for r in found]

    def _sound(self):
        out = [f[0] for f in self.faults if f[2] is not None]
        return self.files.filter(~F.col("path").isin(out)) if out else self.files

    def _range(self, low, high):
        files = self._sound().filter(F.col("high") >= low)
        return files if high is None else files.filter(F.col("low") < high)


def file_index(spark: SparkSession, corpus: Corpus, skip_broken: bool = False) -> FileIndex | None:
    """The index of the first of the corpus's paths with a readable file.

    None where there is none to make: for other formats, reader options, path patterns, order
    keys that are no plain column with whole-number ranges in every footer, and file systems Arrow cannot open; also
    for a broken footer unless ``skip_broken``, so that Spark's own reader reports it.
    """
    if corpus.format != "parquet" or corpus.options or corpus.domain_is_expr or not re.fullmatch(r"\w+", corpus.seq):
        return None
    for path in corpus.paths:
        if re.search(r"[*?\[{]", path):
            return None
        try:
            _open(qualified(spark, path))
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
            files = materialize(_spread(listed).mapInArrow(_footers(corpus.seq), FILES), "files")
        except (*FAILURES, OSError, pa.ArrowException):
            continue
        index = FileIndex(corpus, path, files, skip_broken)
        if index.faults and not skip_broken:
            return None
        if index.n_files:
            return index if index.n_ranges == index.n_files else None
    return None


def _spread(files: DataFrame) -> DataFrame:
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(cores, -(-files.count() // FILES_PER_TASK)), "path")


def _open(path: str):
    """File system and path for a path as Hadoop writes it, where blanks and percent signs stand for themselves."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open_fs("/" + rest.lstrip("/"))
    return open_fs(f"{scheme}:{quote(rest, safe='/:@')}")


def _literal(path: str) -> str:
    """A path that Spark does not take for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _footers(seq: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_footer(path, seq) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("path", pa.string()), ("n_rows", pa.int64()), ("unplaced", pa.int64()),
    ("low", pa.int64()), ("high", pa.int64()), ("error", pa.string()),
])


def _footer(path: str, seq: str) -> tuple:
    system, name = _open(path)
    try:
        with system.open_input_file(name) as f:
            meta = pq.read_metadata(f)
    except (OSError, pa.ArrowException) as e:
        return path, None, None, None, None, str(e)
    columns = [k for k in range(meta.num_columns) if meta.schema.column(k).path.lower() == seq.lower()]
    groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
    stats = [g.column(k).statistics for k in columns[:1] for g in groups if g.num_rows]
    low = high = unplaced = None
    if stats and all(s is not None and s.has_null_count for s in stats):
        unplaced = sum(s.null_count for s in stats)
        ranged = [s for s in stats if s.has_min_max]
        if all(s.has_min_max or s.num_values == 0 for s in stats) and all(type(s.min) is int for s in ranged) and ranged:
            low, high = min(s.min for s in ranged), max(s.max for s in ranged)
    return path, meta.num_rows, unplaced, low, high, None


def _read_through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files that cannot be read to their end, held a few rows at a time."""
    for batch in batches:
        broken = []
        for path in batch.column("path").to_pylist():
            system, name = _open(path)
            try:
                with system.open_input_file(name) as f:
                    for _ in pq.ParquetFile(f).iter_batches(1024):
                        pass
            except (OSError, pa.ArrowException) as e:
                broken.append((path, str(e)))
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([p for p, _ in broken], pa.string()), "error": pa.array([e for _, e in broken], pa.string()),
        })
