"""Token ids in compressed files with a shared dictionary and an index per file.

A part is two files.  ``<name>.zids`` holds one zstandard frame per document,
compressed with the dictionary, of its ids as little-endian unsigned 32-bit
integers.  ``<name>.zidx`` holds the layout name, the SHA-256 of the dictionary,
the number of documents, and one array each of ids present, document ids, frame
offsets, frame sizes and token counts.  ``<sha256>.zdict`` is the dictionary, so
a short document is read with one small range of one file.  ``parts`` is a
Parquet table naming the parts in document order; files of failed attempts are
not named there and never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.byte_ids import byte_ids
from millrace.llm.common import id_text, slices
from millrace.sources.paths import open_fs, shared

LAYOUT = b"MRZIDX01"
FIELDS = (("present", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8"))
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 256  # documents the dictionary is trained on
SAMPLE_CHARS = 1 << 16  # longer documents are not taken into that sample
READ_BYTES = 8 << 20

PARTS = "part int, name string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _codec(dictionary: bytes):
    import zstandard

    shared_dict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    options = {"dict_data": shared_dict} if shared_dict else {}
    return zstandard.ZstdCompressor(level=LEVEL, **options), zstandard.ZstdDecompressor(**options)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """Dictionary from the ids of at most ``SAMPLE_DOCS`` documents, chosen by a hash of their id.

    Empty where there is too little to train on; frames then have no dictionary.
    """
    import zstandard

    place = F.xxhash64("doc_id")
    chosen = [r[0] for r in docs.select("doc_id").orderBy(place, "doc_id").limit(SAMPLE_DOCS).collect()]
    short = docs.filter(F.col("doc_id").isin([c for c in chosen if c is not None]))
    texts = short.filter(F.length("text") <= SAMPLE_CHARS).orderBy(place, "text").limit(SAMPLE_DOCS).collect()
    encoder, end = byte_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
    samples = [ids + end for ids in encoder.encode([r["text"] for r in texts])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_id_archive(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, parts: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes the ids of every whole text, then ``end_id``, in ascending order of id.

    Null text is empty text and gives the end id alone; a null id sorts first;
    rows that share an id follow each other ordered by a hash of their text, and however many
    share one, or the text as well, they are dealt to several parts.  An empty table
    gives an archive without parts.
    """
    spark = docs.sparkSession
    folder = shared(spark, folder)
    docs = id_text(docs, id_col, text_col)
    dictionary = train_dictionary(docs, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary)
    system, root = open_fs(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{digest.hexdigest()}.zdict", compression=None) as out:
        out.write(dictionary)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    write = _part_writer(folder, tokenizer_path, end_id, dictionary)
    keyed = docs.withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(parts, "doc_id", "_hash", "_place").sortWithinPartitions("doc_id", "_hash", "text")
    ordered.drop("_hash", "_place").mapInArrow(write, PARTS).write.parquet(f"{folder}/parts")


def _part_writer(folder: str, tokenizer_path: str, end_id: int, dictionary: bytes):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        compressor, _ = _codec(dictionary)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        entries = {field: [] for field, _ in FIELDS}
        system, root = open_fs(folder)
        offset, out = 0, None
        try:
            for batch in batches:
                for piece in slices(batch):
                    out = out or system.open_output_stream(f"{root}/{name}.zids", compression=None)
                    raw = [ids + end for ids in encoder.encode(piece.column("text").to_pylist())]
                    frames = [compressor.compress(r) for r in raw]
                    sizes = np.array([len(f) for f in frames], np.int64)
                    entries["present"].append(pc.is_valid(piece["doc_id"]).to_numpy(zero_copy_only=False))
                    entries["doc_id"].append(pc.fill_null(piece["doc_id"], 0).to_numpy(zero_copy_only=False))
                    entries["offset"].append(offset + np.cumsum(sizes) - sizes)
                    entries["size"].append(sizes)
                    entries["n_tokens"].append(np.array([len(r) // 4 for r in raw], np.int64))
                    offset += int(sizes.sum())
                    out.write(b"".join(frames))
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        columns = {k: np.concatenate(v) for k, v in entries.items()}
        n = len(columns["size"])
        with system.open_output_stream(f"{root}/{name}.zidx", compression=None) as index:
            index.write(LAYOUT + hashlib.sha256(dictionary).digest() + n.to_bytes(8, "little"))
            for field, kind in FIELDS:
                index.write(columns[field].astype(kind).tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([n], pa.int64()),
            "n_tokens": pa.array([int(columns["n_tokens"].sum())], pa.int64()),
        })

    return write


def read_index(system, path: str) -> tuple[str, dict[str, np.ndarray]]:
    """Dictionary hash and columns of one index file."""
    with system.open_input_file(path) as f:
        raw = f.read()
    if raw[:8] != LAYOUT:
        raise ValueError(f"{path} is not an index of token ids")
    n, at, columns = int.from_bytes(raw[40:48], "little"), 48, {}
    for field, kind in FIELDS:
        columns[field] = np.frombuffer(raw, kind, n, at)
        at += columns[field].nbytes
    return raw[8:40].hex(), columns


def _dictionary(system, root: str, digest: str) -> bytes:
    with system.open_input_file(f"{root}/{digest}.zdict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary {digest} is damaged")
    return dictionary


def _entry(f, row: int) -> tuple[str, dict[str, int]]:
    """Dictionary hash and one row of an index file, by a small read of its header and one of each column."""
    raw = f.read_at(48, 0)
    if raw[:8] != LAYOUT:
        raise ValueError("not an index of token ids")
    n, at, entry = int.from_bytes(raw[40:48], "little"), 48, {}
    if not 0 <= row < n:
        raise IndexError(f"row {row} of an index of {n}")
    for field, kind in FIELDS:
        width = np.dtype(kind).itemsize
        entry[field] = int(np.frombuffer(f.read_at(width, at + row * width), kind)[0])
        at += n * width
    return raw[8:40].hex(), entry


def read_document(folder: str, name: str, row: int) -> np.ndarray:
    """Ids of one document of a part, by its place in the index: small reads only, however large the part."""
    system, root = open_fs(folder)
    with system.open_input_file(f"{root}/{name}.zidx") as f:
        digest, entry = _entry(f, row)
    with system.open_input_file(f"{root}/{name}.zids") as f:
        frame = f.read_at(entry["size"], entry["offset"])
    return np.frombuffer(_codec(_dictionary(system, root, digest))[1].decompress(frame), "<u4")


def read_id_archive(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row per document with its place in the whole id stream, a checksum, and the serialised ids on demand."""
    folder = shared(spark, folder)
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts").orderBy("part").collect()  # a row per file
    starts = accumulate((p["n_tokens"] for p in parts), initial=0)
    rows = [(p["name"], start) for p, start in zip(parts, starts, strict=False)]
    fields = READ + (", ids binary" if with_ids else "")
    if not rows:
        return spark.createDataFrame([], StructType.fromDDL(fields))
    todo = spark.createDataFrame(rows, "name string, start long").repartition(len(rows))
    return todo.mapInArrow(_part_reader(folder, with_ids), fields)


def _part_reader(folder: str, with_ids: bool):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        codecs = {}
        for batch in batches:
            for row in batch.to_pylist():
                digest, index = read_index(system, f"{root}/{row['name']}.zidx")
                if digest not in codecs:
                    codecs[digest] = _codec(_dictionary(system, root, digest))[1]
                yield from _documents(system, f"{root}/{row['name']}.zids", index, row["start"], codecs[digest])

    def _documents(system, path, index, start, decompressor):
        starts = start + np.cumsum(index["n_tokens"].astype(np.int64)) - index["n_tokens"].astype(np.int64)
        ends = (index["offset"] + index["size"]).astype(np.int64)
        run = (ends + 4 * np.cumsum(index["n_tokens"].astype(np.int64))) // READ_BYTES
        cuts = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
        with system.open_input_file(path) as f:
            for a, b in zip(cuts, cuts[1:], strict=False):
                low = int(index["offset"][a])
                block = memoryview(f.read_at(int(ends[b - 1]) - low, low))
                frames = zip((index["offset"][a:b].astype(np.int64) - low).tolist(), index["size"][a:b].tolist(), strict=True)
                raw = [decompressor.decompress(block[o:o + s]) for o, s in frames]
                columns = {
                    "doc_id": pa.array(index["doc_id"][a:b], pa.int64(), mask=index["present"][a:b] == 0),
                    "start": starts[a:b],
                    "n_tokens": pa.array([len(r) // 4 for r in raw], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))

    return read
