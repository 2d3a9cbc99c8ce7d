"""Spark data source ``tokshard``: fixed-length token sequences in binary shards.

One shard is three files.  ``<name>.bin`` has a 36-byte header (magic, version,
number of sequences, sequence length, padding) and the ids as little-endian
uint32.  ``<name>.idx`` has the two counts and one (offset, length) entry per
sequence.  ``<name>.meta`` is JSON with the counts and the name.

Options: ``magic`` (8 bytes, default ``MILLRACE``), ``prefix`` (file name prefix,
default ``shard``), on write ``digits`` (of the number in a name, default 3; enough
of them keep name order and number order the same), and on read ``part`` (``body``, ``index`` or ``header``),
``wide`` (ids as bigint), ``rangeBytes`` (most bytes per input partition),
``minPartitions`` (small folders are cut into about that many) and ``tolerant`` (a shard that cannot be read gives no rows, for validation).

With ``generations`` on write, a file below ``_generations`` names the shards that make up the folder; readers
follow the latest one.  It is written after the shards, by one rename, and old shards go last, so whenever a
job dies the folder holds a whole generation.  New shards take the next free numbers, so that appending never clashes.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from millrace.sources.paths import open_fs

# The layout of the three files.
HEADER = "<8sIQQQ"
HEADER_BYTES = 36
VERSION = 1
INDEX_HEAD = "<II"
INDEX_HEAD_BYTES = 8
INDEX_ENTRY = [("offset", "<u8"), ("length", "<u4")]
INDEX_ENTRY_BYTES = 12

MAGIC = "MILLRACE"
PREFIX = "shard"
DIGITS = 3
GENERATION_DIGITS = 6
GENERATIONS = "_generations"
SUFFIXES = (".meta", ".idx", ".bin")  # in the order in which they appear: readers look for the last
RANGE_BYTES = 128 << 20
MIN_RANGE_BYTES = 64 << 10
MIN_PARTITIONS = 16
HEADERS_PER_TASK = 256
BATCH_BYTES = 16 << 20
RENAMES_AT_ONCE = 16

BODY_SCHEMA = "shard_id int, shard string, seq_in_shard bigint, tokens array<{ids}>"
INDEX_SCHEMA = (
    "shard_id int, shard string, index_n bigint, index_seq_length bigint, "
    "seq_in_shard bigint, offset bigint, length bigint"
)
HEADER_SCHEMA = (
    "shard_id int, shard string, file_bytes bigint, header_bytes int, magic_ok boolean, "
    "version bigint, num_sequences bigint, seq_length bigint"
)


def magic_bytes(options) -> bytes:
    magic = options.get("magic", MAGIC).encode("latin-1").ljust(8, b"\0")
    if len(magic) != 8:
        raise ValueError("magic must have at most 8 bytes")
    return magic


def latest_generation(fs, root: str, prefix: str) -> tuple[int, list[str] | None]:
    """Number and shard names of the folder's latest generation; ``(0, None)`` if it has none."""
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{GENERATIONS}", allow_not_found=True))
    numbers = [int(m[1]) for i in found if (m := re.fullmatch(rf"{re.escape(prefix)}-(\d+)\.json", i.base_name))]
    if not numbers:
        return 0, None
    with fs.open_input_file(_generation_file(root, prefix, max(numbers))) as f:
        return max(numbers), json.loads(f.read())["shards"]


def _generation_file(root, prefix, number):
    return f"{root}/{GENERATIONS}/{prefix}-{number:0{GENERATION_DIGITS}d}.json"


def current_shards(path: str, prefix: str = PREFIX) -> list[str] | None:
    """The names a folder's latest generation lists, or None if all its shards count."""
    fs, root = open_fs(path)
    return latest_generation(fs, root, prefix)[1]


def _shard_files(fs, root, prefix):
    """``(path, bytes)`` of the ``.bin`` files of a folder."""
    infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return [
        (i.path, i.size)
        for i in infos
        if i.is_file and i.base_name.startswith(f"{prefix}_") and i.base_name.endswith(".bin")
    ]


def list_shards(path: str, prefix: str) -> list[tuple[int, str, int]]:
    """``(shard_id, path without suffix, bytes)`` of the ``.bin`` files in name order."""
    fs, root = open_fs(path)
    bins = sorted(_shard_files(fs, root, prefix))
    _, names = latest_generation(fs, root, prefix)
    if names is not None:
        listed = set(names)
        bins = [(p, size) for p, size in bins if _base(p[: -len(".bin")]) in listed]
        if len(bins) != len(listed):
            raise FileNotFoundError(f"{len(listed) - len(bins)} shards of the latest generation are missing in {path}")
    return [(n, p[: -len(".bin")], size) for n, (p, size) in enumerate(bins)]


def drop_unlisted(path: str, prefix: str = PREFIX) -> list[str]:
    """Deletes the shards that the latest generation does not list, as jobs that died leave them; returns their names.

    Not to be called while a job writes to the folder.
    """
    fs, root = open_fs(path)
    _, names = latest_generation(fs, root, prefix)
    if names is None:
        return []
    infos = fs.get_file_info(pafs.FileSelector(root))
    stems = {i.path.rsplit(".", 1)[0] for i in infos if i.is_file and i.base_name.startswith(f"{prefix}_")}
    gone = sorted(s for s in stems if _base(s) not in set(names))
    _delete_shards(fs, gone)
    return [_base(s) for s in gone]


def _delete_shards(fs, stems):
    for stem in stems:
        for suffix in reversed(SUFFIXES):
            if fs.get_file_info(stem + suffix).type != pafs.FileType.NotFound:
                fs.delete_file(stem + suffix)


@dataclass
class ShardRange:
    """Slice ``part`` of ``parts`` equal slices of one shard."""

    shard_id: int
    stem: str
    size: int
    part: int = 0
    parts: int = 1


@dataclass
class ShardRanges(InputPartition):
    """What one task reads: a slice of a large shard, or several small shards."""

    ranges: list


def group_ranges(shards: list[tuple[int, str, int]], limit: int, cut: bool) -> list[ShardRanges]:
    """Tasks of at most about ``limit`` bytes; shards beyond it are ``cut`` into slices."""
    tasks, open_task, room = [], [], limit
    for shard_id, stem, size in shards:
        parts = max(1, -(-size // limit)) if cut else 1
        if parts > 1:
            tasks += [ShardRanges([ShardRange(shard_id, stem, size, k, parts)]) for k in range(parts)]
            continue
        if open_task and size > room:
            tasks.append(ShardRanges(open_task))
            open_task, room = [], limit
        open_task.append(ShardRange(shard_id, stem, size))
        room -= size
    return tasks + ([ShardRanges(open_task)] if open_task else [])


class TokshardDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tokshard"

    def schema(self):
        part = self.options.get("part", "body")
        if part == "index":
            return INDEX_SCHEMA
        if part == "header":
            return HEADER_SCHEMA
        wide = self.options.get("wide", "false").lower() == "true"
        return BODY_SCHEMA.format(ids="bigint" if wide else "int")

    def reader(self, schema: StructType):
        return TokshardReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return TokshardWriter(self.options, schema, overwrite)


class TokshardReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.prefix = options.get("prefix", PREFIX)
        self.part = options.get("part", "body")
        self.wide = options.get("wide", "false").lower() == "true"
        self.tolerant = options.get("tolerant", "false").lower() == "true"
        self.min_partitions = int(options.get("minPartitions", MIN_PARTITIONS))
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.magic = magic_bytes(options)

    def partitions(self):
        shards = list_shards(self.path, self.prefix)
        if not shards:
            raise FileNotFoundError(f"no shards {self.prefix}_*.bin in {self.path}")
        # Indexes are much smaller than bodies, and of headers a task reads 36 bytes
        # each, so those parts take more shards per task.
        share = {"header": 1 / HEADERS_PER_TASK, "index": 1 / 64}.get(self.part, 1)
        total = sum(size for _, _, size in shards)
        limit = max(MIN_RANGE_BYTES, min(int(self.range_bytes / share), total // self.min_partitions))
        return group_ranges(shards, limit, cut=self.part == "body")

    def read(self, partition):
        fs, _ = open_fs(self.path)
        rows = {"header": self._header, "index": self._index}.get(self.part, self._body)
        for piece in partition.ranges:
            try:
                yield from rows(fs, piece)
            except (ValueError, OSError, struct.error):
                if not self.tolerant:
                    raise

    def _header(self, fs, p):
        with fs.open_input_file(p.stem + ".bin") as f:
            raw = f.read(HEADER_BYTES)
        if len(raw) == HEADER_BYTES:
            magic, version, n, length, _ = struct.unpack(HEADER, raw)
        else:
            magic, version, n, length = raw[:8], None, None, None
        yield (
            p.shard_id, _base(p.stem), p.size, len(raw), magic == self.magic,
            version, _signed(n), _signed(length),
        )

    def _index(self, fs, p):
        with fs.open_input_file(p.stem + ".idx") as f:
            n, seq_length = struct.unpack(INDEX_HEAD, f.read(INDEX_HEAD_BYTES))
            first = 0
            while raw := f.read(BATCH_BYTES // INDEX_ENTRY_BYTES * INDEX_ENTRY_BYTES):
                whole = len(raw) // INDEX_ENTRY_BYTES
                entries = np.frombuffer(raw, INDEX_ENTRY, count=whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(whole, p.shard_id, "int32")),
                        pa.array([_base(p.stem)] * whole, pa.string()),
                        pa.array(np.full(whole, n, "int64")),
                        pa.array(np.full(whole, seq_length, "int64")),
                        pa.array(np.arange(first, first + whole, dtype="int64")),
                        pa.array(entries["offset"].astype("int64")),
                        pa.array(entries["length"].astype("int64")),
                    ],
                    ["shard_id", "shard", "index_n", "index_seq_length", "seq_in_shard", "offset", "length"],
                )
                first += whole

    def _body(self, fs, p):
        with fs.open_input_file(p.stem + ".bin") as f:
            raw = f.read(HEADER_BYTES)
            if len(raw) < HEADER_BYTES:
                raise ValueError(f"{p.stem}.bin is shorter than its header")
            magic, _version, n, length, _pad = struct.unpack(HEADER, raw)
            if magic != self.magic:
                raise ValueError(f"bad magic in {p.stem}.bin: {magic!r}")
            if 4 * n * length != p.size - HEADER_BYTES or (n and not length):
                raise ValueError(f"{p.stem}.bin does not have the size its header gives")
            first, last = n * p.part // p.parts, n * (p.part + 1) // p.parts
            with fs.open_input_file(p.stem + ".idx") as g:
                g.seek(INDEX_HEAD_BYTES + INDEX_ENTRY_BYTES * first)
                raw = g.read(INDEX_ENTRY_BYTES * (last - first))
            if len(raw) < INDEX_ENTRY_BYTES * (last - first):
                raise ValueError(f"{p.stem}.idx has fewer entries than the header says")
            offsets = np.frombuffer(raw, INDEX_ENTRY)["offset"].astype("int64")
            step = max(1, BATCH_BYTES // (4 * length)) if length else 1
            for at in range(first, last, step):
                end = min(at + step, last)
                ids = _ids(f, offsets[at - first : end - first], length, p.stem)
                ids = ids.astype("int64") if self.wide else ids.view("int32")
                count = end - at
                starts = pa.array(np.arange(count + 1, dtype="int32") * np.int32(length))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, p.shard_id, "int32")),
                        pa.array([_base(p.stem)] * count, pa.string()),
                        pa.array(np.arange(at, end, dtype="int64")),
                        pa.ListArray.from_arrays(starts, pa.array(ids)),
                    ],
                    ["shard_id", "shard", "seq_in_shard", "tokens"],
                )


def _ids(f, offsets, length, stem):
    """The sequences at the given offsets, one read if they lie side by side."""
    stride = 4 * length
    if len(offsets) and np.all(np.diff(offsets) == stride):
        f.seek(int(offsets[0]))
        raw = f.read(stride * len(offsets))
    else:
        pieces = []
        for offset in offsets:
            f.seek(int(offset))
            pieces.append(f.read(stride))
        raw = b"".join(pieces)
    if len(raw) != stride * len(offsets):
        raise ValueError(f"{stem}.bin ends inside a sequence")
    return np.frombuffer(raw, "<u4")


def _base(stem):
    return stem.rsplit("/", 1)[-1]


def _signed(value):
    """uint64 as a bigint; a damaged header may hold any value."""
    return None if value is None else min(value, (1 << 63) - 1)


@dataclass
class ShardsWritten(WriterCommitMessage):
    names: list


class TokshardWriter(DataSourceArrowWriter):
    """Writes one file triple per shard id found in a task.

    Rows ``(shard_id, seq_in_shard, tokens, num_sequences)`` arrive with all rows
    of a shard together and in order (``write_shards`` sees to it), or, as pieces of any
    length, ``(shard_id, first, tokens, num_sequences, seq_length)`` with the piece's place in the
    shard's ids.  The number of
    sequences comes with the rows, so a shard is streamed to its file without
    being held or revisited; of pieces, the last sequence is filled up with option ``pad``.  Files are written under a job folder and attempt
    name and moved in ``commit``; failed and repeated attempts leave nothing.
    """

    def __init__(self, options, schema, overwrite):
        self.path = options["path"]
        self.prefix = options.get("prefix", PREFIX)
        self.magic = magic_bytes(options)
        self.digits = int(options.get("digits", DIGITS))
        self.overwrite = overwrite
        self.generations = options.get("generations", "false").lower() == "true"
        self.first = 0
        if self.generations:
            self.first, width = self._next_number()
            self.digits = width or max(self.digits, GENERATION_DIGITS)
        self.names = schema.names
        self.pad = int(options.get("pad", 0))
        self.pieces = "first" in self.names
        place = {"first", "seq_length"} if self.pieces else {"seq_in_shard"}
        missing = {"shard_id", "tokens", "num_sequences", *place} - set(self.names)
        if missing:
            raise ValueError(f"columns missing for tokshard: {sorted(missing)}")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, root = open_fs(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        written = []
        shard = None
        for batch in iterator:
            ids = batch.column(self.names.index("shard_id")).to_numpy(zero_copy_only=False)
            borders = np.flatnonzero(np.diff(ids)) + 1
            for rows in np.split(np.arange(len(ids)), borders):
                if not len(rows):
                    continue
                part = batch.slice(int(rows[0]), len(rows))
                if shard is None or shard.shard_id != int(ids[rows[0]]):
                    if shard is not None:
                        shard.close()
                    kind = _PiecesFile if self.pieces else _ShardFile
                    shard = kind(self, fs, folder, int(ids[rows[0]]), part)
                    written.append((shard.name, folder))
                shard.add(part)
        if shard is not None:
            shard.close()
        return ShardsWritten(written)

    def commit(self, messages):
        fs, root = open_fs(self.path)
        written = sorted(x for m in messages if m is not None for x in m.names)
        names = [n for n, _ in written]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("a shard was written by more than one task")
        if self.generations:
            return self._commit_generation(fs, root, written)
        old = [p[: -len(".bin")] for p, _ in _shard_files(fs, root, self.prefix)]
        if not self.overwrite:
            clash = {_base(stem) for stem in old} & set(names)
            if clash:
                self.abort(messages)
                raise FileExistsError(f"shards exist already: {sorted(clash)[:5]}")
        else:
            _delete_shards(fs, old)
        self._publish(fs, root, written)
        self._drop_staging(fs, root)

    def _publish(self, fs, root, written):
        def move(entry):
            name, folder = entry
            for suffix in SUFFIXES:
                fs.move(f"{folder}/{name}{suffix}", f"{root}/{name}{suffix}")

        with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
            list(pool.map(move, written))

    def _commit_generation(self, fs, root, written):
        """Adds the shards under new names, then names the new generation, then drops what it replaces."""
        number, listed = latest_generation(fs, root, self.prefix)
        old = sorted(_base(p[: -len(".bin")]) for p, _ in _shard_files(fs, root, self.prefix)) if listed is None else listed
        kept = [] if self.overwrite else old
        names = [*kept, *[n for n, _ in written]]
        if names != sorted(names):
            self._drop_staging(fs, root)
            raise ValueError(f"names with {self.digits} digits are used up; the new shards would not sort behind the old")
        self._publish(fs, root, written)
        fs.create_dir(f"{root}/{GENERATIONS}", recursive=True)
        draft = f"{root}/{GENERATIONS}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"shards": names}).encode())
        fs.move(draft, _generation_file(root, self.prefix, number + 1))
        if self.overwrite:
            _delete_shards(fs, [f"{root}/{name}" for name in old])
        self._drop_staging(fs, root)

    def _next_number(self):
        """One past the numbers of all shards of the folder, those of jobs that died included, and how long they are written."""
        fs, root = open_fs(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        names = [i.base_name for i in infos] + (latest_generation(fs, root, self.prefix)[1] or [])
        taken = [m[1] for n in names if (m := re.match(rf"{re.escape(self.prefix)}_(\d+)", n))]
        return max(map(int, taken), default=-1) + 1, max(map(len, taken), default=0)

    def abort(self, messages):
        fs, root = open_fs(self.path)
        self._drop_staging(fs, root)

    def _drop_staging(self, fs, root):
        staging = f"{root}/{self.staging}"
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class _ShardFile:
    """One open shard: ids go to the file as they come."""

    def __init__(self, writer, fs, folder, shard_id, first_rows):
        column = lambda rows, name: rows.column(writer.names.index(name))
        self._column = column
        self.shard_id = shard_id
        self.name = f"{writer.prefix}_{writer.first + shard_id:0{writer.digits}d}"
        self.fs, self.stem = fs, f"{folder}/{self.name}"
        self.expected = column(first_rows, "num_sequences")[0].as_py()
        self.length = self._length(first_rows)
        self.rows = 0
        self.body = fs.open_output_stream(self.stem + ".bin")
        self.body.write(struct.pack(HEADER, writer.magic, VERSION, self.expected, self.length, 0))

    def _length(self, rows):
        return len(self._column(rows, "tokens")[0])

    def add(self, rows):
        lists = self._column(rows, "tokens")
        places = self._column(rows, "seq_in_shard").to_numpy(zero_copy_only=False)
        if not np.array_equal(places, np.arange(self.rows, self.rows + len(places))):
            raise ValueError(f"{self.name}: sequences are not in order, or one is missing")
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        if not np.all(lengths == self.length):
            raise ValueError(f"{self.name}: sequences differ in length")
        self._write(ids)
        self.rows += len(places)

    def _write(self, ids):
        if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFFFFFF):
            raise ValueError(f"{self.name}: id outside uint32")
        self.body.write(ids.astype("<u4").tobytes())

    def close(self):
        self.body.close()
        if self.rows != self.expected:
            raise ValueError(f"{self.name}: {self.rows} sequences, {self.expected} announced")
        entries = np.empty(self.rows, INDEX_ENTRY)
        entries["offset"] = HEADER_BYTES + 4 * self.length * np.arange(self.rows, dtype="u8")
        entries["length"] = self.length
        with self.fs.open_output_stream(self.stem + ".idx") as f:
            f.write(struct.pack(INDEX_HEAD, self.rows, self.length))
            f.write(entries.tobytes())
        meta = {"num_sequences": self.rows, "seq_length": self.length, "source": self.name}
        with self.fs.open_output_stream(self.stem + ".meta") as f:
            f.write(json.dumps(meta).encode())


class _PiecesFile(_ShardFile):
    """A shard whose ids come in pieces that follow each other, whatever sequences they are part of."""

    def __init__(self, *given):
        super().__init__(*given)
        self.ids = 0
        self.pad = given[0].pad

    def _length(self, rows):
        return self._column(rows, "seq_length")[0].as_py()

    def add(self, rows):
        lists = self._column(rows, "tokens")
        places = self._column(rows, "first").to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        if not np.array_equal(places, self.ids + np.cumsum(lengths) - lengths):
            raise ValueError(f"{self.name}: pieces are not in order, or one is missing")
        self._write(lists.flatten().to_numpy(zero_copy_only=False))
        self.ids += int(lengths.sum())

    def close(self):
        missing = self.expected * self.length - self.ids
        if 0 <= missing < self.length:
            self._write(np.full(missing, self.pad, np.int64))
            self.rows = self.expected
        super().close()
