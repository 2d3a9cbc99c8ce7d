"""WARC archives: writing, and turning whole-file gzip streams into archives with one member per record.

``write_monolithic`` writes each partition of records as one gzip stream, the
form some crawlers leave behind, in which no record can be reached without
inflating all before it.  ``normalise`` inflates each such file once, from
front to back and in bounded memory but for the record at hand, writes every
record as a gzip member of its own and a sidecar index beside it.
``read_records`` reads records back through that index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.paths import open_fs, shared

CHUNK = 1 << 20
LEVEL = 6
GZIP = 31  # zlib's window bits for a gzip wrapper
EPOCH = "1970-01-01T00:00:00Z"

# Names the WARC format prescribes.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGE_URN = "urn:page:"
ARCHIVES = "archive string, n_records long"
INDEX = "archive string, record long, offset long, size long, record_id string, record_type string"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, archive string, offset long, size long"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, key: Column, payload: Column, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: for a payload that a larger key has as well, the largest key that has it.

    Payloads below ``min_bytes`` and rows whose key is the largest get null, and
    so do all rows that repeat the largest key.  A null key counts as smaller
    than any other; where all keys of a payload are null, none is a revisit.
    Only keys and digests are grouped; payloads move once, by key and digest.
    """
    marked = pages.withColumns({"_key": key, "_digest": F.sha1(payload)})
    narrow = marked.filter(F.octet_length(payload) >= min_bytes).select("_key", "_digest")
    keepers = narrow.groupBy("_digest").agg(F.max("_key").alias("_last"), F.count("*").alias("_n"))
    keepers = keepers.filter((F.col("_n") > 1) & F.col("_last").isNotNull()).drop("_n")
    revisits = narrow.join(keepers, "_digest").filter(~F.col("_key").eqNullSafe(F.col("_last"))).distinct()
    right = revisits.select(
        F.col("_key").alias("_rkey"), F.col("_digest").alias("_rdigest"), F.col("_last").alias("refers_to")
    )
    same = F.col("_key").eqNullSafe(F.col("_rkey")) & (F.col("_digest") == F.col("_rdigest"))
    return marked.join(right, same, "left").drop("_key", "_digest", "_rkey", "_rdigest")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record: a response, or a revisit without the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {plain}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PAGE_URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _create(spark: SparkSession, folder: str) -> str:
    folder = shared(spark, folder)
    system, root = open_fs(folder)
    system.create_dir(root, recursive=True)
    return folder


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``(page_id, url, payload binary, refers_to)`` as one gzip stream per partition.

    The rows of the returned table name the archives of the attempts that
    counted; store it before use, for running it again writes again.
    """
    folder = _create(rows.sparkSession, folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        name, out, n = f"crawl-{uuid.uuid4().hex}.warc.gz", None, 0
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    out = out or system.open_output_stream(f"{root}/{name}", compression=None)
                    row = {c: batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "refers_to")}
                    out.write(packer.compress(record_bytes(**row)))
                    n += 1
            if out is not None:
                out.write(packer.flush())
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, ARCHIVES)


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, chunk by chunk, over any number of members."""
    unpacker, fed = zlib.decompressobj(GZIP), False
    while raw := stream.read(CHUNK):
        while raw:
            data = unpacker.decompress(raw, CHUNK)
            fed = True
            if data:
                yield data
            raw = unpacker.unconsumed_tail
            if unpacker.eof:
                raw = unpacker.unused_data
                unpacker, fed = zlib.decompressobj(GZIP), False
            elif not raw:
                while data := unpacker.decompress(b"", CHUNK):
                    yield data
    if fed and not unpacker.eof:
        raise ValueError("the gzip stream ends early")


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a continued line belongs to the field before it."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    pairs = (line.partition(b":") for line in lines[1:] if line)
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


def split_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and all bytes of each record of an inflated stream."""
    buffer, at, more = bytearray(), 0, iter(chunks)
    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0 and (chunk := next(more, None)) is not None:
            del buffer[:at]
            at = 0
            buffer += chunk
        if end < 0:
            if bytes(buffer[at:]).strip():
                raise ValueError("the last record has no end of its head")
            return
        fields = parse_head(bytes(buffer[at:end]))
        stop = end + 4 + int(fields["content-length"]) + 4
        parts, held = [], len(buffer) - at
        if held < stop - at:
            parts, need = [bytes(buffer[at:])], stop - at - held
            buffer, at = bytearray(), 0
            while need > 0 and (chunk := next(more, None)) is not None:
                parts.append(chunk[:need])
                buffer += chunk[need:]
                need -= len(parts[-1])
            if need > 0:
                raise ValueError("the last record is cut off")
            yield fields, b"".join(parts)
        else:
            yield fields, bytes(buffer[at:stop])
            at = stop


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each file of ``archives`` with one member per record, with its index beside it.

    The sidecar ``<name>.idx`` has a line per record: offset, size, type and id, tab-separated.
    The returned table has the same entries; store it before use.  An archive that is
    no gzip file of records, or ends early, fails the job.
    """
    folder = _create(archives.sparkSession, folder)
    archives = archives.select("archive").repartition(max(archives.count(), 1))  # a task per file

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                yield _rewrite(path, folder)

    return archives.mapInArrow(rewrite, INDEX)


def _rewrite(path: str, folder: str) -> pa.RecordBatch:
    source, place = open_fs(path)
    target, root = open_fs(folder)
    stem = place.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc")
    name = f"{stem}-{uuid.uuid4().hex}.warc.gz"
    entries, offset = [], 0
    with source.open_input_stream(place, compression=None) as stream, \
            target.open_output_stream(f"{root}/{name}", compression=None) as out:
        for fields, record in split_records(inflated(stream)):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            member = packer.compress(record) + packer.flush()
            out.write(member)
            entries.append((offset, len(member), fields["warc-type"], fields["warc-record-id"]))
            offset += len(member)
    with target.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
        out.write("".join("\t".join(map(str, e)) + "\n" for e in entries).encode())
    offsets, sizes, kinds, ids = zip(*entries, strict=True) if entries else ((), (), (), ())
    return pa.RecordBatch.from_pydict({
        "archive": pa.array([f"{folder}/{name}"] * len(entries), pa.string()),
        "record": pa.array(range(len(entries)), pa.int64()),
        "offset": pa.array(offsets, pa.int64()), "size": pa.array(sizes, pa.int64()),
        "record_id": pa.array(ids, pa.string()), "record_type": pa.array(kinds, pa.string()),
    })


def _page(urn: str | None) -> int | None:
    number = urn.strip("<>").removeprefix(PAGE_URN) if urn else ""
    return int(number) if number else None


def read_records(index: DataFrame) -> DataFrame:
    """Facts of each record, read from its own member; payload digests of responses are checked."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, handle = None, None
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            out = {n: [] for n in names}
            for row in batch.to_pylist():
                if row["archive"] != path:
                    if handle is not None:
                        handle.close()
                    path = row["archive"]
                    system, place = open_fs(path)
                    handle = system.open_input_file(place)
                record = zlib.decompress(handle.read_at(row["size"], row["offset"]), GZIP)
                for name, value in (_facts(record) | {k: row[k] for k in ("archive", "offset", "size")}).items():
                    out[name].append(value)
            types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(),
                     "offset": pa.int64(), "size": pa.int64()}
            yield pa.RecordBatch.from_pydict({n: pa.array(out[n], types.get(n, pa.string())) for n in names})
        if handle is not None:
            handle.close()

    places = index.select("archive", "offset", "size")
    tasks = max(index.select("archive").distinct().count(), 1)
    return places.repartition(tasks, "archive").sortWithinPartitions("archive", "offset").mapInArrow(read, RECORDS)


def _facts(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = body[:int(fields["content-length"])].partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return {
        "page_id": _page(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"),
    }
