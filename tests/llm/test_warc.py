"""WARC writing, normalising and reading, against plain copies of the records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.warc import (
    GZIP, inflated, normalise, parse_head, read_records, record_bytes, split_records, with_revisits, write_monolithic,
)
from millrace.session import materialize, scratch_path
from millrace.sources.paths import open_fs

PAGES = "page_id long, url string, payload binary, refers_to string"


def round_trip(spark, rows, min_bytes=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    marked = with_revisits(pages, F.col("page_id"), F.col("payload"), min_bytes)
    crawl = materialize(write_monolithic(marked, scratch_path(spark, "crawl")), "crawl")
    index = materialize(normalise(crawl, scratch_path(spark, "warc")), "index")
    return crawl, index, read_records(index).collect()


def expected(rows, min_bytes=0):
    last = {}
    for page, _, payload in rows:
        if page is not None and len(payload) >= min_bytes:
            last[payload] = max(last.get(payload, page), page)
    out = []
    for page, _, payload in rows:
        keeper = last.get(payload) if len(payload) >= min_bytes else None
        refers = keeper if keeper is not None and keeper != page else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def facts(records):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records), key=repr)


ROWS = [
    (1, "http://a/", b""), (2, None, b""), (3, "http://b/ c\r\nd", b"<p>\r\n\r\nWARC/1.1\r\n\r\n</p>"), (4, "x", b"same"),
    (9, "y", b"same"), (9, "y", b"same"), (5, "z", b"same"), (None, "n", b"same"), (None, "m", b"alone"),
    (7, "big", bytes(random.Random(1).randbytes(3 << 20))), (8, "é", "é漢".encode()),
]


@pytest.mark.parametrize("min_bytes", [0, 1, 5])
def test_round_trip(spark, min_bytes):
    _, index, records = round_trip(spark, ROWS, min_bytes)
    assert facts(records) == expected(ROWS, min_bytes)
    assert index.select("archive", "offset").distinct().count() == len(ROWS)


def test_every_record_is_a_member_and_the_sidecar_finds_it(spark):
    crawl, index, _ = round_trip(spark, ROWS)
    whole = b""
    for (path,) in crawl.select("archive").collect():
        system, place = open_fs(path)
        with system.open_input_stream(place, compression=None) as f:
            whole += gzip.decompress(f.read())
    for (path,) in index.select("archive").distinct().collect():
        system, place = open_fs(path)
        with system.open_input_stream(place, compression=None) as f:
            data = f.read()
        with system.open_input_stream(f"{place}.idx", compression=None) as f:
            lines = [line.split("\t") for line in f.read().decode().splitlines()]
        for offset, size, kind, record_id in lines:
            record = gzip.decompress(data[int(offset):int(offset) + int(size)])
            fields = parse_head(record.partition(b"\r\n\r\n")[0])
            assert (fields["warc-type"], fields["warc-record-id"]) == (kind, record_id)
            assert record in whole
        assert sum(int(size) for _, size, _, _ in lines) == len(data)


def test_empty_table(spark):
    assert round_trip(spark, [])[2] == []


def test_streams_of_many_members_and_chunk_borders():
    records = [record_bytes(k, None, bytes([k]) * k * 5000, None) for k in range(1, 120)]
    one, many = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    for data in (one, many):
        found = list(split_records(inflated(io.BytesIO(data))))
        assert [r for _, r in found] == records
        assert [f["warc-record-id"] for f, _ in found] == [f"<urn:page:{k}>" for k in range(1, 120)]
    assert GZIP == 31


@pytest.mark.parametrize("cut", [10, 300, -1])
def test_a_cut_stream_is_an_error(cut):
    data = gzip.compress(b"".join(record_bytes(k, None, bytes(5000), None) for k in range(20)))
    with pytest.raises(ValueError):
        list(split_records(inflated(io.BytesIO(data[:cut]))))
