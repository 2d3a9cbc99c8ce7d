"""Token counts, id archives and packing against the tokenizers library and plain versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.byte_ids import byte_ids
from millrace.llm.common import NOT_PLAIN
from millrace.llm.hashtable import HashTable
from millrace.llm.id_archive import read_document, read_id_archive, write_id_archive
from millrace.llm.packing import Report, _deal, best_fit_decreasing, lower_bound, pack, pieces
from millrace.llm.token_counts import counter, token_counts
from millrace.session import materialize, scratch_path

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
PLAIN_BITS = ["'s", "'", "'re", " ", "  ", "\n", "\t", " '", "''", "l", "ll", "é", "×", "²", "7", "!", "a", "Z", "“", "ß"]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PLAIN_BITS), max_size=40).map("".join)))
def test_any_text_as_the_library(libraries, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter(WORDS).counts([text]) == [len(ids_of(libraries[0], text))]
    assert np.frombuffer(byte_ids(BYTES).encode([text])[0], "<u4").tolist() == ids_of(libraries[1], text)


def test_plain_characters_are_classed_as_the_library_does(libraries):
    plain = [c for c in map(chr, range(0x3000)) if not NOT_PLAIN.search(c)]
    normalizer = libraries[0].normalizer
    assert all(normalizer.normalize_str(c) == c.lower() for c in plain if c.strip())
    around = [f"a{c}1{c}!{c} {c}\n" for c in plain]
    assert [np.frombuffer(b, "<u4").tolist() for b in byte_ids(BYTES).encode(around)] == [ids_of(libraries[1], t) for t in around]
    assert counter(WORDS).counts(around) == [len(ids_of(libraries[0], t)) for t in around]


def test_ids_survive_a_full_memory(libraries, monkeypatch):
    from millrace.llm import byte_ids as module

    monkeypatch.setattr(module, "REMEMBERED", 50)
    own = module.ByteIds(BYTES)
    texts = [" ".join(f"w{k}x{j}" for j in range(10)) for k in range(20)]
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == ids_of(libraries[1], text)


def test_hash_table_against_a_dict():
    random_ = np.random.Generator(np.random.PCG64(1))
    table, plain = HashTable(5000), {}
    for _ in range(20):
        keys = np.unique(random_.integers(0, 9000, 300).astype(np.uint64))
        found = table.find(keys)
        assert [plain.get(k, -1) for k in keys.tolist()] == found.tolist()
        new = keys[found < 0]
        for key, number in zip(new.tolist(), table.insert(new).tolist(), strict=True):
            plain[key] = number


def test_token_counts(odd_docs, libraries):
    got = Counter(tuple(r) for r in token_counts(odd_docs, WORDS, limit=3).collect())
    want = Counter()
    for row in odd_docs.select("doc_id", "text").collect():
        text = row["text"] or ""
        n = len(ids_of(libraries[0], text))
        want[row["doc_id"], len(text.encode()), n, n > 3] += 1
    assert got == want


def test_empty_tables(no_docs, spark):
    assert token_counts(no_docs, WORDS).count() == 0
    folder = scratch_path(spark, "ids")
    write_id_archive(no_docs, folder, BYTES)
    assert read_id_archive(spark, folder).count() == 0
    assert pack(materialize(pieces(no_docs, BYTES), "pieces")).count() == 0


def test_id_archive_round_trip(spark, odd_docs, libraries):
    folder = scratch_path(spark, "ids")
    write_id_archive(odd_docs, folder, BYTES, end_id=0, parts=3)
    got = read_id_archive(spark, folder, with_ids=True).orderBy("start").collect()
    rows = odd_docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start = 0
    for have, row in zip(got, rows, strict=True):
        ids = np.array([*ids_of(libraries[1], row["text"] or ""), 0], "<u4")
        raw = ids.tobytes()
        assert tuple(have)[:4] == (row["doc_id"], start, len(ids), zlib.crc32(raw)) and bytes(have["ids"]) == raw
        start += len(ids)


def test_one_document_is_read_alone(spark, docs_of, libraries):
    texts = [f"the {k} of {k * 7} and then some more words {k}" for k in range(400)]
    folder = scratch_path(spark, "ids")
    write_id_archive(docs_of(enumerate(texts)), folder, BYTES, end_id=0, parts=2)
    parts = spark.read.parquet(f"{folder}/parts").orderBy("part").collect()
    assert sum(p["n_docs"] for p in parts) == 400
    first = parts[0]
    assert read_document(folder, first["name"], 5).tolist() == [*ids_of(libraries[1], texts[5]), 0]


def test_rows_without_id_and_with_equal_text_are_dealt_to_several_parts(spark, docs_of, libraries):
    rows = [(None, "one text that many rows share")] * 3000 + [(k, f"text {k}") for k in range(3000)] + [(-5, "low")]
    docs = materialize(docs_of(rows).repartition(6), "docs")
    folder = scratch_path(spark, "ids")
    write_id_archive(docs, folder, BYTES, end_id=0, parts=6)
    sizes = sorted(p["n_docs"] for p in spark.read.parquet(f"{folder}/parts").collect())
    assert len(sizes) == 6 and sizes[-1] < 2 * sizes[3]
    got = [r["doc_id"] for r in read_id_archive(spark, folder).orderBy("start").collect()]
    assert got == [None] * 3000 + [-5, *range(3000)]


def test_a_document_outside_its_part(spark, docs_of):
    folder = scratch_path(spark, "ids")
    write_id_archive(docs_of([(1, "a"), (2, "b")]), folder, BYTES, parts=1)
    name = spark.read.parquet(f"{folder}/parts").first()["name"]
    with pytest.raises(IndexError):
        read_document(folder, name, 2)


def test_equal_pieces_are_dealt_to_several_groups(spark):
    rows = [(None, 0, 0, 7, 1)] * 4000 + [(k, 0, 0, 7, k) for k in range(2000)]
    cut = materialize(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "cut")
    sizes = sorted(r["count"] for r in _deal(cut, 6, 0).groupBy("_group").count().collect())
    assert len(sizes) == 6 and sizes[-1] < 2 * sizes[3]
    placed = pack(cut, capacity=20, group_pieces=1000)
    assert placed.count() == 6000 and placed.groupBy("sequence_id").agg(F.sum("length").alias("f")).filter("f > 20").count() == 0


def test_pieces_and_sequences(odd_docs, libraries):
    cut = materialize(pieces(odd_docs, BYTES, capacity=16), "pieces")
    placed = pack(cut, capacity=16, group_pieces=500).collect()
    assert len(placed) == cut.count()
    by_sequence = defaultdict(list)
    for p in placed:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 16
    by_doc = defaultdict(list)
    for p in placed:
        by_doc[p["doc_id"]].append((p["piece"], p["start"], p["length"], p["ids_crc32"]))
    want = defaultdict(list)
    for row in odd_docs.select("doc_id", "text").collect():
        ids = np.array([*ids_of(libraries[1], row["text"] or ""), 2], "<u4")
        edges = [0, *range(len(ids) % 16 or 16, len(ids) + 1, 16)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[row["doc_id"]].append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def fewest(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1:]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_best_fit_and_bounds():
    random_ = random.Random(2)
    for _ in range(200):
        lengths = [random_.randint(1, 20) for _ in range(random_.randint(1, 9))]
        bins, offsets, n = best_fit_decreasing(np.array(lengths), 20)
        assert n == plain_best_fit(lengths, 20) and n == bins.max() + 1
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 20 and all(o + length <= 20 for o, length in zip(offsets, lengths, strict=True))
        assert lower_bound(np.array(lengths), 20) <= fewest(lengths, 20)


def test_groups_with_a_gap_exchange(spark):
    random_ = random.Random(3)
    rows = [(k, 0, 0, random_.choice([6, 7, 8]), k) for k in range(3000)]
    cut = materialize(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "cut")
    report = Report([])
    placed = pack(cut, capacity=20, group_pieces=200, report=report)
    used = placed.select("sequence_id").distinct().count()
    assert placed.count() == 3000 and len(report.rounds) > 1
    assert used <= report.rounds[0]["used"]
    fills = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    assert fills.filter("fill > 20").count() == 0
