from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources.manifest import manifest, shard_triples
from millrace.sources.shards import read_shards, shard_catalog, validate_shards, write_shards
from millrace.sources.tokshard import group_ranges

LENGTH = 16


def sequences(spark, sizes):
    rows = [
        (s, i, [s * 1000 + i * 10 + k for k in range(LENGTH)], n)
        for s, n in enumerate(sizes)
        for i in range(n)
    ]
    schema = "shard_id int, seq_in_shard long, tokens array<int>, num_sequences long"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture
def folder(spark, tmp_path):
    write_shards(sequences(spark, [25, 3, 1]), str(tmp_path), 3, 1)
    return tmp_path


def failures(spark, path, **options):
    rows = validate_shards(spark, str(path), 100_000, **options).filter("NOT ok").collect()
    return {(r["shard"], r["rule"]) for r in rows}


def test_file_layout(folder):
    raw = (folder / "shard_000.bin").read_bytes()
    assert len(raw) == 36 + 4 * 25 * LENGTH
    assert struct.unpack("<8sIQQQ", raw[:36]) == (b"MILLRACE", 1, 25, LENGTH, 0)
    assert np.frombuffer(raw, "<u4", offset=36)[: LENGTH + 1].tolist() == [*range(LENGTH), 10]
    index = (folder / "shard_001.idx").read_bytes()
    assert struct.unpack("<II", index[:8]) == (3, LENGTH)
    assert [struct.unpack_from("<QI", index, 8 + 12 * i) for i in range(3)] == [
        (36 + 4 * LENGTH * i, LENGTH) for i in range(3)
    ]
    assert json.loads((folder / "shard_002.meta").read_text()) == {
        "num_sequences": 1, "seq_length": LENGTH, "source": "shard_002",
    }
    assert sorted(p.suffix for p in folder.iterdir()) == [".bin"] * 3 + [".idx"] * 3 + [".meta"] * 3


@pytest.mark.parametrize("field", [12, 20])  # where the header has the number of sequences and their length
@pytest.mark.parametrize("value", [0, 2**40, 2**61, 2**62, 2**64 - 1])
def test_validation_survives_any_header(spark, folder, field, value):
    path = folder / "shard_001.bin"
    raw = path.read_bytes()
    path.write_bytes(raw[:field] + value.to_bytes(8, "little") + raw[field + 8:])
    (folder / ".shard_001.bin.crc").unlink(missing_ok=True)
    found = failures(spark, folder)
    assert {shard for shard, _ in found} == {"shard_001"}
    assert ("shard_001", "file_size") in found and ("shard_001", "counts_agree") in found


def test_round_trip_in_slices(spark, folder):
    back = read_shards(spark, str(folder), rangeBytes="300", minPartitions="1")
    got = sorted((r["shard_id"], r["seq_in_shard"], list(r["tokens"])) for r in back.collect())
    want = sorted((r[0], r[1], list(r[2])) for r in sequences(spark, [25, 3, 1]).collect())
    assert got == want


def test_large_shards_are_cut_and_small_ones_grouped():
    tasks = group_ranges([(0, "a", 250), (1, "b", 40), (2, "c", 40), (3, "d", 40)], 100, cut=True)
    assert [[(r.shard_id, r.part, r.parts) for r in t.ranges] for t in tasks] == [
        [(0, 0, 3)], [(0, 1, 3)], [(0, 2, 3)], [(1, 0, 1), (2, 0, 1)], [(3, 0, 1)],
    ]


def test_catalog_and_its_errors(spark, folder, tmp_path_factory):
    rows = shard_catalog(spark, str(folder)).orderBy("shard_id").collect()
    assert [(r["shard"], r["num_sequences"]) for r in rows] == [
        ("shard_000", 25), ("shard_001", 3), ("shard_002", 1),
    ]
    (folder / "shard_001.idx").unlink()
    with pytest.raises(FileNotFoundError, match="shard_001"):
        shard_catalog(spark, str(folder))
    empty = tmp_path_factory.mktemp("empty")
    (empty / "note.txt").write_text("x")
    with pytest.raises(FileNotFoundError, match="no shards"):
        shard_catalog(spark, str(empty))


def test_written_shards_are_valid(spark, folder):
    assert failures(spark, folder) == set()


def damage(path: Path, offset: int, raw: bytes):
    with path.open("r+b") as f:
        f.seek(offset)
        f.write(raw)


def test_each_damage_is_named(spark, tmp_path):
    write_shards(sequences(spark, [4] * 9), str(tmp_path), 9, 1)
    at = lambda i, suffix=".bin": tmp_path / f"shard_{i:03d}{suffix}"
    damage(at(0), 0, b"OTHERMAG")
    at(1).write_bytes(at(1).read_bytes()[:32])
    at(2, ".idx").unlink()
    at(3, ".meta").unlink()
    at(4, ".meta").write_text(json.dumps({"num_sequences": 5, "seq_length": LENGTH, "source": "x"}))
    at(5).write_bytes(at(5).read_bytes()[:-8])
    damage(at(6), 36, struct.pack("<I", 2**31 + 7))
    damage(at(7, ".idx"), 8 + 12, struct.pack("<Q", 40))
    got = failures(spark, tmp_path)
    assert got == {
        ("shard_000", "magic"), ("shard_000", "id_range"),
        ("shard_001", "header_size"), ("shard_001", "file_size"), ("shard_001", "index_entries"),
        ("shard_001", "counts_agree"), ("shard_001", "id_range"),
        ("shard_002", "index_present"), ("shard_002", "index_entries"),
        ("shard_002", "counts_agree"), ("shard_002", "id_range"),
        ("shard_003", "meta_present"), ("shard_003", "counts_agree"),
        ("shard_004", "counts_agree"),
        ("shard_005", "file_size"), ("shard_005", "id_range"),
        ("shard_006", "id_range"),
        ("shard_007", "index_entries"),
    }


def test_reading_a_damaged_shard_fails(spark, folder):
    damage(folder / "shard_000.bin", 0, b"OTHERMAG")
    with pytest.raises(Exception, match="bad magic"):
        read_shards(spark, str(folder)).collect()


def test_foreign_magic_and_prefix(spark, tmp_path):
    options = {"magic": "FOREIGN", "prefix": "corpus"}
    write_shards(sequences(spark, [2]), str(tmp_path), 1, 1, **options)
    assert (tmp_path / "corpus_000.bin").read_bytes()[:8] == b"FOREIGN\0"
    assert read_shards(spark, str(tmp_path), **options).count() == 2
    assert failures(spark, tmp_path, **options) == set()


def test_names_have_digits_for_all_shards(spark, tmp_path):
    write_shards(sequences(spark, [1, 1]), str(tmp_path), 1_001, 1)
    assert {p.stem for p in tmp_path.iterdir()} == {"shard_0000", "shard_0001"}


def test_append_refuses_and_overwrite_replaces(spark, folder):
    with pytest.raises(Exception, match="shards exist already"):
        write_shards(sequences(spark, [2]), str(folder), 1, 1)
    assert not list(folder.glob("_staging*"))
    write_shards(sequences(spark, [2]), str(folder), 1, 1, mode="overwrite")
    assert [p.name for p in sorted(folder.iterdir())] == ["shard_000.bin", "shard_000.idx", "shard_000.meta"]


def test_incomplete_shard_is_not_published(spark, tmp_path):
    with pytest.raises(Exception, match="not in order|announced"):
        write_shards(sequences(spark, [5]).filter(F.col("seq_in_shard") != 2), str(tmp_path), 1, 1)
    assert list(tmp_path.iterdir()) == []


def test_manifest_prunes_at_any_depth(spark, tmp_path):
    for name in ["a.bin", "logs/x", "b/c/state/y", "b/locks/z", "b/logs_old/kept", "b/c/logs"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = manifest(spark, str(tmp_path)).collect()
    assert {(r["rel_path"], r["length"]) for r in rows} == {
        ("a.bin", 5), ("b/logs_old/kept", 15), ("b/c/logs", 8),
    }


def test_triples(spark):
    names = ["shard_1.bin", "shard_1.idx", "shard_1.meta", "x/shard_2.bin", "shard_3.idx", "other_4.bin"]
    rows = shard_triples(spark.createDataFrame([(n,) for n in names], "rel_path string")).collect()
    assert {tuple(r) for r in rows} == {("shard_1", True, True), ("x/shard_2", False, False)}
