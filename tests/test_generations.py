"""Shard folders whose content is what their latest generation lists."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from test_shards import sequences

from millrace.functions.tokenizers import WordTokenizer
from millrace.plans.jobs import build_shards
from millrace.sources import tokshard
from millrace.sources.feed_reader import read_feed
from millrace.sources.shards import read_shards, shard_catalog, validate_shards, write_shards


def add(spark, sizes, path, mode="append"):
    write_shards(sequences(spark, sizes), str(path), len(sizes), 1, mode=mode, generations="true")


def catalog(spark, path):
    return [(r["shard"], r["num_sequences"]) for r in shard_catalog(spark, str(path)).orderBy("shard_id").collect()]


def test_append_takes_the_next_numbers_and_overwrite_replaces(spark, tmp_path):
    add(spark, [3, 2], tmp_path)
    add(spark, [5], tmp_path)
    assert catalog(spark, tmp_path) == [("shard_000000", 3), ("shard_000001", 2), ("shard_000002", 5)]
    assert read_shards(spark, str(tmp_path)).count() == 10
    add(spark, [4], tmp_path, "overwrite")
    assert catalog(spark, tmp_path) == [("shard_000003", 4)]
    assert {p.stem for p in tmp_path.glob("shard_*")} == {"shard_000003"}
    assert validate_shards(spark, str(tmp_path), 100_000).filter("NOT ok").count() == 0
    assert read_feed(spark, str(tmp_path), 1, 1, 2).count() == 4
    add(spark, [1], tmp_path)
    assert catalog(spark, tmp_path) == [("shard_000003", 4), ("shard_000004", 1)]


def test_a_folder_written_before_is_continued(spark, tmp_path):
    write_shards(sequences(spark, [3, 2]), str(tmp_path), 2, 1)
    add(spark, [1], tmp_path)
    assert catalog(spark, tmp_path) == [("shard_000", 3), ("shard_001", 2), ("shard_002", 1)]


def test_names_that_no_longer_sort_are_refused(spark, tmp_path):
    write_shards(sequences(spark, [1]), str(tmp_path), 1, 1, digits="1")
    add(spark, [1] * 9, tmp_path)
    with pytest.raises(Exception, match="used up"):
        add(spark, [1], tmp_path)
    assert len(catalog(spark, tmp_path)) == 10 and not list(tmp_path.glob("_staging*"))


class Killed(Exception):
    pass


class Guard:
    """A file system that dies at the ``left``-th change."""

    def __init__(self, fs, left):
        self.fs, self.left = fs, left

    def __getattr__(self, name):
        real = getattr(self.fs, name)
        if name not in ("move", "delete_file", "delete_dir", "open_output_stream", "create_dir"):
            return real

        def change(*given, **named):
            if self.left == 0:
                raise Killed
            self.left -= 1
            return real(*given, **named)

        return change


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_kill_at_any_point_leaves_a_whole_generation(spark, tmp_path, monkeypatch, overwrite):
    fields = "shard_id int, seq_in_shard long, tokens array<int>, num_sequences long"
    schema = T._parse_datatype_string(fields)
    rows = [(s, i, [s * 100 + i] * 4, 2) for s in range(2) for i in range(2)]
    batch = pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows]) for k, n in enumerate(schema.names)})
    seen = set()
    for left in range(60):
        path = tmp_path / f"kill{left}"
        add(spark, [1], path) if left == 0 else _copy(tmp_path / "kill0-start", path)
        if left == 0:
            _copy(path, tmp_path / "kill0-start")
        writer = tokshard.TokshardWriter({"path": str(path), "generations": "true"}, schema, overwrite)
        message = writer.write(iter([batch]))
        real = tokshard.open_fs
        with monkeypatch.context() as m:
            guard = {}

            def guarded(p, guard=guard, left=left):
                fs, root = real(p)
                guard.setdefault("fs", Guard(fs, left))
                return guard["fs"], root

            m.setattr(tokshard, "open_fs", guarded)
            m.setattr(tokshard, "RENAMES_AT_ONCE", 1)
            try:
                writer.commit([message])
                done = True
            except Killed:
                done = False
        names = [stem.rsplit("/", 1)[1] for _, stem, _ in tokshard.list_shards(str(path), "shard")]
        old, new = ["shard_000000"], ["shard_000001", "shard_000002"]
        whole = new if overwrite else old + new
        assert names in (old, whole) and all((path / f"{n}{s}").exists() for n in names for s in tokshard.SUFFIXES)
        seen.add(tuple(names))
        tokshard.drop_unlisted(str(path))
        assert {p.stem for p in path.glob("shard_*")} == set(names)
        assert tokshard.TokshardWriter({"path": str(path), "generations": "true"}, schema, False).first >= len(names)
        if done:
            assert names == whole
            break
    assert done and len(seen) == 2


def _copy(source, target):
    for p in source.rglob("*"):
        if p.is_file() and not p.name.startswith("."):
            to = target / p.relative_to(source)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())


def test_two_builds_share_a_folder(spark, tmp_path):
    for name, n in (("one", 30), ("two", 20)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "alpha.txt").write_text("".join(f"{name} {i} w\n" for i in range(n)))
        build_shards(spark, str(tmp_path / name), str(tmp_path / "out"), WordTokenizer(), seq_len=16, per_shard=4, generations="true")
    got = catalog(spark, tmp_path / "out")
    assert [n for n, _ in got] == [f"shard_{k:06d}" for k in range(len(got))]
    assert sum(n for _, n in got) == -(-30 * 5 // 16) + -(-20 * 5 // 16)
