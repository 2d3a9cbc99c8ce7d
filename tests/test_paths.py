from __future__ import annotations

import os

import pytest

from millrace.sources.manifest import list_files
from millrace.sources.paths import arrow_uri, open_fs, qualified, shared


@pytest.mark.parametrize(("path", "uri"), [
    ("/a/b", "/a/b"), ("a/b:c", "a/b:c"), ("file:/a/b", "file:///a/b"), ("file:///a/b", "file:///a/b"),
    ("s3a://bucket/a", "s3://bucket/a"), ("s3n://bucket/a", "s3://bucket/a"), ("hdfs://host:9000/a", "hdfs://host:9000/a"),
])
def test_uris(path, uri):
    assert arrow_uri(path) == uri


def test_paths_without_a_scheme_get_the_sessions(spark):
    assert qualified(spark, "/a/b") == "file:/a/b"
    assert qualified(spark, "file:///a/b") == "file:/a/b"
    assert qualified(spark, "a/b").endswith("/a/b") and qualified(spark, "a/b").startswith("file:/")
    assert open_fs("file:/a/b")[1] == open_fs("/a/b")[1] == "/a/b"


def test_local_paths_are_refused_on_a_cluster(spark, monkeypatch):
    assert shared(spark, "/a") == "file:/a"

    class Conf:
        def get(self, key, default=None):
            return "yarn"

    class Session:
        conf, _jvm, _jsc = Conf(), spark._jvm, spark._jsc

    with pytest.raises(ValueError, match="local to each machine"):
        shared(Session(), "/a")
    assert shared(Session(), "file:///shared/a") == "file:/shared/a"


def test_the_checkpoint_folder_is_shared_however_it_is_written(spark):
    class Conf:
        def __init__(self, root):
            self.found = {"spark.master": "spark://host:7077", "spark.checkpoint.dir": root}

        def get(self, key, default=None):
            return self.found.get(key, default)

    class Session:
        _jvm, _jsc = spark._jvm, spark._jsc

        def __init__(self, root):
            self.conf = Conf(root)

    for root in ("/mnt/cp", "/mnt/cp/", "file:/mnt/cp", "file:///mnt/cp"):
        assert shared(Session(root), "/mnt/cp/millrace/shards") == "file:/mnt/cp/millrace/shards"
    for root, path in (("/mnt/cp", "/mnt/cpx/a"), ("/mnt/cp", "/mnt/a"), (None, "/mnt/cp/a"), ("file:/other", "/mnt/cp/a")):
        with pytest.raises(ValueError, match="local to each machine"):
            shared(Session(root), path)


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}", "relative", "{}/"])
def test_listing_is_relative_to_the_root_in_any_form(spark, tmp_path, form):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "f.txt").write_text("abc")
    root = os.path.relpath(tmp_path / "x") if form == "relative" else form.format(tmp_path / "x")
    assert [tuple(r) for r in list_files(spark, root).collect()] == [("y/f.txt", 3)]
