"""Reading by file ranges, and what broken files and records do to a collecting job."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions.tokenizers import WordTokenizer
from millrace.operators.ledger import load_ledger, read_ledger
from millrace.plans.jobs import collect, read_until_full
from millrace.plans.mixture import Domain, mixture_plan
from millrace.sources.corpora import Corpus, read_line_docs
from millrace.sources.file_index import file_index

WORDS = WordTokenizer()


def rows_between(a, b):
    return [(k, f"document number {k} " + "word " * 60) for k in range(a, b)]


@pytest.fixture
def folder(spark, tmp_path):
    """Ten files of ten documents each, and their paths in order."""
    where = tmp_path / "web x" / "data"
    for k in range(10):
        one = spark.createDataFrame(rows_between(10 * k, 10 * k + 10), "doc_seq long, text string").coalesce(1)
        one.write.mode("append").parquet(str(where))
    names = {}
    for path in where.glob("*.parquet"):
        names[spark.read.parquet(str(path)).agg(F.min("doc_seq")).first()[0]] = path
    return where, [names[k] for k in sorted(names)]


def damage(path: Path, at: int, n: int):
    raw = bytearray(path.read_bytes())
    raw[at:at + n] = bytes(n)
    path.write_bytes(raw)
    checksum = path.with_name(f".{path.name}.crc")
    checksum.unlink(missing_ok=True)


def places(spark, out):
    texts = [r["text"] for r in read_line_docs(spark, out).collect()]
    return sorted(int(t.split()[2]) for t in texts)


def test_files_behind_the_cut_are_not_opened(spark, folder):
    where, paths = folder
    index = file_index(spark, Corpus("web", [str(where.parent.parent / "none"), str(where)]))
    assert index.n_files == 10 and index.faults == [] and index.bounds(-1) == (0, 99) and index.bounds(42) == (43, 99)
    for path in paths[4:]:
        damage(path, 0, 200)  # reading any of them fails
    plan = mixture_plan(spark, [Domain("web", 1_000)]).withColumn("batch", F.lit(2))
    state = load_ledger(plan, read_ledger(spark, "/nowhere"))
    faults = []
    docs = read_until_full(None, plan, state, WORDS, width=5, files=index, faults=faults)
    assert 0 < docs.count() <= 40 and faults == []
    assert [r["doc_seq"] for r in index.read(13, 16).orderBy("doc_seq").collect()] == [13, 14, 15]
    assert index.read(100, 200).count() == 0


@pytest.mark.parametrize("dedup", [None, "domain"])
def test_broken_files_are_named_and_the_others_read(spark, folder, tmp_path, dedup):
    where, paths = folder
    paths[2].write_bytes(b"PAR1 not a footer")
    paths[2].with_name(f".{paths[2].name}.crc").unlink(missing_ok=True)
    damage(paths[5], 4, 200)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    status = collect(
        spark, [Domain("web", 10**6)], [Corpus("web", [str(where)])], WORDS, out, ledger, slice_width=25, dedup=dedup, skip_broken=True
    ).collect()
    broken = {r["error"].split(": ")[0].rsplit("/", 1)[1]: r["error"] for r in status if r["status"] == "broken_file"}
    assert set(broken) == {paths[2].name, paths[5].name} and "(10 documents lost)" in broken[paths[5].name]
    assert [r["status"] for r in status if r["status"] != "broken_file"] == ["ok"]
    assert places(spark, out) == [k for k in range(100) if k // 10 not in (2, 5)]
    if dedup is None:
        assert read_ledger(spark, ledger).first()["docs_skipped"] == 10


def test_lost_documents_are_counted_once(spark, folder, tmp_path):
    where, paths = folder
    damage(paths[1], 4, 200)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    corpus = Corpus("web", [str(where)])
    for quota in (1_000, 2_000, 10**6):
        collect(spark, [Domain("web", quota)], [corpus], WORDS, out, ledger, slice_width=7, skip_broken=True)
    assert places(spark, out) == [k for k in range(100) if k // 10 != 1]
    assert read_ledger(spark, ledger).agg(F.sum("docs_skipped")).first()[0] == 10


def test_bad_records_are_counted(spark, tmp_path):
    good = [f'{{"doc_seq": {k}, "text": "document number {k} {"word " * 60}"}}' for k in range(20)]
    lines = [*good[:7], '{"doc_seq": 3, "text": broken', "", "nonsense", '{"text": "no place"}', *good[7:]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    corpus = Corpus("web", [str(tmp_path / "in")], format="json", schema="doc_seq long, text string")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    status = collect(spark, [Domain("web", 500)], [corpus], WORDS, out, ledger, slice_width=4).collect()
    assert [(r["status"], r["error"]) for r in status] == [("bad_records", "3 records without a place in the order"), ("ok", None)]
    collect(spark, [Domain("web", 10**6)], [corpus], WORDS, out, ledger, slice_width=4)
    assert places(spark, out) == list(range(20))
    assert read_ledger(spark, ledger).agg(F.sum("docs_skipped")).first()[0] == 3


def test_no_index_where_there_is_nothing_to_index(spark, folder, tmp_path):
    where, _ = folder
    assert file_index(spark, Corpus("web", [str(where)], seq="doc_seq + 1")) is None
    assert file_index(spark, Corpus("web", [str(where)], seq="text")) is None
    assert file_index(spark, Corpus("web", [str(where)], format="json")) is None
    assert file_index(spark, Corpus("web", [str(tmp_path / "none")])) is None
