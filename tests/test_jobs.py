from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.tokenizers import WordTokenizer
from millrace.operators.clean import encode, measure
from millrace.operators.ledger import append_ledger, load_ledger, load_state_json, read_ledger
from millrace.operators.pack import pack
from millrace.operators.quota import apply_quota
from millrace.plans import jobs
from millrace.plans.jobs import build_shards, collect, committed_runs, read_until_full
from millrace.plans.mixture import Domain, mixture_plan
from millrace.sources.corpora import (
    Corpus,
    open_corpus,
    read_line_docs,
    scan_corpora,
    write_line_docs,
)
from millrace.sources.shards import read_shards, shard_catalog, validate_shards

WORDS = WordTokenizer()
SCHEMA = "domain string, doc_seq long, text string"


def rows_of(domain, n, words=60):
    return [
        (domain, i, f"{domain} {i % 13} " + "word " * (words + i % 5) if i % 7 else "short")
        for i in range(n)
    ]


@pytest.fixture
def sources(spark, tmp_path):
    frames = {}
    for name, n in (("web", 80), ("code", 40), ("books", 30)):
        df = spark.createDataFrame(rows_of(name, n), SCHEMA)
        if name == "code":
            df = df.withColumnRenamed("text", "content")
        df.write.parquet(str(tmp_path / name))
        frames[name] = df
    catalog = [
        Corpus("web", [str(tmp_path / "web")]),
        Corpus("lost", [str(tmp_path / "nowhere")]),
        Corpus("code", [str(tmp_path / "primary"), str(tmp_path / "code")], field="content"),
        Corpus("books", [str(tmp_path / "books")]),
    ]
    domains = [
        Domain("web", 2_000), Domain("lost", 500), Domain("code", 900, field="content"),
        Domain("books", 600, bounded=True),
    ]
    return catalog, domains


def test_reading_stops_behind_the_cut(spark, sources):
    catalog, domains = sources
    plan = mixture_plan(spark, [Domain("web", 1_000)]).withColumn("batch", F.lit(4))
    state = load_ledger(plan, read_ledger(spark, "/nowhere"))
    raw = open_corpus(spark, catalog[0])
    part = read_until_full(raw, plan, state, WORDS, width=3)
    table = measure(raw, WORDS)
    whole = apply_quota(table, table, plan).select("domain", "doc_seq", "n_tokens").collect()
    from_part = apply_quota(part, part.drop("text_norm"), plan).select("domain", "doc_seq", "n_tokens")
    assert sorted(from_part.collect()) == sorted(whole)
    assert part.count() < 80
    everything = plan.withColumn("quota", F.lit(10**9))
    assert read_until_full(raw, everything, state, WORDS, width=3).count() == 80


def lines(spark, out):
    return sorted(tuple(r) for r in read_line_docs(spark, out).select("domain", "text").collect())


def test_collect_isolates_failures_and_resumes(spark, sources, tmp_path):
    catalog, domains = sources
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    status = {r["domain"]: r["status"] for r in collect(spark, domains, catalog, WORDS, out, ledger).collect()}
    assert status == {"web": "ok", "lost": "failed", "code": "ok", "books": "ok"}

    plan = mixture_plan(spark, domains)
    docs, _ = scan_corpora(spark, catalog, on_error="skip")
    table = measure(docs, WORDS, keep_text=True)
    kept = apply_quota(table, table.drop("text_norm"), plan)
    expected = sorted(tuple(r) for r in kept.select("domain", "text_norm").collect())
    assert lines(spark, out) == expected

    in_order = read_line_docs(spark, out, ordered=True).orderBy("domain", "doc_seq")
    by_seq = kept.orderBy("domain", "doc_seq").select("domain", "text_norm").collect()
    assert [tuple(r) for r in in_order.select("domain", "text").collect()] == [tuple(r) for r in by_seq]

    done = {r["domain"]: r["done_tokens"] for r in load_ledger(plan, read_ledger(spark, ledger)).collect()}
    totals = {r["domain"]: r["t"] for r in kept.groupBy("domain").agg(F.sum("n_tokens").alias("t")).collect()}
    assert done == {**totals, "lost": 0}

    # A second run with the same budgets adds nothing; with a higher one it goes on.
    status = {r["domain"]: r["status"] for r in collect(spark, domains, catalog, WORDS, out, ledger).collect()}
    assert status["books"] == "complete" and lines(spark, out) == expected
    more = [Domain("web", 10**6), *domains[1:-1], Domain("books", 10**6, bounded=True)]
    collect(spark, more, catalog, WORDS, out, ledger)
    grown = lines(spark, out)
    everything = table.filter("n_tokens > 0 AND domain IN ('web', 'books')").select("domain", "text_norm")
    assert [g for g in grown if g[0] != "code"] == sorted(tuple(r) for r in everything.collect())


@pytest.mark.parametrize("scope", ["domain", "global"])
def test_collect_with_dedup(spark, sources, tmp_path, scope):
    catalog, domains = sources
    big = [Domain(d.name, 10**9, d.field, d.bounded) for d in domains]
    out = str(tmp_path / "out")
    collect(spark, big, catalog, WORDS, out, str(tmp_path / "ledger"), dedup=scope)
    got = lines(spark, out)
    assert len(set(got)) == len(got) and got


def test_scan_raises_unless_told_to_skip(spark, sources):
    catalog, _ = sources
    with pytest.raises(Exception, match="nowhere"):
        scan_corpora(spark, catalog)
    docs, status = scan_corpora(spark, catalog, on_error="skip")
    assert {r["domain"] for r in status.filter("status = 'failed'").collect()} == {"lost"}
    none, _ = scan_corpora(spark, catalog[1:2], on_error="skip")
    assert none.count() == 0 and none.columns == docs.columns
    missing = open_corpus(spark, Corpus("x", catalog[0].paths, field="absent"))
    assert missing.filter("text IS NOT NULL").count() == 0 and missing.count() == 80


def test_line_documents_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {"alpha": [f"line {i}" for i in range(500)], "beta": ["one", "two"]}
    for name, content in texts.items():
        (tmp_path / "in" / f"{name}.txt").write_text("".join(f"{t}\n" for t in content))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read_line_docs(spark, str(tmp_path / "in"), ordered=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, content in texts.items():
        mine = sorted((r["doc_seq"], r["text"]) for r in rows if r["domain"] == name)
        assert mine == list(enumerate(content))


def test_line_sink_round_trip(spark, tmp_path):
    rows = [("a", "x y"), ("a", "x y"), ("b/c", "é \U0001f600"), ("wiki ko: a/b", "1"), ("50% + é?", "2"), ("a=b%20c", "3"), (None, "4")]
    docs = spark.createDataFrame(rows, "domain string, text_norm string")
    write_line_docs(docs, str(tmp_path / "out"), max_records=1)
    back = read_line_docs(spark, str(tmp_path / "out")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(map(repr, rows))


def broken(path):
    """Overwrites the middle of a parquet file, so that it opens and fails while it is read."""
    file = next(path.glob("part-*.parquet"))
    raw = file.read_bytes()
    file.write_bytes(raw[:8] + b"\xff" * (len(raw) // 2) + raw[8 + len(raw) // 2:])
    for crc in path.glob(".*.crc"):
        crc.unlink()


@pytest.mark.parametrize("dedup", [None, "domain"])
def test_json_files_follow_the_ledger(spark, sources, tmp_path, dedup):
    catalog, domains = sources
    out, ledger, reports = (str(tmp_path / x) for x in ("out", "ledger", "reports"))
    collect(spark, domains, catalog, WORDS, out, ledger, target=3_000, dedup=dedup, reports=reports)
    state = json.loads((tmp_path / "reports" / "state.json").read_text())
    progress = json.loads((tmp_path / "reports" / "progress.json").read_text())
    rows = {r["domain"]: r for r in load_ledger(mixture_plan(spark, domains), read_ledger(spark, ledger)).collect()}
    assert state["domain_progress"] == progress["domain_progress"] == {d: r["done_tokens"] for d, r in rows.items()}
    assert state["total_tokens"] == progress["total_tokens"] == sum(r["done_tokens"] for r in rows.values()) > 0
    assert progress["domain_resume_info"] == state["domain_resume_info"]
    assert state["domain_resume_info"]["web"]["sample_idx"] == rows["web"]["resume_seq"] + 1
    assert progress["target_tokens"] == 3_000 and progress["event"] == "end" and progress["domain_plan"]["lost"] == 500
    assert {p.name for p in (tmp_path / "reports").iterdir() if p.suffix == ".json"} == {"state.json", "progress.json"}

    # A later run without one of the domains keeps its tokens in the total and the time of the start.
    rest = [d for d in domains if d.name != "books"]
    collect(spark, rest, catalog[:1], WORDS, out, ledger, reports=reports)
    later = json.loads((tmp_path / "reports" / "state.json").read_text())
    assert later["start_time"] == state["start_time"] and "books" not in later["domain_progress"]
    assert later["total_tokens"] >= sum(later["domain_progress"].values()) + rows["books"]["done_tokens"]
    loaded = load_state_json(spark, mixture_plan(spark, rest), f"{reports}/state.json", all_domains=True)
    assert sum(r["done_tokens"] for r in loaded.collect()) == later["total_tokens"]


@pytest.mark.parametrize("dedup", [None, "global"])
def test_an_entry_the_plan_does_not_have_is_reported(spark, sources, tmp_path, dedup):
    """Its source spans several slices, and it stands first and last in the catalog."""
    catalog, domains = sources
    other = Corpus("other", catalog[0].paths)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    status = collect(spark, domains, [other, *catalog, other], WORDS, out, ledger, dedup=dedup, slice_width=10)
    got = [tuple(r)[:2] for r in status.collect()]
    assert got.count(("other", "unplanned")) == 2 and ("lost", "failed") in got
    assert {d for d, s in got if s == "ok"} == {"web", "code", "books"}
    assert "other" not in {r["domain"] for r in read_ledger(spark, ledger).collect()}


def test_a_broken_file_fails_its_domain_only(spark, sources, tmp_path):
    catalog, domains = sources
    broken(tmp_path / "web")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    status = {r["domain"]: r for r in collect(spark, domains, catalog, WORDS, out, ledger).collect()}
    assert {k: r["status"] for k, r in status.items()} == {"web": "failed", "lost": "failed", "code": "ok", "books": "ok"}
    assert status["web"]["error"] and {d for d, _ in lines(spark, out)} == {"code", "books"}
    assert {r["domain"] for r in read_ledger(spark, ledger).collect()} == {"code", "books"}
    both = collect(spark, domains, catalog, WORDS, str(tmp_path / "o2"), str(tmp_path / "l2"), dedup="domain")
    assert {r["domain"]: r["status"] for r in both.collect()}["web"] == "failed"


def test_a_run_that_dies_keeps_the_domains_before(spark, sources, tmp_path, monkeypatch):
    catalog, domains = sources
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    whole = str(tmp_path / "whole")
    collect(spark, domains, catalog, WORDS, whole, str(tmp_path / "ledger2"))
    calls = []

    def dies(rows, path, run):
        calls.append(run)
        if len(calls) == 2:
            raise KeyboardInterrupt
        append_ledger(rows, path, run)

    monkeypatch.setattr(jobs, "append_ledger", dies)
    with pytest.raises(KeyboardInterrupt):
        collect(spark, domains, catalog, WORDS, out, ledger)
    monkeypatch.undo()
    assert [r["domain"] for r in read_ledger(spark, ledger).collect()] == ["web"]
    assert {d for d, _ in lines(spark, out)} == {"web", "code"}  # the second one's folder has no ledger row
    assert {d for d, _ in lines(spark, committed_runs(spark, out, ledger))} == {"web"}
    status = {r["domain"]: r["status"] for r in collect(spark, domains, catalog, WORDS, out, ledger).collect()}
    assert status["web"] == "complete" and lines(spark, out) == lines(spark, whole)


def test_tokens_of_domains_that_left_the_plan_count_towards_the_target(spark, sources, tmp_path):
    catalog, domains = sources
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    collect(spark, [Domain("books", 500)], catalog[3:], WORDS, out, ledger)
    before = read_ledger(spark, ledger).agg(F.sum("tokens_added")).first()[0]
    collect(spark, [Domain("web", 10**6, bounded=True)], catalog[:1], WORDS, out, ledger, target=before + 300)
    web = read_ledger(spark, ledger).filter("domain = 'web'").agg(F.sum("tokens_added")).first()[0]
    assert 300 <= web < 300 + 100


def test_the_tokenizer_runs_once(spark, sources, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def encode(self, text):
            @F.pandas_udf("array<int>")
            def ids(texts):
                calls.add(len(texts))
                return texts.map(lambda t: [3] * len(t.split()))

            return ids.asNondeterministic()(text)

        def count(self, text):
            raise AssertionError("counted apart from the ids")

    docs = spark.createDataFrame([(k, "a b c") for k in range(50)], "doc_seq long, text_norm string")
    rows = encode(docs, Counting()).filter("n_tokens > 0").collect()
    assert len(rows) == 50 and calls.value == 50 and all(r["n_tokens"] == len(r["ids"]) == 3 for r in rows)


def test_lines_to_shards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("alpha", 50), ("beta", 9)):
        (tmp_path / "in" / f"{name}.txt").write_text("".join(f"{name} {i} w\n" for i in range(n)))
    out = str(tmp_path / "shards")
    build_shards(spark, str(tmp_path / "in"), out, WORDS, seq_len=16, per_shard=4)

    catalog = {r["shard"]: r["num_sequences"] for r in shard_catalog(spark, out).collect()}
    assert catalog == {"shard_000": 4, "shard_001": 4, "shard_002": 4, "shard_003": 4, "shard_004": 3}
    assert validate_shards(spark, out, WORDS.vocab_size).filter("NOT ok").count() == 0
    assert json.loads((tmp_path / "shards" / "shard_004.meta").read_text())["source"] == "shard_004"

    ordered = read_line_docs(spark, str(tmp_path / "in"), ordered=True)
    docs = ordered.select(
        "domain", "doc_seq", WORDS.count(F.col("text")).alias("n_tokens"),
        WORDS.encode(F.col("text")).alias("ids"),
    )
    want = [
        list(r["tokens"]) for r in pack(docs, 16).orderBy("source", "seq").collect()
    ]
    got = [list(r["tokens"]) for r in read_shards(spark, out).orderBy("shard_id", "seq_in_shard").collect()]
    assert got == want
