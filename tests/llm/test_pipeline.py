"""The pipeline's stages, each on its own input, and the whole against a plain version."""

from __future__ import annotations

import random
import re
import shutil

import public_tokenizers
import pytest
from test_near_dedup import plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import language as language_model
from millrace.llm import toxicity as toxicity_model
from millrace.llm.common import held_out

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, stored, on the smallest tables; the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dedup", "decontaminate", "packing"]
    assert all(df.columns == COLUMNS for df in stages[:5])
    for before, after in zip(stages, stages[1:5], strict=False):
        kept = {tuple(r) for r in after.collect()}
        assert kept <= {tuple(r) for r in before.collect()} and len(kept) == after.count() > 0


def test_language_and_toxicity_follow_their_models(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_model.fit_languages(docs, ~held_out("doc_id", 5, 0))
    own = rows(stages[0])
    names, shares, _ = model.predict(list(own.values()))
    want = {k for k, name, share in zip(own, names, shares, strict=True) if name != "und" and share >= 0.4}
    assert set(rows(stages[1])) == want
    network = toxicity_model.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out("doc_id", 4, 2))
    own = rows(stages[1])
    assert set(rows(stages[2])) == {k for k, s in zip(own, network.scores(list(own.values())), strict=True) if s < 0.3}


def test_near_dedup_keeps_one_of_each_group(stages):
    own = rows(stages[2])
    want = {i for i, _, component in plain_groups(list(own.items()), 5, 80) if i == component}
    assert set(rows(stages[3])) == want


def test_decontamination_drops_copies(spark, stages):
    words = re.compile(r"[^\W_]+")
    items = [words.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = rows(stages[4])
    for k, text in rows(stages[3]).items():
        found = " ".join(words.findall(text.lower()))
        if any(f" {' '.join(item)} " in f" {found} " for item in items):
            assert k not in kept


def test_packing_holds_every_token(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths: dict = {}
    for r in stages[5].collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows(stages[4]).items()}


def test_odd_rows_pass_through_every_stage(spark, odd_docs):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd_docs, SF)
        if k < 4:
            assert out.columns == odd_docs.columns, name
            texts = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert len(texts) <= odd_docs.count()
            if name == "language":
                assert {i for i, _ in texts} >= {4, 5, 6, 7, None} and not {i for i, _ in texts} & {1, 2, 3, 9}
            if name == "near_dedup":
                ids = [i for i, _ in texts]
                assert len(ids) == len(set(ids)) and set(ids) == {1, 2, 3, 4, 5, 7, 8, 9, 10, None}
        else:
            assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None}
        assert stage(spark, odd_docs.limit(0), SF).count() == 0


def test_a_column_named_like_the_row_number_stays(spark, docs_of):
    given = docs_of([(1, "some words of a text"), (2, "other words of one more")], {"_stage_row": "'x'", "_stage_row_": "7"})
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontaminate):
        out = stage(spark, given, SF)
        assert out.columns == given.columns and {(r["_stage_row"], r["_stage_row_"]) for r in out.collect()} == {("x", 7)}


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    shutil.rmtree(tmp_path / "documents.parquet")
    r = random.Random(1)
    text = " ".join(r.choice(["ab", "cd", "ef"]) for _ in range(40))
    docs = spark.createDataFrame([(1, text, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1  # nothing to learn from: nothing is dropped


def test_clean_rows_without_an_id_of_their_own_stay(spark, docs_of, odd_docs):
    """Rows that share an id or have none go only if their own text is a copy."""
    r = random.Random(2)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    a, b, c, d, e, f = (" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(40)) for _ in range(6))
    given = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, d), (None, e), (None, e), (None, f), (4, f)]
    kept = corpus_pipeline.near_dedup(spark, docs_of(given), SF)
    assert kept.columns == COLUMNS
    assert {(x["doc_id"], x["text"]) for x in kept.collect()} == {(1, a), (2, b), (3, c), (3, d), (None, e), (4, f)}
    assert kept.count() == 6
    given = [(1, a), (1, f"{b} {item}"), (None, f"{c} {item}"), (None, d)]
    kept = corpus_pipeline.decontaminate(spark, docs_of(given), SF)
    assert {(x["doc_id"], x["text"]) for x in kept.collect()} == {(1, a), (None, d)}
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontaminate):
        out = stage(spark, odd_docs, SF)
        assert out.columns == odd_docs.columns and None in {x["doc_id"] for x in out.select("doc_id").collect()}
        assert stage(spark, odd_docs.limit(0), SF).count() == 0
