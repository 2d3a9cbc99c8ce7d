"""Decontamination against plain alignment of every document with every item."""

from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm import decontaminate
from millrace.llm.decontaminate import GAP, MATCH, MISMATCH, align, best_alignment, contaminated, words_of


def plain_score(item, text):
    """Best local alignment by the textbook recurrence."""
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (MATCH if a == b else MISMATCH), above[j] + GAP, row[-1] + GAP))
        best, above = max(best, *row), row
    return best


def corpus(seed):
    r = random.Random(seed)
    common = [f"c{k}" for k in range(30)]
    words = [f"w{k}" for k in range(3000)]

    def prose(n):
        return [r.choice(common) if r.random() < 0.5 else r.choice(words) for _ in range(n)]

    items = [(k, " ".join(prose(r.randrange(15, 60)))) for k in range(12)] + [(50, "lone short"), (51, None), (52, "")]
    docs = []
    for k in range(150):
        body = prose(r.randrange(20, 300))
        if k % 3 == 0:
            copy = items[r.randrange(12)][1].split()
            for _ in range(int(len(copy) * r.choice([0, 0, 0.1, 0.2]))):
                at = r.randrange(len(copy))
                copy[at:at + 1] = r.choice([[], [f"new{k}"], [copy[at], f"ins{k}"]])
                copy = copy or ["x"]
            at = r.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in copy] if k % 2 else copy
        docs.append((k, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("reach", [3, 1])
def test_against_all_pairs(spark, docs_of, monkeypatch, reach):
    """Whole texts as one segment each, and texts of several segments, of 240 words with an overlap of 60."""
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 1024 if reach == 3 else 100)
    monkeypatch.setattr(decontaminate, "REACH", reach)
    docs, items = corpus(1)
    found = contaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, text in docs:
        for j, item in items:
            a = words_of(item or "")
            score = plain_score(a, words_of(text)) / (MATCH * len(a)) if a else 0
            if score >= 0.5:
                want[i, j] = score
    assert len(want) > 30
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == pytest.approx(want)
    spans = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in found}
    for i, text in docs:
        if i in spans:
            a, b = spans[i]
            assert 0 <= a < b <= len(words_of(text))


def test_a_passage_in_every_document_is_found(spark, docs_of):
    item = " ".join(f"q{k}" for k in range(20))
    docs = docs_of([(k, f"start {k} {item} end {k}") for k in range(200)] + [(900, "nothing of it here at all")])
    found = contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.count() == 200 and found.filter("score < 1").count() == 0


def test_alignment_against_the_textbook():
    r = np.random.Generator(np.random.PCG64(2))
    for _ in range(100):
        item, text = r.integers(0, 5, r.integers(1, 12)), r.integers(0, 5, r.integers(1, 40))
        score = plain_score(item.tolist(), text.tolist())
        assert align(item, text).max() == score
        found = best_alignment(item, text, 1)
        assert (found[0] if found else 0) == score


def test_wide_texts_are_aligned_in_runs(monkeypatch):
    r = np.random.Generator(np.random.PCG64(3))
    monkeypatch.setattr(decontaminate, "ALIGNED_CELLS", 1)
    for _ in range(50):
        item, text = r.integers(0, 4, 6), r.integers(0, 4, 200)
        found = best_alignment(item, text, 1)
        assert found[0] == plain_score(item.tolist(), text.tolist())
        assert found[1] <= found[3] - found[2]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same words in this text"), (1, "no id here"), (None, "same words in")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(odd_docs, items).collect()}
    assert found[5, 1] == found[6, 1] == found[6, None] == 1 and (None, 1) in found and {k[0] for k in found} == {5, 6, None}
    assert contaminated(no_docs, items).count() == 0
    assert contaminated(odd_docs, items.limit(0)).count() == 0


def test_a_frequent_edited_copy_is_found(spark, docs_of):
    """More than half of the item's trigrams stand in no document; those left stand in all of them."""
    item = [f"q{k}" for k in range(40)]
    copy = " ".join("new" if k % 5 == 2 else w for k, w in enumerate(item))
    docs = [(k, f"start {k} {copy} end {k}") for k in range(200)] + [(900, "q0 q1 nothing q3 q4 else")]
    found = contaminated(docs_of(docs), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    want = plain_score(item, words_of(docs[0][1])) / (MATCH * len(item))
    assert want > 0.5 and sorted(r["doc_id"] for r in found) == list(range(200))
    assert {r["score"] for r in found} == {want}


def test_long_runs_and_rare_seeds(spark, docs_of, tmp_path):
    """25 of an item's 59 words are reported; 15 are not.  Seeds are the rarer half; the documents are read once."""
    item = [f"q{k}" for k in range(59)]
    docs = docs_of([(1, " ".join(["a"] * 40 + item[10:35] + ["b"] * 40)), (2, " ".join(["a"] * 40 + item[10:25] + ["b"] * 40))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert [(r["doc_id"], r["n_matches"], r["start_word"], r["end_word"]) for r in found.collect()] == [(1, 25, 40, 65)]
    assert not any("documents.parquet" in f for f in found.inputFiles())


def test_seeds_are_the_rarer_half(spark):
    items = spark.createDataFrame([(1, [10, 11, 12, 99]), (2, [10]), (3, [99])], "item long, grams array<long>")
    segments = spark.createDataFrame([(k, [10] + [11] * (k < 5) + [12] * (k < 2)) for k in range(9)], "segment long, grams array<long>")
    ranked = decontaminate._ranked(items, segments).collect()
    assert {(r["item"], r["gram"]): r["seed"] for r in ranked} == {(1, 10): False, (1, 11): True, (1, 12): True, (2, 10): True}
    pairs = decontaminate._pairs(segments, decontaminate._ranked(items, segments)).collect()
    assert sorted(tuple(r) for r in pairs) == sorted((k, i) for k in range(9) for i in (1, 2))
