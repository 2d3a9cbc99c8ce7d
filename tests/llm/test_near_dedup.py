"""Near-duplicate groups and components against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from millrace.llm import near_dedup
from millrace.llm.components import components
from millrace.llm.near_dedup import match_threshold, near_duplicates, signature
from millrace.llm.wordhash import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, n):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}


def plain_groups(rows, n, percent):
    """Component per row, by comparing all pairs of rows with a text; equal ids are one node."""
    sets = [plain_set(text, n) for _, text in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            shared, same_id = len(sets[i] & sets[j]), rows[i][0] is not None and rows[i][0] == rows[j][0]
            if (sets[i] and sets[j] and same_id) or shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), i if not sets[k] else least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def found_groups(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def copies(seed, families=12, most=9):
    """Families of texts that drift apart by edits, so that links chain, with common passages in between."""
    r = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = []
    for f in range(families):
        words = [f"f{f}w{r.randrange(400)}" for _ in range(r.randrange(20, 160))]
        for _ in range(r.randrange(1, most)):
            text = " ".join(words)
            rows.append(text if r.random() < 0.6 else f"{passage} {text}".upper() if r.random() < 0.2 else text + " ")
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                words[r.randrange(len(words))] = f"e{r.randrange(10_000)}"
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_groups_against_all_pairs(docs_of, seed, n, percent):
    rows = copies(seed)
    assert found_groups(near_duplicates(docs_of(rows), n, percent)) == plain_groups(rows, n, percent)


def test_blocks_lose_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 3)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 200)
    rows = copies(3, families=5, most=25)
    assert found_groups(near_duplicates(docs_of(rows), 3, 85)) == plain_groups(rows, 3, 85)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = near_duplicates(odd_docs, 3, 85).collect()
    want = plain_groups(rows, 3, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_threshold_is_rarely_missed():
    from math import comb

    for percent in (80, 85, 95):
        t, p = match_threshold(percent), percent / 100
        assert sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(t)) <= 1e-6


def test_matches_follow_similarity():
    r = np.random.Generator(np.random.PCG64(1))
    shared, own = r.integers(0, 2**63, 800, dtype=np.uint64), r.integers(0, 2**63, (2, 100), dtype=np.uint64)
    a, b = (signature(np.concatenate([shared, x])) for x in own)
    assert 0.65 < (a == b).mean() <= 1  # the similarity is 0.8


def test_words_hash_alike_wherever_they_stand():
    long = "y" * 70_000
    texts = ["One two\tone", "", "x " * 300_000 + "ONE two", f"{long} one {long}"]
    hashes, bounds = word_hashes([t.encode() for t in texts])
    names = {}
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        words = WORD.findall(text.translate(FOLD))
        assert len(words) == b - a
        for word, h in zip(words, hashes[a:b].tolist(), strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    assert [len(s) for s in shingle_sets([b"a b c d a b c", b"a b", b"", b"a a a a"], 3)] == [4, 1, 0, 1]


@pytest.mark.parametrize("finish", [0, 40, 10**6])
def test_components(spark, finish):
    r = random.Random(4)
    chain = [(k, k + 1) for k in range(1000, 1150)]
    star = [(5, k) for k in range(2000, 2100)]
    rest = [(r.randrange(300, 900), r.randrange(300, 900)) for _ in range(250)]
    links = chain + star + rest + [(7, 7)]
    r.shuffle(links)
    found = {row["node"]: row["component"] for row in
             components(spark.createDataFrame(links, "a long, b long"), finish_links=finish).collect()}
    near: dict = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        if node not in want:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = node
                    todo += near[x]
    assert found == want
