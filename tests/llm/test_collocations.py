"""Phrases against plain counts of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from millrace import session
from millrace.llm import collocations as c

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "doc_id long, text string, lang string, n string, rank string, score string"


def plain(rows, least, longest, top):
    counts = defaultdict(Counter)
    for text, lang in rows:
        folded = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i:i + m])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        dropped = set()
        for k, v in candidates.items():
            for m in range(2, len(k)):
                for i in range(len(k) - m + 1):
                    if 100 * v >= 100 * f[k[i:i + m]]:
                        dropped.add(k[i:i + m])
        scored = []
        for k, a in candidates.items():
            if k not in dropped:
                cuts = [(1000 * a * n // (f[k[:j]] * f[k[j:]]), j) for j in range(1, len(k))]
                score, j = min(cuts)
                scored.append((-score, -a, " ".join(k).encode(), f[k[:j]], f[k[j:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def check(spark, rows, least=3, longest=5, top=40):
    df = spark.createDataFrame([(k % 7 or None, t, x, "n", "r", "s") for k, (t, x) in enumerate(rows)], SCHEMA)
    got = c.collocations(df.repartition(5), least, longest, top)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, longest, top)
    return got


def texts(seed, n=300):
    """Words of very different frequency, fixed phrases, repeated texts, marks and capitals."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    fixed = [" ".join(r.sample(words, 5)) + f" Zz{k} {'é' * (k + 1)} Qq{k}" for k in range(6)]
    rows = []
    for k in range(n):
        body = r.choices(words, weights, k=25)
        body.insert(r.randrange(25), r.choice(fixed))
        text = " ".join(body).replace("w3 ", "w3, ").replace("w7 ", "W7\t").replace("w9 ", "w9\n")
        rows.append((text, r.choice(["en", "en", "en", "de", None])))
    return rows + rows[:40] + [(None, "en"), ("", None), (" ,.; ", "fr"), ("one word", "fr"), ("x" * 100_000, "de")]


@pytest.mark.parametrize("seed", [1])
def test_against_all_counts(spark, seed):
    check(spark, texts(seed))


@pytest.mark.parametrize("top", [5, 5000])
def test_rounds_stop_only_when_settled(spark, monkeypatch, top):
    """Narrow first bands, so that several rounds are needed; few, many or all phrases are asked for."""
    monkeypatch.setattr(c, "FIRST_WORDS", 1)
    monkeypatch.setattr(c, "WIDEN", 2)
    check(spark, texts(3, 150), top=top)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    """With next to no bits nearly everything passes by chance, in every round."""

    class Tiny(c.Bitmap):
        def __init__(self, keys):
            super().__init__(keys)
            self.words[:] = ~self.words.dtype.type(0)

    monkeypatch.setattr(c, "Bitmap", Tiny)
    monkeypatch.setattr(c, "FIRST_WORDS", 3)
    check(spark, texts(4, 100))


def test_ties_and_overlaps(spark):
    rows = [("a a a a a a a", "en")] * 3 + [("p q. r s. t u", "en")] * 4 + [("é z", "en"), ("z é", "en")] * 4
    check(spark, rows, top=3)
    check(spark, rows, top=100)
    check(spark, rows, least=1, longest=2)


def test_long_words_repeat(spark):
    long = "y" * 70_000
    check(spark, [(f"{long} {long.upper()} z", "en")] * 4)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    got = c.collocations(odd_docs, least=2, top=30)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 2, 5, 30)
    empty = c.collocations(no_docs)
    assert empty.columns == COLUMNS and empty.count() == 0
    assert c.collocations(odd_docs, least=10_000).count() == 0


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_001
    from pyspark.sql import functions as F

    row = spark.range(1).select(c._score(F.lit(big), F.lit(7_000_000_000_000_000), F.lit(big), F.lit(3)).alias("s")).first()
    assert row["s"] == 1000 * 7_000_000_000_000_000 // 3


@pytest.mark.parametrize("rows", [0, 1, c.OUT_ROWS, c.OUT_ROWS + 1, 3 * c.OUT_ROWS + 5])
def test_rows_leave_a_task_in_small_pieces(rows):
    import pyarrow as pa

    whole = pa.RecordBatch.from_pydict({"v": pa.array(range(rows), pa.int64())})
    pieces = list(c._in_pieces(whole))
    assert pieces and max(p.num_rows for p in pieces) <= c.OUT_ROWS
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([whole]))


def test_rows_reach_a_task_in_small_batches(spark, monkeypatch):
    """Texts of 5 MB in all, in few enough rows for one batch of Spark's default size."""
    monkeypatch.setattr(c, "IN_BYTES", 1 << 20)
    whole, limit = c.slices, c.IN_BYTES + 100_000

    def slices(batch, column, size):
        if batch.nbytes > limit:
            raise ValueError(f"a batch of {batch.nbytes} bytes")
        return whole(batch, column, size)

    monkeypatch.setattr(c, "slices", slices)
    r = random.Random(7)
    rows = [(" ".join(r.choices([f"w{k}" for k in range(9)], k=8_000)), "en") for _ in range(220)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert c.collocations(df, 1_000, 2, 10).count() == 10
    assert spark.conf.get(session.BATCH_BYTES, None) is None


def test_limits_of_batches_end_and_leave_the_session_its_own(spark):
    with pytest.raises(ValueError), session.small_batches(spark, 1000):
        assert spark.conf.get(session.BATCH_BYTES, None) == "1000"
        raise ValueError
    assert spark.conf.get(session.BATCH_BYTES, None) is None
    spark.conf.set(session.BATCH_BYTES, "1m")
    try:
        with session.small_batches(spark, 1000):
            assert spark.conf.get(session.BATCH_BYTES, None) == "1m"
        assert spark.conf.get(session.BATCH_BYTES, None) == "1m"
    finally:
        spark.conf.unset(session.BATCH_BYTES)
