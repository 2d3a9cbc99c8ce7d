from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import human_time, normalize_text
from millrace.functions.tokenizers import (
    PatternTokenizer,
    SentencePieceTokenizer,
    WordTokenizer,
)
from millrace.operators.clean import clean, count_tokens, drop_uncounted, encode, measure
from millrace.plans.documents import ascii_model


def plain(text, max_chars=200_000):
    return " ".join(text[:max_chars].replace("\x00", " ").split())


def normalized(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = df.select("i", normalize_text(F.col("t")).alias("n")).collect()
    return [n for _, n in sorted(rows)]


def test_every_code_point_of_the_basic_plane(spark):
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)} c{chr(c)}" for c in points]
    assert normalized(spark, texts) == [plain(t) for t in texts]


def test_random_blanks_and_idempotence(spark):
    rng = random.Random(1)
    alphabet = "ab \t\n\r\x0b\x0c\x00\x1c\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\U0001f600"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    once = normalized(spark, texts)
    assert once == [plain(t) for t in texts]
    assert normalized(spark, once) == once


EDGES = [
    (None, None),
    ("", None),
    ("x" * 199, None),
    ("x" * 200, 200),
    ("x" * 198 + "  ", None),
    ("x" * 100 + "  " + "y" * 98, None),
    ("x" * 200_000, 200_000),
    ("x" * 200_001, 200_000),
    (" " * 300, None),
    ("x\u3000" * 150, 299),
    ("\U00010400" * 200, 200),
    ("\U00010400" * 199, None),
    (" " * 199_900 + "x" * 400, None),
]


def test_edge_rows_of_cleaning(spark):
    df = spark.createDataFrame(
        [("d", i, t) for i, (t, _) in enumerate(EDGES)], "domain string, doc_seq long, text string"
    )
    got = {r["doc_seq"]: len(r["text_norm"]) for r in clean(df).collect()}
    assert got == {i: n for i, (_, n) in enumerate(EDGES) if n is not None}
    flags = {r["doc_seq"]: r["survivor"] for r in measure(df, WordTokenizer()).collect()}
    assert flags == {i: n is not None for i, (_, n) in enumerate(EDGES)}


@pytest.mark.parametrize(
    ("seconds", "text"),
    [
        (-1.0, "N/A"), (-0.5, "N/A"), (0.0, "0m 0s"), (59.9, "0m 59s"), (60.0, "1m 0s"),
        (3599.0, "59m 59s"), (3600.0, "1h 0m"), (86399.0, "23h 59m"), (86400.0, "1d 0h 0m"),
        (1_000_000.0, "11d 13h 46m"),
    ],
)
def test_human_time(spark, seconds, text):
    row = spark.range(1).select(human_time(F.lit(seconds)).alias("t")).first()
    assert row["t"] == text


def test_zero_token_documents_are_dropped(spark):
    df = spark.createDataFrame(
        [("d", 0, "1" * 250), ("d", 1, "word 22 word " * 30)], "domain string, doc_seq long, text string"
    )
    letters = PatternTokenizer("[a-z]+")
    kept = drop_uncounted(count_tokens(clean(df), letters)).collect()
    assert [(r["doc_seq"], r["n_tokens"]) for r in kept] == [(1, 60)]
    ids = encode(clean(df), letters).filter("doc_seq = 1").first()["ids"]
    assert len(ids) == 60 and len(set(ids)) == 1
    rows = measure(df, letters).orderBy("doc_seq").collect()
    assert [(r["survivor"], r["n_tokens"]) for r in rows] == [(True, 0), (True, 60)]


def test_sentencepiece_matches_the_model(spark):
    import sentencepiece

    path = ascii_model(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["plain words", "accents \u00e9\u00e8 and \u4e2d\u6587", "", None, "\U0001f600 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    tokenizer = SentencePieceTokenizer(spark, path)
    rows = df.select("i", tokenizer.count(F.col("t")).alias("n"), tokenizer.encode(F.col("t")).alias("ids"))
    for r in rows.collect():
        expected = model.encode(texts[r["i"]]) if texts[r["i"]] is not None else []
        assert list(r["ids"]) == expected and r["n"] == len(expected)


def test_sentencepiece_runs_once_under_a_filter(spark):
    df = spark.createDataFrame([("d", 0, "w " * 150)], "domain string, doc_seq long, text string")
    counted = drop_uncounted(count_tokens(clean(df), SentencePieceTokenizer(spark, ascii_model(spark))))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
