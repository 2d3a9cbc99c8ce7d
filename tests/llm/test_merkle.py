"""The manifest against a plain walk over lists."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from millrace.llm import merkle
from millrace.llm.common import held_out

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(values))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """The root of a list of digests, and for each its siblings (left, right) on the way."""
    paths = [[] for _ in nodes]
    members = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for first in range(0, len(nodes), 16):
            run = nodes[first:first + 16]
            for k in range(len(run)):
                for m in members[first + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha("".join(run)))
            owners.append([m for k in range(len(run)) for m in members[first + k]])
        nodes, members = above, owners
    return (nodes[0] if nodes else None), paths


def plain(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((first(r[0]), leaf(r), r) for r in rows if r[1] == s), key=lambda x: x[:2])
        trees.append((own, *climb([x[1] for x in own])))
    root, above = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), upper in zip(trees, above, strict=True):
        for (_, digest, r), path in zip(own, paths, strict=True):
            changed = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0
            h = leaf((*r[:4], lower(r[4]))) if changed else digest
            for left, right in path + upper:
                h = sha(left + h + right)
            proof = sha("".join(a + b for a, b in path + upper))
            out.append((r[0], digest, subroot, root, proof, h, h == root))
    return sorted(out, key=repr)


def check(spark, df, tmp_path):
    rows = [tuple(r) for r in df.select(*merkle.DOCUMENT_FIELDS).collect()]
    got = merkle.verify_tampered(df, str(tmp_path / "m"), held_out("doc_id", 5, 0))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_trees_of_many_sizes(spark, tmp_path):
    """Sources of 1 to 700 rows: one node, one run, one block, several blocks; more than 16 sources."""
    sizes = [1, 2, 15, 16, 17, 31, 255, 256, 257, 273, 700] + [3] * 8
    rows = [(1000 * s + k, f"Text {k} of S{s}", "en", f"s{s:02d}" if s else None, k) for s, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(spark, df.repartition(7), tmp_path)


def test_three_tables_of_blocks(spark, tmp_path, monkeypatch):
    """A source of more than SPAN blocks needs a third table; its proofs still fold to the root."""
    rows = spark.range(66_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("en").alias("lang"),
        F.lit("hot").alias("source"), F.lit(3).cast("long").alias("n_chars"),
    )
    manifest = merkle.build_manifest(rows, str(tmp_path / "m"))
    assert len(manifest.leaves) == 3
    found = merkle.proofs(manifest)
    assert found.count() == 66_000
    folded = found.select((merkle.fold(F.col("digest"), F.col("proof")) == F.col("root")).alias("ok"), "root")
    assert folded.filter("NOT ok").count() == 0
    want, _ = climb([leaf((k, "hot", "en", 3, f"T{k}")) for k in range(66_000)])
    assert {r["root"] for r in folded.select("root").distinct().collect()} == {want}
    again = merkle.proofs(merkle.open_manifest(spark, str(tmp_path / "m"), 3, len(manifest.roots)))
    assert again.filter(F.col("row") == 77).first()["proof"] == found.filter(F.col("row") == 77).first()["proof"]


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    check(spark, odd_docs, tmp_path / "a")
    check(spark, no_docs, tmp_path / "b")


def test_equal_rows_without_an_id_are_spread(spark, docs_of, tmp_path):
    """A third of the rows are one row over and over; no range holds much more than its share."""
    given = [(k, f"Words {k}") for k in range(4000)] + [(None, "Same")] * 2000
    df = docs_of(given).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        leaves = df.select(F.col("source").alias("group"), F.col("doc_id").alias("order"), F.lit("x").alias("digest"))
        parts = merkle.numbered(leaves, ["group", "order", "digest"], "spread")
        sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
        assert sum(sizes) == 6000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
        numbers = sorted(r["_number"] for r in parts.select("_number").collect())
        assert numbers == list(range(6000))
        check(spark, df, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
