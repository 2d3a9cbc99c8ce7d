"""A Merkle manifest of a table: one digest for all rows, and a proof for each row.

Every row is a leaf, each group of rows a tree of its own, and the trees' roots are the leaves of
one more tree.  A parent is the SHA-256 of up to ``FAN`` consecutive children.  Rows are dealt
into aligned blocks of ``SPAN`` consecutive nodes of a tree.  A block keeps each of its levels as
one string of hexadecimal digests, so a parent is the hash of a substring of fixed width, and a
node's siblings are the substrings on both sides of it.  The blocks' tops are the leaves of the
next table of blocks, until every tree is one block.

Nulls count as values of their own in any column.  Rows are ordered by group (null first), order
column (null first) and leaf; rows that agree in all of them have the same leaf and may stand for each other.
An empty table has no tree and no rows.  Columns that are not named take no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import materialize, small_side

FAN = 16
LEVELS = 2  # levels above its own nodes that a block holds
SPAN = FAN**LEVELS
HEX = 64  # letters of a digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOCUMENT_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: of each value ``-`` if null, else its UTF-8 bytes with their number and a colon in front."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*[field(v) for v in values])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows, stored, with ``_part`` and ``_number``, their place in ``order`` from 0.

    A range partitioning sorts them; each partition counts its own rows, and only these counts
    (one row per partition) are summed in one task and broadcast.  The rows are written once
    before, because the ranges come from a sample and equal keys are split by the row's place in that table.
    """
    kept = materialize(rows.withColumn("_place", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [*order, "_place"]
    dealt = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place")
    sorted_rows = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    marked = sorted_rows.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    number = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return marked.join(F.broadcast(starts), "_part").withColumn("_number", number).drop("_start", "_at")


def _in_trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree, n, place, digest, row)`` of the leaves, and ``(tree, group)`` of the trees.

    Rows find their tree by partition and group: the rows of one group, however many, are spread like the partitions.
    """
    rows = numbered(leaves, ["group", "order", "digest"], "leaves")
    ranges = materialize(
        rows.groupBy("_part", "group").agg(F.min("_number").alias("first"), F.count("*").alias("n")), "leaf-ranges"
    )
    groups = ranges.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    trees = numbered(groups, ["group"], "groups").select(F.col("_number").alias("tree"), "group", "first", "n")
    trees = materialize(trees, "trees")
    of_range = ranges.select("_part", "group").join(
        trees.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group"))
    ).drop("_group").withColumnsRenamed({"_part": "_range", "group": "_group"})
    same = (F.col("_part") == F.col("_range")) & F.col("group").eqNullSafe(F.col("_group"))
    nodes = rows.join(small_side(of_range, ranges.count()), same).select(
        "tree", "n", (F.col("_number") - F.col("first")).alias("place"), "digest", "row"
    )
    return nodes, trees.select("tree", "group")


def _parents(level: Column) -> Column:
    """The next level's string: hashes of substrings of ``FAN`` digests."""
    width = FAN * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda k: F.sha2(F.substring(level, k * width + 1, F.lit(width)), 256)), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per aligned block: its nodes in order, its levels as strings, and its top.

    A tree of more than one block goes on above it, so its blocks have all levels; a tree that is
    one block ends where one node is left, and a single node is its own top.
    """
    block = F.floor(F.col("place") / SPAN).alias("block")
    in_order = F.array_sort(F.collect_list(F.struct("place", "digest", "row")))
    grouped = nodes.groupBy("tree", "n", block).agg(in_order.alias("nodes"))
    height = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        height = F.when(F.col("n") <= FAN**k, k).otherwise(height)
    leveled = grouped.withColumns({"height": height, "level0": F.array_join("nodes.digest", "")})
    for k in range(LEVELS):
        above = F.when(F.col("height") > k, _parents(F.col(f"level{k}")))
        leveled = leveled.withColumn(f"level{k + 1}", above)
    top = F.coalesce(*[F.col(f"level{k}") for k in reversed(range(LEVELS + 1))])
    return leveled.select(
        "tree", "n", "block", "height", F.col("nodes.row").alias("rows"),
        *[f"level{k}" for k in range(LEVELS)], top.alias("top"),
    )


def _siblings(level: Column, place: Column) -> Column:
    """The digests left and right of a node in its run of ``FAN``: two substrings of its level."""
    run = F.shiftleft(F.shiftright(place, 4), 4)
    return F.struct(
        F.substring(level, run * HEX + 1, (place - run) * HEX).alias("left"),
        F.substring(level, (place + 1) * HEX + 1, (run + FAN - 1 - place) * HEX).alias("right"),
    )


def _nodes_with_proofs(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """``(tree, place, digest, row, proof, ...)`` of the nodes, from the proofs of their blocks."""
    own = blocks if above is None else blocks.join(above, ["tree", "block"])
    known = [] if above is None else [c for c in above.columns if c not in ("tree", "block")]

    def node(k: Column) -> Column:
        levels = [_siblings(F.col(f"level{j}"), F.shiftright(k, 4 * j)) for j in range(LEVELS)]
        return F.struct(
            (F.col("block") * SPAN + k).alias("place"),
            F.substring("level0", k * HEX + 1, F.lit(HEX)).alias("digest"),
            F.get("rows", k).alias("row"),
            F.slice(F.array(*levels), F.lit(1), F.col("height")).alias("own"),
        )

    places = F.sequence(F.lit(0), F.size("rows") - 1)
    listed = own.select("tree", "top", *known, F.inline(F.transform(places, node)))
    proof = F.col("own") if above is None else F.concat("own", "proof")
    root = F.col("top") if "root" not in known else F.col("root")
    return listed.select(
        "tree", "place", "digest", "row", proof.alias("proof"), root.alias("root"),
        *[c for c in known if c not in ("proof", "root")],
    )


@dataclass
class Manifest:
    """Stored tables of blocks, leaves first, and those of the tree over the groups' roots."""

    leaves: list[DataFrame]
    roots: list[DataFrame]
    groups: DataFrame


def _grown(nodes: DataFrame, folder: str, name: str) -> list[DataFrame]:
    """Tables of blocks, each over the tops of the one before, until all trees are one block."""
    spark, tables = nodes.sparkSession, []
    while True:
        path = f"{folder}/{name}-{len(tables)}"
        _blocks(nodes).write.parquet(path)
        blocks = spark.read.parquet(path)
        tables.append(blocks)
        if (blocks.agg(F.max("n")).first()[0] or 0) <= SPAN:
            return tables
        nodes = blocks.select(
            "tree", F.ceil(F.col("n") / SPAN).alias("n"), F.col("block").alias("place"), F.col("top").alias("digest"),
            F.lit(None).cast("int").alias("row"),
        )


def build_manifest(
    docs: DataFrame,
    folder: str,
    fields: tuple[str, ...] = DOCUMENT_FIELDS,
    group: str = "source",
    order: str = "doc_id",
    row: Column | None = None,
) -> Manifest:
    """Writes the manifest of ``docs`` below ``folder``; ``row`` is kept with each leaf (by default the order column)."""
    leaves = docs.select(
        F.col(group).cast("string").alias("group"), F.col(order).alias("order"),
        leaf_of([F.col(c) for c in fields]).alias("digest"), (F.col(order) if row is None else row).alias("row"),
    )
    nodes, trees = _in_trees(leaves)
    trees.write.parquet(f"{folder}/groups")
    tables = _grown(nodes, folder, "leaves")
    tops = tables[-1].select(
        F.lit(0).alias("tree"), F.lit(trees.count()).cast("long").alias("n"), F.col("tree").alias("place"),
        F.col("top").alias("digest"), F.lit(None).cast("int").alias("row"),
    )
    return Manifest(tables, _grown(tops, folder, "roots"), docs.sparkSession.read.parquet(f"{folder}/groups"))


def open_manifest(spark: SparkSession, folder: str, n_leaves: int, n_roots: int) -> Manifest:
    """A manifest written before, of so many tables of blocks."""
    leaves = [spark.read.parquet(f"{folder}/leaves-{k}") for k in range(n_leaves)]
    roots = [spark.read.parquet(f"{folder}/roots-{k}") for k in range(n_roots)]
    return Manifest(leaves, roots, spark.read.parquet(f"{folder}/groups"))


def proofs(manifest: Manifest) -> DataFrame:
    """``(tree, place, digest, row, proof, subroot, root)`` of every leaf.

    ``proof`` lists, from the leaf to the root, the siblings left and right of the path; blocks
    meet the proofs of their tops before they are opened, so no leaf is shuffled.
    """
    above = None
    for blocks in reversed(manifest.roots):
        opened = _nodes_with_proofs(blocks, above)
        above = opened.select("tree", F.col("place").alias("block"), "proof", "root")
    # The last table of leaves has one block per tree, block 0; it is node ``tree`` of the tree above.
    above = above.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "proof", "root")
    above = above.join(manifest.leaves[-1].select("tree", F.col("top").alias("subroot")), "tree")
    for blocks in reversed(manifest.leaves):
        opened = _nodes_with_proofs(blocks, above)
        above = opened.select("tree", F.col("place").alias("block"), "proof", "root", "subroot")
    return opened


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered_leaf(fields: tuple[str, ...] = DOCUMENT_FIELDS, text: str = "text") -> Column:
    """The leaf a row has once the capitals A to Z of its text are lower case."""
    return leaf_of([lower_ascii(F.col(c)) if c == text else F.col(c) for c in fields])


def verify_tampered(docs: DataFrame, folder: str, tampered: Column) -> DataFrame:
    """Builds the manifest of ``docs``, changes the ``tampered`` rows, and folds every row to a root again.

    Result: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    row = F.struct(F.col("doc_id"), F.when(tampered, tampered_leaf()).alias("changed"))
    found = proofs(build_manifest(docs, folder, row=row))
    folded = found.withColumn("folded_root", fold(F.coalesce("row.changed", "digest"), F.col("proof")))
    return folded.select(
        "row.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
