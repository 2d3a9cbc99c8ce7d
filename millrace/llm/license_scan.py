"""License notices in texts, edited copies included, by votes for diagonals.

All runs of ``GRAM`` words of all texts are hashed and joined to the places of the same runs in the
notices.  A pair of places votes for a diagonal, the difference of the two: a copy votes for one,
words put in or left out move the rest to one close by.  Diagonals at most ``NEAR`` apart are taken together, their places
are cut into spans wherever more than ``GAP`` words lie between them, and a span counts if it holds
``LEAST_SHARE`` of the notice's words and at least ``LEAST_DENSITY`` of its own words are the notice's.

Words are compared after their hashes, so no chance match counts.  A null text is empty and a text
without a notice gets empty labels.  Rows are told apart by a number of their own, so ids may be null or repeat.  Further
columns take no part.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.license_texts import NOTICES, PHRASES
from millrace.llm.merkle import lower_ascii
from millrace.session import materialize, small_side

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4
NEAR = 4
GAP = 16
LEAST_SHARE = 0.6
LEAST_DENSITY = 0.6
WORDS = [f"w{k}" for k in range(GRAM)]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def notice_places(spark: SparkSession, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per distinct run of ``GRAM`` words: ``gram, words, places``, a place being ``(notice, label, size, at)``."""
    given = spark.createDataFrame([(k, *n) for k, n in enumerate(notices)], "notice int, label string, text string")
    listed = given.select("notice", "label", words_of(F.col("text")).alias("ws")).filter(F.size("ws") >= GRAM)
    placed = listed.select(
        "notice", "label", "ws", F.size("ws").alias("size"), F.explode(F.sequence(F.lit(0), F.size("ws") - GRAM)).alias("at")
    )
    words = [F.get("ws", F.col("at") + k).alias(w) for k, w in enumerate(WORDS)]
    place = F.struct("notice", "label", "size", "at")
    return placed.select("notice", "label", "size", "at", *words).groupBy(*WORDS).agg(
        F.collect_list(place).alias("places")
    ).select(F.xxhash64(*WORDS).alias("gram"), *[F.col(w).alias(f"t_{w}") for w in WORDS], "places")


def phrase_label(phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """The label of the phrase that starts at a word, null if none does; phrases have ``GRAM`` words at most."""
    found = F.lit(None).cast("string")
    for label, phrase in phrases:
        same = [F.col(w) == word for w, word in zip(WORDS, phrase.split(), strict=False)]
        both = same[0]
        for s in same[1:]:
            both = both & s
        found = F.when(both, F.lit(label)).otherwise(found)
    return found


def scan_places(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored places of all texts where a phrase or a run of a notice stands, and the first place of every text.

    Columns: ``_row, doc_id, n_words, at, phrase, places``.  The texts are read and cut into words once; the
    runs are neither shuffled nor stored.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("ws")
    )
    size = F.size("ws")
    shifted = [F.slice("ws", F.lit(k + 1), size).alias(w) for k, w in enumerate(WORDS)]
    runs = rows.select(
        "_row", "doc_id", size.cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "run")
    ).select("_row", "doc_id", "n_words", "at", *[F.col(f"run.{w}").alias(w) for w in WORDS])
    hashed = runs.withColumns({"gram": F.when(F.col(WORDS[-1]).isNotNull(), F.xxhash64(*WORDS)), "phrase": phrase_label()})
    same = F.lit(True)
    for w in WORDS:
        same = same & (F.col(w) == F.col(f"t_{w}"))
    side = small_side(notices.withColumnRenamed("gram", "_gram"), notices.count())
    met = hashed.join(side, (F.col("gram") == F.col("_gram")) & same, "left")
    kept = met.filter(F.col("places").isNotNull() | F.col("phrase").isNotNull() | F.col("at").isNull() | (F.col("at") == 0))
    return materialize(kept.select("_row", "doc_id", "n_words", "at", "phrase", "places"), "license-places")


def notice_spans(places: DataFrame) -> DataFrame:
    """Verified spans: ``_row, notice, label, first, last, share``."""
    hits = places.filter(F.col("places").isNotNull()).select("_row", F.col("at").alias("pos"), F.inline("places")).withColumn(
        "diagonal", F.col("pos") - F.col("at")
    )
    copy = ["_row", "notice"]
    votes = hits.groupBy(*copy, "label", "size", "diagonal").agg(F.collect_list("pos").alias("pos"))
    by_diagonal = Window.partitionBy(*copy).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    banded = votes.withColumn("_new", F.when(apart <= NEAR, 0).otherwise(1)).withColumn("band", F.sum("_new").over(by_diagonal))
    in_band = banded.select(*copy, "label", "size", "band", "diagonal", F.explode("pos").alias("pos"))
    by_place = Window.partitionBy(*copy, "band").orderBy("pos", "diagonal")
    ahead = F.col("pos") - F.lag("pos").over(by_place)
    cut = in_band.withColumn("_new", F.when(ahead <= GAP, 0).otherwise(1)).withColumn("span", F.sum("_new").over(by_place))
    covered = F.explode(F.sequence(F.lit(0), F.lit(GRAM - 1))).alias("k")
    spread = cut.select(*copy, "label", "size", "band", "span", "diagonal", "pos", covered)
    span = [*copy, "label", "size", "band", "span"]
    word = F.col("pos") + F.col("k")
    found = spread.groupBy(*span).agg(
        F.min(word).alias("first"), F.max(word).alias("last"),
        F.count_distinct(word).alias("own"), F.count_distinct(word - F.col("diagonal")).alias("known"),
    )
    share = F.col("known") / F.col("size")
    dense = F.col("own") / (F.col("last") - F.col("first") + 1) >= LEAST_DENSITY
    return found.filter((share >= LEAST_SHARE) & dense).select(*copy, "label", "first", "last", share.alias("share"))


def license_scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    The score is the largest share of a notice's words that a verified span holds, 1 where a phrase stands, else 0.
    """
    places = scan_places(docs, notice_places(docs.sparkSession, notices), id_col, text_col)
    based = F.col("phrase").isNotNull()
    facts = places.groupBy("_row", "doc_id", "n_words").agg(
        F.count_if(based).alias("n_base"),
        F.min(F.when(based, F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(based, F.col("at"))).cast("long").alias("last_word"),
        F.collect_set("phrase").alias("base"),
    )
    found = notice_spans(places).groupBy("_row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    both = F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return facts.join(found, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"), score.alias("score"),
    )
