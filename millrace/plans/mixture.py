"""The corpus mixture: which domains, how many tokens, in what order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_TOKENS = 58_000_000_000
STREAM_BATCH = 4_000

PLAN_SCHEMA = (
    "domain string, plan_order int, field string, bounded boolean, "
    "quota long, batch int, lang string, kind string"
)


@dataclass(frozen=True)
class Domain:
    name: str
    quota: int
    field: str = "text"
    bounded: bool = False
    lang: str | None = None
    kind: str | None = None

    @property
    def batch(self) -> int:
        """Documents between two budget tests: bounded tables are tested per document."""
        return 1 if self.bounded else STREAM_BATCH


# Domains in plan order with token quota, text field and mode.
DEFAULT_DOMAINS = [
    Domain("fineweb_en", 30_000_000_000, "text", False, "English", "Web text"),
    Domain("arxiv_science", 3_500_000_000, "article", False, "English", "Science"),
    Domain("pubmed_science", 2_500_000_000, "article", False, "English", "Medical science"),
    Domain("bookcorpusopen_lit", 676_045_016, "text", True, "English", "Books"),
    Domain("wiki_ko_clean", 2_000_000_000, "text", True, "Korean", "Encyclopedia"),
    Domain("stack_v1_code", 8_000_000_000, "content", False, "Code", "Programming"),
    Domain("korean_webtext", 2_200_000_000, "text", False, "Korean", "Web text"),
    Domain("wanjuan_korean", 3_000_000_000, "content", False, "Korean", "Web text"),
    Domain("cc100_korean", 2_800_000_000, "text", False, "Korean", "Web text"),
    Domain("pg19_literature", 2_000_000_000, "text", False, "English", "Books"),
]


def mixture_plan(spark: SparkSession, domains: list[Domain] = DEFAULT_DOMAINS) -> DataFrame:
    """The plan as a table; list order is plan order."""
    return spark.createDataFrame(
        [
            (d.name, i, d.field, d.bounded, d.quota, d.batch, d.lang, d.kind)
            for i, d in enumerate(domains)
        ],
        PLAN_SCHEMA,
    )


def plan_from_documents(docs: DataFrame, quota: int, batch: int) -> DataFrame:
    """A plan for the domains found in ``docs``, ordered by the number in their name."""
    return docs.select("domain").distinct().select(
        "domain",
        F.regexp_extract("domain", r"(\d+)", 1).cast("int").alias("plan_order"),
        F.lit(quota).cast("long").alias("quota"),
        F.lit(batch).alias("batch"),
    )
