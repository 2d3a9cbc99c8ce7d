"""Collection state: what each domain has collected and where it stands.

The ledger is an append-only parquet table with one partition per ``batch_id``;
rewriting a batch replaces it, so a repeated batch counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


LEDGER_SCHEMA = (
    "domain string, tokens_added long, docs_written long, docs_skipped long, "
    "survivors long, resume_seq long, ts double, batch_id long"
)

_POSITION = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("shard_idx", "sample_idx", "dataset_index", "file_pos")]
)

STATE_JSON_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("domain_progress", T.MapType(T.StringType(), T.LongType())),
        T.StructField("domain_resume_info", T.MapType(T.StringType(), _POSITION)),
        T.StructField("domain_plan", T.MapType(T.StringType(), T.LongType())),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("last_save_time", T.DoubleType()),
        T.StructField("last_save_tokens", T.LongType()),
    ]
)


def append_ledger(rows: DataFrame, path: str, batch_id: int) -> None:
    """Writes one batch of ledger rows; a second write of the same batch replaces it."""
    columns = [c for c in rows.columns if c != "batch_id"]
    rows.select(*columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All ledger rows; an absent ledger is an empty one."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def load_ledger(plan: DataFrame, ledger: DataFrame, all_domains: bool = False) -> DataFrame:
    """State per plan domain: ``(domain, done_tokens, survivors, resume_seq)``.

    Plan domains without ledger rows start at zero, before their first document.
    Ledger domains that have left the plan vanish, unless ``all_domains`` keeps their rows:
    their tokens still count towards a target over all domains.
    """
    state = ledger.groupBy("domain").agg(
        F.sum("tokens_added").alias("done_tokens"),
        F.sum("survivors").alias("survivors"),
        F.max("resume_seq").alias("resume_seq"),
    )
    return plan.select("domain").join(state, "domain", "full" if all_domains else "left").select(
        "domain",
        F.coalesce("done_tokens", F.lit(0)).alias("done_tokens"),
        F.coalesce("survivors", F.lit(0)).alias("survivors"),
        F.coalesce("resume_seq", F.lit(-1)).alias("resume_seq"),
    )


def read_state_json(spark: SparkSession, path: str) -> DataFrame:
    """The JSON state file as one row, times and totals included."""
    return spark.read.schema(STATE_JSON_SCHEMA).option("multiLine", True).json(path)


def load_state_json(spark: SparkSession, plan: DataFrame, path: str, all_domains: bool = False) -> DataFrame:
    """State per plan domain from a JSON state file.

    With ``all_domains`` the rows of domains outside the plan are kept, and tokens of the total that no
    listed domain accounts for are a row with a null domain: all of them count towards a target.

    Version ``v5`` carries positions: documents consumed for streamed domains,
    the last stored document for bounded ones.  Older files keep their totals and
    lose the positions.  ``plan`` needs ``domain`` and ``bounded``.
    """
    state = read_state_json(spark, path)
    progress = state.select("version", F.explode("domain_progress").alias("domain", "done_tokens"))
    positions = state.select(F.explode("domain_resume_info").alias("domain", "at"))
    joined = (
        plan.select("domain", "bounded")
        .join(progress, "domain", "full" if all_domains else "left")
        .join(positions, "domain", "left")
    )
    done = F.coalesce("done_tokens", F.lit(0))
    last_seen = F.when(
        F.col("bounded"), F.when(done > 0, F.col("at.dataset_index"))
    ).otherwise(F.col("at.sample_idx") - 1)
    loaded = joined.select(
        "domain",
        done.alias("done_tokens"),
        F.coalesce(F.when(F.col("version") == "v5", last_seen), F.lit(-1)).alias("resume_seq"),
    )
    if not all_domains:
        return loaded
    listed = F.aggregate(F.map_values("domain_progress"), F.lit(0).cast("long"), lambda total, n: total + n)
    rest = state.select(
        F.lit(None).cast("string").alias("domain"), (F.col("total_tokens") - listed).alias("done_tokens"),
        F.lit(-1).cast("long").alias("resume_seq"),
    )
    return loaded.unionByName(rest.filter("done_tokens > 0"))


def resume_info(bounded, seen):
    """Where a domain goes on, as the JSON files say it; ``seen`` is its last ingested document, -1 for none."""
    return F.struct(
        F.lit(0).alias("shard_idx"),
        F.when(bounded, 0).otherwise(seen + 1).alias("sample_idx"),
        F.when(bounded, F.greatest(seen, F.lit(0))).otherwise(seen + 1).alias("dataset_index"),
        F.lit(0).alias("file_pos"),
    )


def state_json(plan: DataFrame, state: DataFrame, start_time: float, now: float) -> DataFrame:
    """The state of all plan domains as one JSON document (column ``json``).

    Rows of ``state`` outside the plan count in the total only.
    """
    planned = plan.select("domain", "quota", "bounded").withColumn("planned", F.lit(True))
    joined = planned.join(state.select("domain", "done_tokens", "resume_seq"), "domain", "full")
    done = F.coalesce("done_tokens", F.lit(0))
    position = resume_info(F.col("bounded"), F.coalesce("resume_seq", F.lit(-1)))

    def as_map(value):
        return F.map_from_entries(F.collect_list(F.when(F.col("planned"), F.struct("domain", value))))

    return joined.agg(
        F.sum(done).alias("total_tokens"),
        as_map(done.alias("v")).alias("domain_progress"),
        as_map(position.alias("v")).alias("domain_resume_info"),
        as_map(F.col("quota").alias("v")).alias("domain_plan"),
    ).select(
        F.to_json(
            F.struct(
                F.lit("v5").alias("version"),
                "total_tokens",
                "domain_progress",
                "domain_resume_info",
                "domain_plan",
                F.lit(start_time).alias("start_time"),
                F.lit(now).alias("last_save_time"),
                F.col("total_tokens").alias("last_save_tokens"),
            )
        ).alias("json")
    )
