"""Totals, progress against the plan, throughput and stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import human_time
from millrace.operators.ledger import resume_info

STALL_SECONDS = 60


def token_totals(counted: DataFrame) -> DataFrame:
    """Documents and tokens per domain."""
    return counted.groupBy("domain").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")
    )


def with_grand_total(totals: DataFrame, label: str = "all") -> DataFrame:
    """Adds the total over all domains as one more row."""
    total = totals.agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    return totals.unionByName(total.withColumn("domain", F.lit(label)))


def progress(plan: DataFrame, state: DataFrame, target: int) -> DataFrame:
    """Done, quota and remaining per plan domain, and the remainder to the target.

    ``remaining_tokens`` is negative once the target is passed.
    """
    joined = plan.select("domain", "plan_order", "quota").join(
        state.select("domain", "done_tokens"), "domain", "left"
    )
    done = F.coalesce("done_tokens", F.lit(0))
    return joined.select(
        "domain",
        "plan_order",
        "quota",
        done.alias("done_tokens"),
        (done >= F.col("quota")).alias("complete"),
        (F.lit(target) - F.sum(done).over(Window.partitionBy())).alias("remaining_tokens"),
    )


def throughput(total: Column, elapsed: Column, target: int) -> dict[str, Column]:
    """Speed and time to the target from a token total and elapsed seconds."""
    speed = F.when(elapsed > 0, total / elapsed).otherwise(F.lit(0.0))
    remaining = F.lit(target) - total
    eta = F.when(speed > 0, remaining / speed).otherwise(F.lit(-1.0))
    return {
        "remaining_tokens": remaining,
        "tokens_per_sec": speed,
        "eta_seconds": eta,
        "eta_human": human_time(eta),
    }


def progress_report(
    plan: DataFrame, state: DataFrame, target: int, elapsed: float, now: float, resume: bool = False, **extra: str
) -> DataFrame:
    """The progress report as one JSON document (column ``json``).

    With ``resume`` it has ``domain_resume_info`` as well; the plan then needs ``bounded`` and the state
    ``resume_seq``.  Rows of ``state`` outside the plan count in the total only.
    """
    done = F.coalesce("done_tokens", F.lit(0))
    maps = {"domain_progress": done, "domain_plan": F.col("quota")}
    wanted = (["domain", "quota"], ["domain", "done_tokens"])
    if resume:
        maps["domain_resume_info"] = resume_info(F.col("bounded"), F.coalesce("resume_seq", F.lit(-1)))
        wanted = ([*wanted[0], "bounded"], [*wanted[1], "resume_seq"])
    planned = plan.select(*wanted[0]).withColumn("planned", F.lit(True))

    def as_map(value):
        return F.map_from_entries(F.collect_list(F.when(F.col("planned"), F.struct("domain", value.alias("v")))))

    summed = planned.join(state.select(*wanted[1]), "domain", "full").agg(
        F.sum(done).alias("total_tokens"), *[as_map(v).alias(n) for n, v in maps.items()]
    )
    rates = throughput(F.col("total_tokens"), F.lit(float(elapsed)), target)
    return summed.select(
        F.to_json(
            F.struct(
                F.lit("v5").alias("version"),
                F.lit(float(now)).alias("timestamp"),
                "total_tokens",
                F.lit(target).alias("target_tokens"),
                *[c.alias(n) for n, c in rates.items()],
                F.lit(float(elapsed)).alias("elapsed_seconds"),
                *maps,
                *[F.lit(v).alias(k) for k, v in extra.items()],
            )
        ).alias("json")
    )


def mixture_summary(totals: DataFrame, by: list[str]) -> DataFrame:
    """Tokens by language, kind or any other labels, with the share of the whole.

    The window runs over the aggregated rows, one per label combination.
    """
    groups = totals.groupBy(*by).agg(F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy())
    return groups.withColumn("share", F.col("tokens") / whole)


def stalls(log: DataFrame, seconds: int = STALL_SECONDS, salts: int = 16) -> DataFrame:
    """The first log row of each pause that is more than ``seconds`` after the last gain.

    ``log`` has ``(domain, ts double, total_tokens)``, with a row at the start of
    the domain.  ``total_tokens`` never falls, so rows with one value of it are
    one pause, which starts with the gain that reached this value.  That makes the
    search two aggregations; the join between them is salted, because one pause
    may hold most rows of the log.
    """
    pauses = log.groupBy("domain", "total_tokens").agg(F.min("ts").alias("last_gain"))
    spread = pauses.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    late = (
        log.withColumn("_salt", F.pmod(F.xxhash64("ts"), F.lit(salts)).cast("int"))
        .join(spread, ["domain", "total_tokens", "_salt"])
        .filter(F.col("ts") - F.col("last_gain") > seconds)
    )
    return late.groupBy("domain", "total_tokens", "last_gain").agg(F.min("ts").alias("warned_at"))
