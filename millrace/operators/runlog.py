"""Training run logs: parsing, interval means and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import CHUNK_BITS, previous_row
from millrace.session import materialize

# The line a run prints at each log interval.
LINE = (
    r"^\[Rank(\d+)\]\s+(?:(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),(\d{3})\s+\w+\s+)?"
    r"Step\s+(\d+)/(\d+) \| Loss (\S+) \| Aux (\S+) \| GradNorm (\S+) \| "
    r"LR (\S+) \| (\S+)K tok/s \| (\S+)s/step.*$"
)
N_FIELDS = 11

# Ranges the documentation calls healthy.
AUX_RANGE = (0.5, 1.5)
GRAD_NORM_RANGE = (0.5, 5.0)
GRAD_NORM_CLIP = 1.0


def parse_run_log(lines: DataFrame, text: str = "text") -> DataFrame:
    """Typed columns of the step lines; other lines are dropped.

    One regex pass turns a line into its fields.  It is the input of a generator
    so that the optimizer does not repeat it for every column taken from it.
    """
    others = [c for c in lines.columns if c != text]
    row = F.concat_ws("\x1f", *[F.lit(f"${i + 1}") for i in range(N_FIELDS)])
    fields = F.split(F.regexp_replace(F.col(text), F.lit(LINE), row), "\x1f")
    split = lines.select(*others, F.stack(F.lit(1), fields).alias("_f")).filter(
        F.size("_f") == N_FIELDS
    )

    def field(i):
        return F.col("_f")[i]

    stamp = F.when(field(1) != "", F.concat(field(1), F.lit("."), field(2)))
    return split.select(
        *others,
        field(0).cast("int").alias("rank"),
        stamp.try_cast("timestamp_ntz").alias("at"),
        field(3).cast("long").alias("step"),
        field(4).cast("long").alias("max_steps"),
        field(5).try_cast("double").alias("loss"),
        field(6).try_cast("double").alias("aux"),
        field(7).try_cast("double").alias("grad_norm"),
        field(8).try_cast("double").alias("lr"),
        (field(9).try_cast("double") * 1000).alias("tok_per_s"),
        field(10).try_cast("double").alias("s_per_step"),
    )


def interval_means(steps: DataFrame, values: list[str], group: list[str], every: int = 10) -> DataFrame:
    """Means over each run of ``every`` steps, labelled with the interval's last step.

    Intervals that are not complete are not reported, as the log line is printed
    at their end.  A step that a resumed run logs again counts once, with the mean of its
    rows.
    """
    end = (F.floor((F.col("step") - 1) / every) + 1) * every
    once = steps.groupBy(*group, "step").agg(*[F.avg(v).alias(v) for v in values])
    return (
        once.groupBy(*group, end.alias("log_step"))
        .agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("_n"))
        .filter(F.col("_n") == every)
        .drop("_n")
    )


def health(log: DataFrame, group: list[str], bits: int = CHUNK_BITS) -> DataFrame:
    """Flags per log line; ``log`` is parsed and has one line per group and step.

    The columns are stored first: the search for earlier rows reads them several times, and lines are parsed once.
    """
    log = materialize(log.select(*group, "step", "aux", "loss", "grad_norm"), "log")
    before = previous_row(log, group, "step", ["loss", "grad_norm"], bits)
    return before.select(
        *group,
        "step",
        F.col("aux").between(*AUX_RANGE).alias("aux_ok"),
        (F.col("aux") == 0).alias("aux_zero"),
        F.col("grad_norm").between(*GRAD_NORM_RANGE).alias("grad_ok"),
        F.coalesce(
            (F.col("grad_norm") == GRAD_NORM_CLIP) & (F.col("prev_grad_norm") == GRAD_NORM_CLIP),
            F.lit(False),
        ).alias("grad_stuck"),
        F.coalesce(F.col("loss") >= F.col("prev_loss"), F.lit(False)).alias("loss_not_falling"),
    )


def interval_throughput(log: DataFrame, group: list[str], bits: int = CHUNK_BITS) -> DataFrame:
    """Tokens per second between consecutive log rows, from counters.

    ``log`` has ``(step, tokens, seconds)``; differences, so work done before a
    restart does not count.  A group's first row has no interval.  The columns are stored first, as
    in :func:`health`.
    """
    log = materialize(log.select(*group, "step", "tokens", "seconds"), "log")
    before = previous_row(log, group, "step", ["tokens", "seconds"], bits)
    elapsed = F.col("seconds") - F.col("prev_seconds")
    return before.filter(F.col("prev_tokens").isNotNull()).select(
        *group,
        "step",
        F.when(elapsed > 0, (F.col("tokens") - F.col("prev_tokens")) / elapsed)
        .otherwise(F.lit(0.0))
        .alias("tok_per_s"),
    )
