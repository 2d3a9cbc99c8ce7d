"""Queries over run and progress logs that Spark derives from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import human_time
from millrace.operators.progress import stalls, throughput
from millrace.operators.runlog import (
    health,
    interval_means,
    interval_throughput,
    parse_run_log,
)
from millrace.plans.registry import query
from millrace.session import spread

TARGET = 50_000_000


def events(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")


def micros(column="ts"):
    """Microseconds since 2024-01-01 00:00, in whichever zone the table was read."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return F.unix_micros(F.col(column).cast("timestamp")) - F.unix_micros(start)


MICROS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"


def run_log_lines(spark, sf_dir):
    """A printed line per event, broken off where the event's value is below one."""
    i = F.col("event_id")
    line = F.format_string(
        "[Rank%d] %s,%s INFO Step %6d/%d | Loss %.4f | Aux %.4f | GradNorm %.2f | LR %.2e | "
        "%.1fK tok/s | %.1fs/step",
        i % 4,
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.date_format("ts", "SSS"),
        (F.floor(i / 4) + 1) * 10,
        F.lit(1_000_000),
        (i * 7919 % 100_000) / 10_000.0,
        F.when(i % 13 == 0, 0.0).otherwise((i * 31 % 20_000) / 10_000.0),
        F.when(F.col("event_type") == "error", 1.0).otherwise((i * 17 % 700) / 100.0),
        (i % 900 + 100) * 1e-6,
        (i % 500) / 10.0,
        (i % 300) / 10.0,
    )
    return events(spark, sf_dir).select(
        F.when(F.col("value") < 1, F.substring(line, 1, 60)).otherwise(line).alias("text")
    )


LOG = """log AS (
  SELECT CAST(event_id % 4 AS INTEGER) AS rank,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at_text,
    (event_id // 4 + 1) * 10 AS step, CAST(1000000 AS BIGINT) AS max_steps,
    (event_id * 7919 % 100000) / 10000.0::DOUBLE AS loss,
    CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE (event_id * 31 % 20000) / 10000.0 END::DOUBLE AS aux,
    CASE WHEN event_type = 'error' THEN 1.0 ELSE (event_id * 17 % 700) / 100.0 END::DOUBLE AS grad_norm,
    CAST(concat(event_id % 900 + 100, 'e-6') AS DOUBLE) AS lr,
    (event_id % 500) / 10.0::DOUBLE * 1000 AS tok_per_s,
    (event_id % 300) / 10.0::DOUBLE AS s_per_step
  FROM events WHERE value >= 1)"""


@query(f"WITH {LOG} SELECT * FROM log")
def run_log_parse(spark, sf_dir):
    parsed = parse_run_log(run_log_lines(spark, sf_dir))
    return parsed.withColumn("at_text", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS")).drop("at")


@query(f"""WITH {LOG}, p AS (
  SELECT *, lag(loss) OVER w AS prev_loss, lag(grad_norm) OVER w AS prev_grad
  FROM log WINDOW w AS (PARTITION BY rank ORDER BY step))
SELECT rank, step, aux BETWEEN 0.5 AND 1.5 AS aux_ok, aux = 0 AS aux_zero,
  grad_norm BETWEEN 0.5 AND 5.0 AS grad_ok,
  coalesce(grad_norm = 1.0 AND prev_grad = 1.0, false) AS grad_stuck,
  coalesce(loss >= prev_loss, false) AS loss_not_falling FROM p""")
def run_health(spark, sf_dir):
    return health(parse_run_log(run_log_lines(spark, sf_dir)), ["rank"], bits=8)


@query("""WITH s AS (
  SELECT user_id % 3 AS run, event_id // 3 + 1 AS step, event_id % 3 AS part,
         (event_id * 7919 % 4096) / 64.0::DOUBLE AS loss FROM events),
one AS (SELECT part AS run, step, loss FROM s)
SELECT run, ((step - 1) // 10 + 1) * 10 AS log_step, avg(loss) AS loss
FROM one GROUP BY ALL HAVING count(*) = 10""")
def run_interval_means(spark, sf_dir):
    i = F.col("event_id")
    steps = events(spark, sf_dir).select(
        (i % 3).alias("run"),
        (F.floor(i / 3) + 1).alias("step"),
        ((i * 7919 % 4096) / 64.0).alias("loss"),
    )
    return interval_means(steps, ["loss"], ["run"], 10)


@query(f"""WITH l AS (
  SELECT event_id % 2 AS run, event_id AS step, event_id * 4096 AS tokens, {MICROS} / 1e6 AS seconds
  FROM events),
p AS (SELECT *, lag(tokens) OVER w AS t0, lag(seconds) OVER w AS s0
      FROM l WINDOW w AS (PARTITION BY run ORDER BY step))
SELECT run, step, CASE WHEN seconds > s0 THEN (tokens - t0) / (seconds - s0) ELSE 0.0 END AS tok_per_s
FROM p WHERE t0 IS NOT NULL""")
def run_interval_throughput(spark, sf_dir):
    i = F.col("event_id")
    log = events(spark, sf_dir).select(
        (i % 2).alias("run"), i.alias("step"), (i * 4096).alias("tokens"),
        (micros() / 1e6).alias("seconds"),
    )
    return interval_throughput(log, ["run"], bits=8)


HUMAN = """CASE WHEN {s} < 0 THEN 'N/A'
  WHEN trunc({s}) >= 86400 THEN format('{{}}d {{}}h {{}}m', trunc({s})::BIGINT // 86400,
       trunc({s})::BIGINT % 86400 // 3600, trunc({s})::BIGINT % 3600 // 60)
  WHEN trunc({s}) >= 3600 THEN format('{{}}h {{}}m', trunc({s})::BIGINT // 3600,
       trunc({s})::BIGINT % 3600 // 60)
  ELSE format('{{}}m {{}}s', trunc({s})::BIGINT // 60, trunc({s})::BIGINT % 60) END"""


@query(f"SELECT event_id, {HUMAN.format(s='((value - 1.0) * 1000.0)')} AS text FROM events")
def human_time_text(spark, sf_dir):
    seconds = (F.col("value") - 1.0) * 1000.0
    return events(spark, sf_dir).select("event_id", human_time(seconds).alias("text"))


@query(f"""WITH s AS (
  SELECT event_id, event_id * 5000 AS total, {MICROS} / 1e6 AS elapsed FROM events),
r AS (SELECT *, {TARGET} - total AS remaining_tokens,
        CASE WHEN elapsed > 0 THEN total / elapsed ELSE 0.0 END AS tokens_per_sec FROM s),
e AS (SELECT *, CASE WHEN tokens_per_sec > 0 THEN remaining_tokens / tokens_per_sec ELSE -1.0 END
        AS eta_seconds FROM r)
SELECT event_id, remaining_tokens, tokens_per_sec, eta_seconds,
       {HUMAN.format(s='eta_seconds')} AS eta_human FROM e""")
def throughput_eta(spark, sf_dir):
    """Events as a log of a running total; below the target and past it."""
    log = events(spark, sf_dir).select(
        "event_id", (F.col("event_id") * 5000).alias("total"), (micros() / 1e6).alias("elapsed")
    )
    rates = throughput(F.col("total"), F.col("elapsed"), TARGET)
    return log.select("event_id", *[c.alias(n) for n, c in rates.items()])


def progress_log(spark, sf_dir):
    """A running total per event type that grows every twelve hours."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("domain"),
        (micros() / 1e6).alias("ts"),
        (F.floor(micros() / 43_200_000_000) * 1_000).alias("total_tokens"),
    )


STALL_SECONDS = 7_200
PROGRESS = f"""log AS (
  SELECT event_type AS domain, {MICROS} / 1e6 AS ts,
         {MICROS} // 43200000000 * 1000 AS total_tokens FROM events),
gains AS (SELECT *, min(ts) OVER (PARTITION BY domain, total_tokens) AS last_gain FROM log)"""


@query(f"""WITH {PROGRESS}
SELECT domain, total_tokens, last_gain, min(ts) AS warned_at FROM gains
WHERE ts - last_gain > {STALL_SECONDS} GROUP BY ALL""")
def stall_detection(spark, sf_dir):
    return stalls(progress_log(spark, sf_dir), STALL_SECONDS)
