"""Queries over the documents: cleaning, counting, duplicates, budgets, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import normalize_text
from millrace.functions.tokenizers import SentencePieceTokenizer, WordTokenizer
from millrace.operators.clean import clean, count_tokens, drop_uncounted, measure
from millrace.operators.dedup import dedup_exact, skip_ingested
from millrace.operators.key_index import append_keys, first_unseen, with_key
from millrace.operators.ledger import append_ledger, load_ledger, read_ledger, state_json
from millrace.operators.order import with_doc_seq
from millrace.operators.progress import (
    mixture_summary,
    progress,
    progress_report,
    token_totals,
    with_grand_total,
)
from millrace.operators.quota import accounting, apply_quota, batch_sums
from millrace.plans.mixture import plan_from_documents
from millrace.plans.registry import query
from millrace.session import materialize, scratch_path, spread
from millrace.sources.corpora import Corpus, read_line_docs, scan_corpora, write_line_docs
from millrace.sources.paths import open_fs

WORDS = WordTokenizer()
QUOTA = 10_000
BATCH = 7
TARGET = 150_000
PROGRESS_TARGET = 1_000_000


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("source").alias("domain"), F.col("doc_id").alias("doc_seq"), "lang", "text"
    )
    return spread(docs, "doc_seq")


def cleaned(spark, sf_dir):
    return clean(raw_documents(spark, sf_dir))


def stored_clean(spark, sf_dir):
    """Cleaned and counted documents, stored: the state between collecting and the rest."""
    docs = count_tokens(cleaned(spark, sf_dir), WORDS)
    return materialize(docs.withColumn("n_tokens", F.col("n_tokens").cast("long")), "clean")


def measured(spark, sf_dir):
    """The narrow table that budgets work on, stored."""
    return materialize(measure(raw_documents(spark, sf_dir).drop("lang"), WORDS), "measured")


def planned(spark, sf_dir, quota=QUOTA, batch=BATCH):
    return materialize(plan_from_documents(raw_documents(spark, sf_dir), quota, batch), "plan")


def fixture_ledger(plan: DataFrame) -> DataFrame:
    """Earlier progress by plan position: some complete, some begun, some new."""
    k = F.col("plan_order")
    return plan.select(
        "domain",
        F.when(k % 4 == 0, 10_000).when(k % 4 == 1, k * 100 + 1).otherwise(0).cast("long")
        .alias("tokens_added"),
        F.lit(0).cast("long").alias("docs_written"),
        F.lit(0).cast("long").alias("docs_skipped"),
        F.when(k % 4 == 1, 21).otherwise(0).cast("long").alias("survivors"),
        F.when(k % 4 == 1, k * 10).otherwise(-1).cast("long").alias("resume_seq"),
        F.lit(0.0).alias("ts"),
    ).filter(k % 4 != 3)


# The documents as the queries see them, cleaned and counted, in SQL.
BLANKS = (
    r"[\x{00}\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
RAW = r"""raw AS (
  SELECT source AS domain, CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) AS plan_order,
         doc_id AS doc_seq, lang, text FROM documents)"""
MEASURED = f"""{RAW},
normed AS (
  SELECT *, CASE WHEN length(text) >= 200
                 THEN trim(regexp_replace(substr(text, 1, 200000), '{BLANKS}', ' ', 'g')) END AS norm0
  FROM raw),
m AS (
  SELECT domain, plan_order, doc_seq, lang,
         CASE WHEN length(norm0) >= 200 THEN norm0 END AS text_norm,
         coalesce(length(norm0) >= 200, false) AS survivor,
         CAST(CASE WHEN length(norm0) >= 200 THEN len(string_split(norm0, ' ')) ELSE 0 END
              AS BIGINT) AS n_tokens
  FROM normed)"""
LEDGER = f"""ledger AS (
  SELECT domain, plan_order,
         CAST(CASE plan_order % 4 WHEN 0 THEN 10000 WHEN 1 THEN plan_order * 100 + 1 ELSE 0 END
              AS BIGINT) AS done_tokens,
         CAST(CASE plan_order % 4 WHEN 1 THEN plan_order * 10 ELSE -1 END AS BIGINT) AS resume_seq
  FROM (SELECT DISTINCT domain, plan_order FROM raw))"""


def scanned_sql(batch: int, target: int | None = None, ledger: bool = False) -> str:
    """CTEs up to ``scanned``: every raw row with the flag whether it was read."""
    done = LEDGER if ledger else (
        "ledger AS (SELECT DISTINCT domain, plan_order, 0 AS done_tokens, "
        "-1 AS resume_seq FROM raw)"
    )
    limit = "" if target is None else f"AND g + pre < {target}"
    return f"""{MEASURED}, {done},
fresh AS (
  SELECT m.*, done_tokens FROM m JOIN ledger USING (domain) WHERE doc_seq > resume_seq),
numbered AS (
  SELECT *, CAST(floor(coalesce(sum(CASE WHEN survivor THEN 1 ELSE 0 END) OVER (
      PARTITION BY domain ORDER BY doc_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / {batch}) AS BIGINT) AS b FROM fresh),
batches AS (SELECT domain, b, sum(n_tokens) AS w FROM numbered GROUP BY ALL),
starts AS (
  SELECT domain, b, coalesce(sum(w) OVER (PARTITION BY domain ORDER BY b
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM batches),
placed AS (SELECT n.*, done_tokens + earlier AS pre FROM numbered n JOIN starts USING (domain, b)),
own AS (
  SELECT l.domain, l.plan_order, l.done_tokens,
         coalesce((SELECT sum(n_tokens) FROM placed p
                   WHERE p.domain = l.domain AND pre < {QUOTA}), 0) AS t
  FROM ledger l),
shifts AS (
  SELECT domain, sum(done_tokens) OVER () - done_tokens
       + coalesce(sum(t) OVER (ORDER BY plan_order
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM own),
scanned AS (
  SELECT p.*, pre < {QUOTA} {limit} AS scanned FROM placed p JOIN shifts USING (domain))"""


KEPT = "SELECT domain, doc_seq, n_tokens FROM scanned WHERE scanned AND n_tokens > 0"


@query(f"""WITH {MEASURED}
SELECT domain, doc_seq, CAST(length(text_norm) AS INTEGER) AS n_chars, md5(text_norm) AS text_md5
FROM m WHERE survivor""")
def clean_documents(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "domain", "doc_seq", F.length("text_norm").alias("n_chars"), F.md5("text_norm").alias("text_md5")
    )


@query(f"""WITH {RAW}
SELECT domain, doc_seq, md5(trim(regexp_replace(substr(text, 1, 200000), '{BLANKS}', ' ', 'g'))) AS text_md5
FROM raw""")
def normalize_documents(spark, sf_dir):
    """Normalisation alone, without the length rules."""
    return raw_documents(spark, sf_dir).select(
        "domain", "doc_seq", F.md5(normalize_text(F.col("text"))).alias("text_md5")
    )


@query(f"""WITH {MEASURED}
SELECT n.domain, count(*) AS n_docs,
  CAST(sum(CASE WHEN n.text IS NULL OR n.text = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
  CAST(sum(CASE WHEN length(n.text) < 200 THEN 1 ELSE 0 END) AS BIGINT) AS n_short_raw,
  CAST(sum(CASE WHEN length(n.text) >= 200 AND length(n.norm0) < 200 THEN 1 ELSE 0 END) AS BIGINT)
    AS n_short_clean,
  CAST(sum(CASE WHEN length(n.text) > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated,
  CAST(sum(CASE WHEN length(n.norm0) >= 200 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
FROM normed n GROUP BY n.domain""")
def length_filter_report(spark, sf_dir):
    raw = raw_documents(spark, sf_dir)
    size = F.length("text")
    normed = raw.withColumn("norm", F.when(size >= 200, normalize_text(F.col("text"))))
    clean_size = F.length("norm")
    return normed.groupBy("domain").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"),
        F.count_if(size < 200).alias("n_short_raw"),
        F.count_if((size >= 200) & (clean_size < 200)).alias("n_short_clean"),
        F.count_if(size > 200_000).alias("n_truncated"),
        F.count_if(clean_size >= 200).alias("n_kept"),
    )


@query(f"WITH {MEASURED} SELECT domain, doc_seq, n_tokens FROM m WHERE survivor")
def token_counts(spark, sf_dir):
    counted = drop_uncounted(count_tokens(cleaned(spark, sf_dir), WORDS))
    return counted.select("domain", "doc_seq", F.col("n_tokens").cast("long").alias("n_tokens"))


@query(f"""WITH {MEASURED}
SELECT domain, count(*) AS n_docs, CAST(sum(strlen(text_norm) + 1) AS BIGINT) AS tokens
FROM m WHERE survivor GROUP BY domain""")
def sentencepiece_counts(spark, sf_dir):
    """Counts by a SentencePiece model through Arrow batches.

    The model knows the printable ASCII characters and falls back to bytes, so
    a text has one piece per byte and one for the word mark in front.
    """
    tokenizer = SentencePieceTokenizer(spark, ascii_model(spark))
    counted = drop_uncounted(count_tokens(cleaned(spark, sf_dir), tokenizer))
    return token_totals(counted)


def ascii_model(spark: SparkSession) -> str:
    """Writes a character-level SentencePiece model and returns its path."""
    import io

    import sentencepiece

    ascii_text = "".join(map(chr, range(0x21, 0x7F)))
    model = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter([ascii_text, f"a {ascii_text}"]),
        model_writer=model,
        model_type="char",
        vocab_size=3 + 256 + 95,
        byte_fallback=True,
        character_coverage=1.0,
        normalization_rule_name="identity",
        hard_vocab_limit=False,
        minloglevel=2,
    )
    folder = scratch_path(spark, "model")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/ascii.model") as f:
        f.write(model.getvalue())
    return f"{folder}/ascii.model"


@query(f"""WITH {MEASURED}, t AS (
  SELECT domain, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS tokens
  FROM m WHERE survivor GROUP BY domain)
SELECT * FROM t UNION ALL
SELECT 'all', CAST(sum(n_docs) AS BIGINT), CAST(sum(tokens) AS BIGINT) FROM t""")
def domain_token_totals(spark, sf_dir):
    return with_grand_total(token_totals(count_tokens(cleaned(spark, sf_dir), WORDS)))


@query(r"""WITH u AS (
  SELECT source AS domain, doc_id AS doc_seq, text FROM documents
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
  UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'untitled', item_id, NULL FROM benchmark)
SELECT domain, count(*) AS n_docs, CAST(sum(doc_seq) AS BIGINT) AS seq_sum, count(text) AS n_texts,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM u GROUP BY domain""")
def corpus_union(spark, sf_dir):
    """Corpora with other field names, a fallback path, a missing field, one that cannot be opened."""
    catalog = [
        Corpus("source", [f"{sf_dir}/documents.parquet"], seq="doc_id", domain_is_expr=True),
        Corpus("benchmark", [f"{sf_dir}/none.parquet", f"{sf_dir}/benchmark.parquet"], seq="item_id"),
        Corpus("pages", [f"{sf_dir}/pages.parquet"], field="html", seq="page_id"),
        Corpus("conversations", [f"{sf_dir}/conversations.parquet"], seq="conv_id * 1000 + turn"),
        Corpus("untitled", [f"{sf_dir}/benchmark.parquet"], field="article", seq="item_id"),
        Corpus("absent", [f"{sf_dir}/absent.parquet"]),
    ]
    docs, _status = scan_corpora(spark, catalog, on_error="skip")
    return docs.groupBy("domain").agg(
        F.count("*").alias("n_docs"),
        F.sum("doc_seq").alias("seq_sum"),
        F.count("text").alias("n_texts"),
        F.sum(F.length("text")).cast("long").alias("n_chars"),
    )


@query("""SELECT 'conversations' AS domain, conv_id, turn,
  CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS doc_seq FROM conversations""")
def document_ordinals(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.lit("conversations").alias("domain"), "conv_id", "turn"
    )
    return with_doc_seq(turns, ["conv_id", "turn"])


@query(f"""WITH {MEASURED}
SELECT domain, md5(text_norm) AS text_md5, count(*) AS n FROM m WHERE survivor GROUP BY ALL""")
def line_docs_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "lines")
    write_line_docs(cleaned(spark, sf_dir), path)
    return (
        read_line_docs(spark, path)
        .groupBy("domain", F.md5("text").alias("text_md5"))
        .agg(F.count("*").alias("n"))
    )


@query(f"""WITH {scanned_sql(BATCH)}
SELECT domain,
  CAST(sum(CASE WHEN scanned AND survivor AND n_tokens > 0 THEN 1 ELSE 0 END) AS BIGINT) AS written,
  CAST(sum(CASE WHEN scanned AND NOT survivor THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
  CAST(sum(CASE WHEN scanned AND survivor AND n_tokens = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_token
FROM scanned GROUP BY domain""")
def document_accounting(spark, sf_dir):
    return accounting(measured(spark, sf_dir), planned(spark, sf_dir))


@query(f"""WITH {MEASURED}
SELECT domain, doc_seq, n_tokens FROM m WHERE survivor
QUALIFY row_number() OVER (PARTITION BY domain, text_norm ORDER BY doc_seq) = 1""")
def dedup_domain(spark, sf_dir):
    return dedup_exact(stored_clean(spark, sf_dir)).select("domain", "doc_seq", "n_tokens")


@query(f"""WITH {MEASURED}
SELECT domain, doc_seq, CAST(1 + (1 - doc_seq % 2) AS INTEGER) AS run FROM m WHERE survivor
QUALIFY row_number() OVER (PARTITION BY domain, text_norm ORDER BY doc_seq % 2 DESC, doc_seq) = 1""")
def dedup_two_runs(spark, sf_dir):
    """Documents of odd numbers, then those of even ones against the keys of the first run."""
    docs = with_key(stored_clean(spark, sf_dir), "domain")
    index, found = scratch_path(spark, "key-index"), []
    for run in (1, 2):
        own = docs.filter(F.col("doc_seq") % 2 == run % 2)
        fresh = materialize(first_unseen(own, index, list(range(1, run)), [F.col("doc_seq")]), "fresh")
        append_keys(fresh, index, run)
        found.append(fresh.select("domain", "doc_seq", F.lit(run).alias("run")))
    return found[0].unionByName(found[1])


@query(f"""WITH {MEASURED}
SELECT domain, doc_seq, n_tokens FROM m WHERE survivor
QUALIFY row_number() OVER (PARTITION BY text_norm ORDER BY plan_order, doc_seq) = 1""")
def dedup_global(spark, sf_dir):
    docs = stored_clean(spark, sf_dir).withColumn(
        "plan_order", F.regexp_extract("domain", r"(\d+)", 1).cast("int")
    )
    return dedup_exact(docs, "global").select("domain", "doc_seq", "n_tokens")


def _kept(spark, sf_dir, batch, target=None, ledger=False):
    table = measured(spark, sf_dir)
    plan = planned(spark, sf_dir, batch=batch)
    state = None
    if ledger:
        state = load_ledger(plan, fixture_ledger(plan))
        table = skip_ingested(table, state)
    return apply_quota(table, table, plan, target, state).select("domain", "doc_seq", "n_tokens")


@query(f"WITH {scanned_sql(1)} {KEPT}")
def quota_docs(spark, sf_dir):
    return _kept(spark, sf_dir, 1)


@query(f"WITH {scanned_sql(BATCH)} {KEPT}")
def quota_batches(spark, sf_dir):
    return _kept(spark, sf_dir, BATCH)


@query(f"WITH {scanned_sql(BATCH, TARGET)} {KEPT}")
def quota_global_target(spark, sf_dir):
    return _kept(spark, sf_dir, BATCH, TARGET)


@query(f"WITH {scanned_sql(BATCH, TARGET, ledger=True)} {KEPT}")
def quota_resume(spark, sf_dir):
    return _kept(spark, sf_dir, BATCH, TARGET, ledger=True)


@query(f"""WITH {RAW}, {LEDGER}
SELECT domain, doc_seq FROM raw JOIN ledger USING (domain) WHERE doc_seq > resume_seq""")
def resume_filter(spark, sf_dir):
    plan = planned(spark, sf_dir)
    state = load_ledger(plan, fixture_ledger(plan))
    return skip_ingested(raw_documents(spark, sf_dir).select("domain", "doc_seq"), state)


@query(f"WITH {RAW}, {LEDGER} SELECT domain, done_tokens, resume_seq FROM ledger")
def ledger_load(spark, sf_dir):
    """Two ledger batches, one written twice, and a domain the plan does not have."""
    plan = planned(spark, sf_dir)
    rows = fixture_ledger(plan).withColumn("tokens_added", F.col("tokens_added") / 2)
    half = rows.withColumn("tokens_added", F.floor("tokens_added"))
    rest = fixture_ledger(plan).withColumn(
        "tokens_added", F.col("tokens_added") - F.floor(F.col("tokens_added") / 2)
    )
    stray = rest.withColumn("domain", F.concat(F.lit("other_"), "domain"))
    path = scratch_path(spark, "ledger")
    append_ledger(half.withColumn("tokens_added", F.lit(99)), path, 1)
    append_ledger(half, path, 1)
    append_ledger(rest.unionByName(stray), path, 2)
    return load_ledger(plan, read_ledger(spark, path)).select("domain", "done_tokens", "resume_seq")


@query(f"""WITH {MEASURED}, t AS (
  SELECT domain, plan_order, CAST(sum(n_tokens) AS BIGINT) AS done_tokens FROM m GROUP BY ALL)
SELECT domain, plan_order, CAST({QUOTA} AS BIGINT) AS quota, done_tokens,
       done_tokens >= {QUOTA} AS complete,
       CAST({PROGRESS_TARGET} - sum(done_tokens) OVER () AS BIGINT) AS remaining_tokens FROM t""")
def plan_progress(spark, sf_dir):
    totals = token_totals(count_tokens(cleaned(spark, sf_dir), WORDS))
    state = totals.withColumnRenamed("tokens", "done_tokens")
    return progress(planned(spark, sf_dir), state, PROGRESS_TARGET)


@query(f"""WITH {MEASURED}, t AS (
  SELECT domain, CAST(sum(n_tokens) AS BIGINT) AS done FROM m GROUP BY ALL),
s AS (SELECT CAST(sum(done) AS BIGINT) AS total_tokens FROM t)
SELECT total_tokens, {PROGRESS_TARGET} - total_tokens AS remaining_tokens,
       total_tokens / 3600.0::DOUBLE AS tokens_per_sec, domain, done AS done_tokens
FROM t, s""")
def progress_report_json(spark, sf_dir):
    """The report is written as JSON and read back."""
    totals = token_totals(count_tokens(cleaned(spark, sf_dir), WORDS))
    state = materialize(totals.withColumnRenamed("tokens", "done_tokens"), "state")
    report = progress_report(planned(spark, sf_dir), state, PROGRESS_TARGET, 3600.0, 0.0)
    path = scratch_path(spark, "report")
    report.select(F.col("json").alias("value")).write.text(path)
    schema = (
        "total_tokens long, remaining_tokens long, tokens_per_sec double, "
        "domain_progress map<string,long>"
    )
    back = spark.read.schema(schema).json(path)
    return back.select(
        "total_tokens",
        "remaining_tokens",
        "tokens_per_sec",
        F.explode("domain_progress").alias("domain", "done_tokens"),
    )


@query(f"""WITH {RAW}, {LEDGER}
SELECT domain, done_tokens, CAST({QUOTA} AS BIGINT) AS quota,
       CASE WHEN resume_seq < 0 THEN 0 ELSE resume_seq + 1 END AS sample_idx FROM ledger""")
def state_export(spark, sf_dir):
    plan = planned(spark, sf_dir).withColumn("bounded", F.lit(False))
    state = load_ledger(plan, fixture_ledger(plan))
    path = scratch_path(spark, "state-json")
    state_json(plan, state, 0.0, 1.0).select(F.col("json").alias("value")).write.text(path)
    schema = (
        "domain_progress map<string,long>, domain_plan map<string,long>, "
        "domain_resume_info map<string,struct<sample_idx:long>>"
    )
    back = spark.read.schema(schema).json(path)
    return back.select(
        "domain_plan", "domain_resume_info",
        F.explode("domain_progress").alias("domain", "done_tokens"),
    ).select(
        "domain",
        "done_tokens",
        F.col("domain_plan")[F.col("domain")].alias("quota"),
        F.col("domain_resume_info")[F.col("domain")]["sample_idx"].alias("sample_idx"),
    )


@query(f"""WITH {MEASURED}, t AS (
  SELECT lang, CASE WHEN plan_order % 3 = 0 THEN 'web' ELSE 'books' END AS kind,
         CAST(sum(n_tokens) AS BIGINT) AS tokens FROM m GROUP BY ALL)
SELECT *, tokens / sum(tokens) OVER () AS share FROM t""")
def mixture_by_label(spark, sf_dir):
    docs = count_tokens(cleaned(spark, sf_dir), WORDS).withColumn(
        "kind",
        F.when(F.regexp_extract("domain", r"(\d+)", 1).cast("int") % 3 == 0, "web").otherwise("books"),
    )
    totals = docs.groupBy("lang", "kind").agg(F.sum("n_tokens").alias("tokens"))
    return mixture_summary(totals, ["lang", "kind"])


@query(f"""WITH {MEASURED}, n AS (
  SELECT domain, n_tokens, row_number() OVER (PARTITION BY domain ORDER BY doc_seq) - 1 AS r
  FROM m WHERE survivor)
SELECT domain, CAST(r // {BATCH} AS BIGINT) AS batch_no, count(*) AS n_docs,
       CAST(sum(n_tokens) AS BIGINT) AS batch_tokens FROM n GROUP BY ALL""")
def batch_token_sums(spark, sf_dir):
    return batch_sums(measured(spark, sf_dir), BATCH)


@query(f"""WITH {scanned_sql(BATCH)}
SELECT domain, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS tokens
FROM scanned WHERE scanned AND n_tokens > 0 GROUP BY domain""")
def quota_summary(spark, sf_dir):
    """Clean, count, cut each source to its budget, and total: the whole way in one."""
    return token_totals(_kept(spark, sf_dir, BATCH))
