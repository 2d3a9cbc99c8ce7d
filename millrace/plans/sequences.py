"""Queries over token sequences: encoding, packing, shards and the feed order."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.tokenizers import VOCAB_SIZE
from millrace.operators.clean import encode
from millrace.operators.feed import (
    assign_ranks,
    assign_workers,
    batches_per_rank,
    feed_plan,
    shard_seeds,
    step_plan,
    tokens_consumed,
)
from millrace.operators.pack import (
    assign_shards,
    corpus_stats,
    out_of_range,
    pack,
    sequence_counts,
    sequence_offset,
    shard_plan,
    to_examples,
    token_offsets,
)
from millrace.operators.scatter import shard_pieces, store_runs, token_starts
from millrace.plans.documents import MEASURED, WORDS, cleaned, measured, raw_documents
from millrace.plans.registry import query
from millrace.session import materialize, scratch_path
from millrace.sources.feed_reader import read_feed
from millrace.sources.manifest import prune_ignored, shard_triples
from millrace.sources.shards import read_shards, shard_catalog, validate_shards, write_shards

SEQ_LEN = 256
LONG_LEN = 2_048
PER_SHARD = 50
WORLD, WORKERS, BATCH, ACCUMULATION, EPOCHS = 2, 4, 8, 4, 2


def encoded(spark, sf_dir):
    """Documents as token ids, stored: packing reads the lengths before the ids."""
    docs = encode(cleaned(spark, sf_dir), WORDS).withColumn("plan_order", plan_order())
    return materialize(docs.drop("text_norm"), "encoded")


def plan_order():
    return F.regexp_extract("domain", r"(\d+)", 1).cast("int")


def survivors(spark, sf_dir):
    return measured(spark, sf_dir).filter("survivor")


def ordered_counts(docs):
    counts = sequence_counts(docs, SEQ_LEN)
    return counts.withColumn(
        "source_order", F.regexp_extract("source", r"(\d+)", 1).cast("int")
    )


def planned_shards(docs):
    return materialize(shard_plan(ordered_counts(docs), PER_SHARD), "shard-plan")


def sharded(spark, sf_dir):
    docs = encoded(spark, sf_dir)
    plan = planned_shards(docs)
    packed = pack(docs, SEQ_LEN)
    n_shards = plan.agg(F.sum(F.ceil(F.col("n_sequences") / PER_SHARD))).first()[0]
    return assign_shards(packed, plan, plan.count(), PER_SHARD), n_shards


def source_shards(spark, sf_dir):
    """One shard per source: its plan order is the shard id."""
    return ordered_counts(survivors(spark, sf_dir)).select(
        F.col("source_order").alias("shard_id"), F.col("n_sequences").alias("num_sequences")
    )


def digest(tokens="tokens"):
    return F.md5(F.array_join(F.col(tokens).cast("array<string>"), ","))


# Ids, offsets and sequences one token at a time, in SQL.
WORD_ID = f"CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {VOCAB_SIZE - 3} + 3 AS BIGINT)"
IDS = f"""{MEASURED},
kept AS (SELECT * FROM m WHERE survivor),
ids AS (SELECT domain, plan_order, doc_seq, n_tokens,
  list_transform(string_split(text_norm, ' '), lambda w: {WORD_ID}) AS ids FROM kept),
offsets AS (SELECT domain, plan_order, doc_seq, n_tokens + 2 AS framed_len,
  coalesce(sum(n_tokens + 2) OVER (PARTITION BY domain ORDER BY doc_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  coalesce(sum(n_tokens + 2) OVER (ORDER BY plan_order, doc_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS global_start FROM kept)"""


def packed_sql(length: int, start: str = "start", source: str = "domain") -> str:
    return f"""{IDS},
framed AS (
  SELECT {source} AS source, {start} AS start,
         list_concat([1::BIGINT], ids, [2::BIGINT]) AS ids
  FROM ids JOIN offsets USING (domain, doc_seq)),
tokens AS (
  SELECT source, CAST(start AS BIGINT) + i - 1 AS p, ids[i] AS id
  FROM (SELECT source, start, ids, unnest(range(1, len(ids) + 1)) AS i FROM framed)),
packed AS (
  SELECT source, p // {length} AS seq, list(id ORDER BY p) AS real, count(*) AS n_real
  FROM tokens GROUP BY ALL),
padded AS (
  SELECT source, seq, n_real,
    list_concat(real, list_transform(range({length} - n_real), lambda x: 0::BIGINT)) AS tokens
  FROM packed)"""


DIGEST = "md5(array_to_string(tokens, ','))"
COUNTS = f"""{MEASURED},
counts AS (SELECT domain AS source, plan_order,
  CAST(ceil(sum(n_tokens + 2) / {SEQ_LEN}.0) AS BIGINT) AS n FROM m WHERE survivor GROUP BY ALL)"""
SHARD_PLAN = f"""first AS (
  SELECT source, n, CAST(coalesce(sum((n + {PER_SHARD - 1}) // {PER_SHARD}) OVER (ORDER BY plan_order
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_shard FROM counts)"""
SEQUENCES = f"""{COUNTS}, {SHARD_PLAN},
seqs AS (SELECT source, n, first_shard, unnest(range(n)) AS seq FROM first),
sharded AS (
  SELECT source, seq, CAST(first_shard + seq // {PER_SHARD} AS INTEGER) AS shard_id,
         seq % {PER_SHARD} AS seq_in_shard,
         CAST(least({PER_SHARD}, n - seq // {PER_SHARD} * {PER_SHARD}) AS BIGINT) AS num_sequences
  FROM seqs)"""


@query(f"""WITH {IDS} SELECT domain, doc_seq, CAST(n_tokens AS BIGINT) AS n_tokens,
  md5(array_to_string(list_concat([1::BIGINT], ids, [2::BIGINT]), ',')) AS framed_md5 FROM ids""")
def token_encode(spark, sf_dir):
    framed = F.concat(F.array(F.lit(1)), F.col("ids"), F.array(F.lit(2)))
    return encoded(spark, sf_dir).select(
        "domain",
        "doc_seq",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join(framed.cast("array<string>"), ",")).alias("framed_md5"),
    )


@query(f"""WITH {IDS}
SELECT domain, doc_seq, framed_len, CAST(start AS BIGINT) AS start FROM offsets""")
def token_start_offsets(spark, sf_dir):
    return token_offsets(survivors(spark, sf_dir)).select(
        "domain", "doc_seq", "framed_len", "start"
    )


@query(f"""WITH {IDS}
SELECT domain, doc_seq, framed_len, CAST(global_start AS BIGINT) AS start FROM offsets""")
def token_start_offsets_global(spark, sf_dir):
    docs = survivors(spark, sf_dir).withColumn("plan_order", plan_order())
    return token_offsets(docs, scope="global").select("domain", "doc_seq", "framed_len", "start")


def _packed(spark, sf_dir, **how):
    packed = pack(encoded(spark, sf_dir), **how)
    return packed.select(
        "source", "seq", F.col("n_real").cast("long").alias("n_real"), digest().alias("tokens_md5")
    )


@query(f"""WITH {packed_sql(SEQ_LEN)}
SELECT source, seq, n_real, {DIGEST} AS tokens_md5 FROM padded""")
def pack_sequences(spark, sf_dir):
    return _packed(spark, sf_dir, seq_len=SEQ_LEN)


@query(f"""WITH {packed_sql(SEQ_LEN)}
SELECT source, seq, n_real, {DIGEST} AS tokens_md5 FROM padded WHERE n_real = {SEQ_LEN}""")
def pack_drop_tail(spark, sf_dir):
    return _packed(spark, sf_dir, seq_len=SEQ_LEN, tail="drop")


@query(f"""WITH {packed_sql(LONG_LEN)}
SELECT source, seq, n_real, {DIGEST} AS tokens_md5 FROM padded""")
def pack_long_context(spark, sf_dir):
    return _packed(spark, sf_dir, seq_len=LONG_LEN)


@query(f"""WITH {packed_sql(SEQ_LEN, "global_start", "'all'")}
SELECT source, seq, n_real, {DIGEST} AS tokens_md5 FROM padded""")
def pack_across_sources(spark, sf_dir):
    return _packed(spark, sf_dir, seq_len=SEQ_LEN, scope="global")


@query(f"""WITH {SEQUENCES}
SELECT source, seq, shard_id, seq_in_shard, num_sequences,
       36 + 4 * {SEQ_LEN} * seq_in_shard AS byte_offset FROM sharded""")
def shard_assignment(spark, sf_dir):
    rows, _ = sharded(spark, sf_dir)
    return rows.select(
        "source", "seq", "shard_id", "seq_in_shard", "num_sequences",
        sequence_offset(F.col("seq_in_shard"), SEQ_LEN).alias("byte_offset"),
    )


@query(f"""WITH {packed_sql(SEQ_LEN)}
SELECT source, seq,
  md5(array_to_string(tokens[1:{SEQ_LEN - 1}], ',')) AS input_md5,
  md5(array_to_string(list_transform(tokens[2:{SEQ_LEN}],
      lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',')) AS labels_md5
FROM padded""")
def training_examples(spark, sf_dir):
    examples = to_examples(pack(encoded(spark, sf_dir), SEQ_LEN))
    return examples.select(
        "source", "seq", digest("input_ids").alias("input_md5"), digest("labels").alias("labels_md5")
    )


@query(f"""WITH {packed_sql(SEQ_LEN)}
SELECT source, seq, CAST(len(list_filter(tokens, lambda x: x >= 65536)) AS INTEGER) AS n_bad
FROM padded""")
def token_range_check(spark, sf_dir):
    """Against half the vocabulary, so that there is something to find."""
    packed = pack(encoded(spark, sf_dir), SEQ_LEN)
    return packed.select("source", "seq", out_of_range(F.col("tokens"), 65_536).alias("n_bad"))


@query(f"""WITH {COUNTS}, s AS (
  SELECT unnest(range((n + {PER_SHARD - 1}) // {PER_SHARD})) AS k, n FROM counts),
l AS (SELECT least({PER_SHARD}, n - k * {PER_SHARD}) AS num_sequences FROM s)
SELECT count(*) AS n_shards, CAST(sum(num_sequences) AS BIGINT) AS n_sequences,
  CAST(sum(num_sequences * {SEQ_LEN}) AS BIGINT) AS n_tokens,
  CAST(sum(36 + 4 * num_sequences * {SEQ_LEN}) AS BIGINT) AS n_bytes FROM l""")
def shard_corpus_stats(spark, sf_dir):
    """Statistics of shards that were written, from their catalog."""
    return corpus_stats(shard_catalog(spark, written_shards(spark, sf_dir)))


def written_shards(spark, sf_dir):
    path = scratch_path(spark, "shards")
    rows, n_shards = sharded(spark, sf_dir)
    write_shards(rows, path, n_shards, PER_SHARD * SEQ_LEN * 4)
    return path


SHARD_BODIES = f"""WITH {packed_sql(SEQ_LEN)},
counts AS (SELECT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS plan_order,
                  count(*) AS n FROM padded GROUP BY ALL), {SHARD_PLAN},
named AS (SELECT CAST(first_shard + seq // {PER_SHARD} AS INTEGER) AS number,
                 seq % {PER_SHARD} AS seq_in_shard, {DIGEST} AS tokens_md5
          FROM padded JOIN first USING (source))
SELECT format('shard_{{:03d}}', number) AS shard, seq_in_shard, tokens_md5 FROM named"""


@query(SHARD_BODIES)
def shard_roundtrip(spark, sf_dir):
    """Packed sequences written as shard files and read back."""
    back = read_shards(spark, written_shards(spark, sf_dir))
    return back.select("shard", "seq_in_shard", digest().alias("tokens_md5"))


@query(SHARD_BODIES)
def shard_scatter(spark, sf_dir):
    """The same files from documents whose ids went straight to their shards."""
    docs = encoded(spark, sf_dir).withColumn("framed_len", (F.col("n_tokens") + 2).cast("long"))
    plan = planned_shards(docs)
    n_shards = plan.agg(F.sum(F.ceil(F.col("n_sequences") / PER_SHARD))).first()[0]
    pieces = shard_pieces(token_starts(store_runs(docs, "runs-of-ids")), plan, SEQ_LEN, PER_SHARD)
    path = scratch_path(spark, "scattered")
    write_shards(pieces, path, n_shards, PER_SHARD * SEQ_LEN * 4)
    return read_shards(spark, path).select("shard", "seq_in_shard", digest().alias("tokens_md5"))


@query(f"""WITH {SEQUENCES}
SELECT DISTINCT format('shard_{{:03d}}', shard_id) AS shard,
  unnest(['magic', 'header_size', 'index_present', 'meta_present', 'file_size', 'index_entries',
          'counts_agree', 'id_range']) AS rule, true AS ok
FROM sharded""")
def shard_validation(spark, sf_dir):
    """All rules hold for shards the writer made."""
    return validate_shards(spark, written_shards(spark, sf_dir), VOCAB_SIZE)


@query(f"""WITH {SEQUENCES}
SELECT DISTINCT format('shard_{{:03d}}', shard_id) AS shard, seq_in_shard,
  36 + 4 * {SEQ_LEN} * seq_in_shard AS byte_offset, CAST({SEQ_LEN} AS BIGINT) AS length FROM sharded""")
def shard_index(spark, sf_dir):
    entries = read_shards(spark, written_shards(spark, sf_dir), part="index")
    return entries.select("shard", "seq_in_shard", F.col("offset").alias("byte_offset"), "length")


@query("""WITH f AS (
  SELECT format('out/shard_{:05d}', doc_id) AS stem, doc_id FROM documents)
SELECT stem, doc_id % 7 <> 0 AS has_index, doc_id % 11 <> 0 AS has_meta FROM f""")
def shard_sidecars(spark, sf_dir):
    """A listing derived from the documents, with index and meta files missing."""
    i = F.col("doc_seq")
    suffixes = F.array(
        F.lit(".bin"), F.when(i % 7 != 0, ".idx"), F.when(i % 11 != 0, ".meta"), F.lit(".log")
    )
    files = (
        raw_documents(spark, sf_dir)
        .select(F.format_string("out/shard_%05d", i).alias("stem"), F.explode(suffixes).alias("s"))
        .filter(F.col("s").isNotNull())
        .select(F.concat("stem", "s").alias("rel_path"))
    )
    return shard_triples(files)


@query("""WITH f AS (
  SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN 'logs/' WHEN 1 THEN '' WHEN 2 THEN 'a/state/'
    WHEN 3 THEN 'a/logs_old/' ELSE 'a/b/locks/' END,
    split_part(regexp_replace(url, '^https?://', ''), '?', 1), '/state') AS rel_path FROM pages)
SELECT page_id, rel_path FROM f
WHERE NOT list_has_any(string_split(rel_path, '/')[:-2], ['locks', 'logs', 'state'])""")
def manifest_filter(spark, sf_dir):
    """Paths derived from page addresses, with ignored folders at several depths."""
    k = F.col("page_id") % 5
    folder = (
        F.when(k == 0, "logs/").when(k == 1, "").when(k == 2, "a/state/")
        .when(k == 3, "a/logs_old/").otherwise("a/b/locks/")
    )
    address = F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("?"), F.lit(1))
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.concat(folder, address, F.lit("/state")).alias("rel_path")
    )
    return prune_ignored(files)


# Feed order: one shard per source, numbered by plan order.
SPLIT = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rank ORDER BY shard_id) - 1 AS place,
         count(*) OVER (PARTITION BY rank) AS n_rank_shards FROM shards),
split AS (
  SELECT *, CAST(least(place // greatest(1, n_rank_shards // {WORKERS}), {WORKERS - 1}) AS INTEGER)
    AS worker FROM numbered)"""
LAYOUT = f"""{COUNTS},
shards AS (SELECT plan_order AS shard_id, n AS num_sequences,
                  CAST(plan_order % {WORLD} AS INTEGER) AS rank FROM counts),
{SPLIT}"""
ORDERED = f"""positions AS (SELECT *, 42 + worker + 1000 * shard_id AS shard_seed,
                unnest(range(num_sequences)) AS seq_in_shard FROM split),
streamed AS (
  SELECT *, row_number() OVER (PARTITION BY rank, worker ORDER BY shard_id,
      md5(concat_ws(':', shard_seed, shard_id, seq_in_shard)), seq_in_shard) - 1 AS nth,
    count(*) OVER (PARTITION BY rank, worker) AS n_worker FROM positions),
batched AS (
  SELECT rank, worker, shard_id, seq_in_shard, nth // {BATCH} AS batch_in_worker,
         CAST(nth % {BATCH} AS INTEGER) AS row_in_batch
  FROM streamed WHERE nth // {BATCH} < n_worker // {BATCH}),
feed AS (
  SELECT *, dense_rank() OVER (PARTITION BY rank ORDER BY batch_in_worker, worker) - 1
    AS batch_in_rank FROM batched)"""
FEED = f"{LAYOUT}, {ORDERED}"
STEPS = f"""{FEED},
sizes AS (SELECT rank, max(batch_in_rank) + 1 AS n_batches FROM feed GROUP BY rank),
micro AS (
  SELECT rank, n_batches, unnest(range({EPOCHS} * (SELECT max(n_batches) FROM sizes)
    // {ACCUMULATION} * {ACCUMULATION})) AS ordinal FROM sizes),
steps AS (
  SELECT rank, ordinal, ordinal // {ACCUMULATION} + 1 AS step,
         CAST(ordinal % {ACCUMULATION} AS INTEGER) AS micro, ordinal // n_batches AS epoch,
         ordinal % n_batches AS batch_in_rank FROM micro)"""


@query(f"WITH {LAYOUT} SELECT shard_id, num_sequences, rank FROM split")
def rank_assignment(spark, sf_dir):
    return assign_ranks(source_shards(spark, sf_dir), WORLD)


@query(f"""WITH {LAYOUT}
SELECT shard_id, rank, worker, 42 + worker + 1000 * shard_id AS shard_seed FROM split""")
def worker_split(spark, sf_dir):
    split = assign_workers(assign_ranks(source_shards(spark, sf_dir), WORLD), WORKERS)
    return shard_seeds(split).select("shard_id", "rank", "worker", "shard_seed")


@query(f"""WITH {FEED}
SELECT rank, worker, shard_id, seq_in_shard, batch_in_worker, row_in_batch, batch_in_rank FROM feed""")
def feed_order(spark, sf_dir):
    return feed_plan(source_shards(spark, sf_dir), WORLD, WORKERS, BATCH)


@query(f"""WITH {packed_sql(SEQ_LEN)},
counts AS (SELECT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS plan_order,
                  count(*) AS n FROM padded GROUP BY ALL), {SHARD_PLAN},
placed AS (SELECT CAST(first_shard + seq // {PER_SHARD} AS INTEGER) AS shard_id,
                  seq % {PER_SHARD} AS seq_in_shard, tokens FROM padded JOIN first USING (source)),
shards AS (SELECT shard_id, count(*) AS num_sequences, CAST(shard_id % {WORLD} AS INTEGER) AS rank
           FROM placed GROUP BY shard_id), {SPLIT}, {ORDERED}
SELECT rank, worker, batch_in_rank, row_in_batch, shard_id, seq_in_shard,
  md5(array_to_string(tokens[1:{SEQ_LEN - 1}], ',')) AS input_md5,
  md5(array_to_string(list_transform(tokens[2:{SEQ_LEN}],
      lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',')) AS labels_md5
FROM feed JOIN placed USING (shard_id, seq_in_shard)""")
def feed_examples(spark, sf_dir):
    """Written shards read back as a job of several ranks takes them."""
    feed = read_feed(spark, written_shards(spark, sf_dir), WORLD, WORKERS, BATCH)
    digests = {"input_md5": digest("input_ids"), "labels_md5": digest("labels")}
    return feed.withColumns(digests).drop("input_ids", "labels")


@query()
def feed_order_exact(spark, sf_dir):
    """With the NumPy generator's permutation per shard, which SQL cannot give."""
    return feed_plan(source_shards(spark, sf_dir), WORLD, WORKERS, BATCH, shuffle="exact")


@query(f"""WITH {FEED}
SELECT rank, batch_in_rank, worker, batch_in_worker, count(*) AS n_rows,
       md5(string_agg(concat(shard_id, ':', seq_in_shard), ',' ORDER BY row_in_batch)) AS rows_md5
FROM feed GROUP BY ALL""")
def batch_plan(spark, sf_dir):
    feed = feed_plan(source_shards(spark, sf_dir), WORLD, WORKERS, BATCH)
    members = F.array_sort(
        F.collect_list(F.struct("row_in_batch", F.concat_ws(":", "shard_id", "seq_in_shard").alias("k")))
    )
    return (
        feed.groupBy("rank", "batch_in_rank", "worker", "batch_in_worker")
        .agg(F.count("*").alias("n_rows"), members.alias("m"))
        .withColumn("rows_md5", F.md5(F.array_join("m.k", ",")))
        .drop("m")
    )


def _steps(spark, sf_dir):
    """As many whole steps as two epochs of the longest rank hold."""
    batches = materialize(batches_per_rank(source_shards(spark, sf_dir), WORLD, WORKERS, BATCH), "batches")
    longest = batches.agg(F.max("n_batches")).first()[0]
    return step_plan(batches, WORLD, EPOCHS * longest // ACCUMULATION, ACCUMULATION)


@query(f"WITH {STEPS} SELECT * FROM steps")
def step_ledger(spark, sf_dir):
    return _steps(spark, sf_dir)


@query(f"""WITH {STEPS}
SELECT rank, step, micro, CAST(sum({BATCH * (SEQ_LEN - 1) * WORLD}) OVER (
  PARTITION BY rank ORDER BY ordinal) AS BIGINT) AS tokens FROM steps""")
def tokens_consumed_by_step(spark, sf_dir):
    counted = tokens_consumed(_steps(spark, sf_dir), WORLD, BATCH, SEQ_LEN)
    return counted.select("rank", "step", "micro", "tokens")
