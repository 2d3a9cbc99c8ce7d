"""The registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm.collocations import collocations
from millrace.llm.common import held_out
from millrace.llm.context_tree import score_texts
from millrace.llm.decontaminate import contaminated
from millrace.llm.id_archive import read_id_archive, write_id_archive
from millrace.llm.language import fit_languages, predict_languages
from millrace.llm.license_scan import GAP, LEAST_DENSITY, LEAST_SHARE, NEAR, license_scan
from millrace.llm.license_texts import NOTICES, PHRASES
from millrace.llm.line_quality import fit_lines, judge
from millrace.llm.merkle import verify_tampered
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.packing import pack, pieces
from millrace.llm.token_counts import token_counts
from millrace.llm.warc import normalise, read_records, with_revisits, write_monolithic
from millrace.llm.toxicity import fit_toxicity, score_toxicity
from millrace.plans.registry import query
from millrace.session import materialize, scratch_path


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_id_archive(spark, sf_dir):
    folder = scratch_path(spark, "id-archive")
    write_id_archive(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_id_archive(spark, folder)


@query()
def op9_best_fit_packing(spark, sf_dir):
    cut = pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(materialize(cut, "pieces"))


# Base 32 writes five bits a letter: the hexadecimal digest as bits, cut into 32 groups.
@query("""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, hex, octet_length(encode(payload)) AS payload_bytes, list_aggregate(list_transform(range(1, 41),
    lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
      1 + 4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4)), 'string_agg', '') AS bits FROM p),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6),
      lambda j: CASE WHEN substr(bits, 5 * i + j, 1) = '1' THEN 1 << (5 - j) ELSE 0 END))::INT, 1)),
    'string_agg', '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM m""")
def op2_warc(spark, sf_dir):
    html = F.coalesce("html", F.lit("")).cast("binary")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")
    )
    rows = with_revisits(pages, F.col("page_id"), F.col("payload"))
    crawl = materialize(write_monolithic(rows, scratch_path(spark, "crawl")), "crawl-archives")
    index = materialize(normalise(crawl, scratch_path(spark, "warc")), "warc-index")
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op4_decontaminate(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3
    THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""")
def op10_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


@query()
def op6_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit_languages(docs, ~held_out("doc_id", 5, 0))
    predicted = predict_languages(docs, model)
    return predicted.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


TOXIC_FROM = 0.3


@query()
def op5_toxicity(spark, sf_dir):
    docs, held = documents(spark, sf_dir), held_out("doc_id", 4, 2)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    predicted = (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", predicted)


@query()
def op7_line_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return judge(docs, fit_lines(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("content_words")


@query()
def op8_context_tree(spark, sf_dir):
    held = held_out("doc_id", 7, 2)
    scored = score_texts(documents(spark, sf_dir), ~held)
    return scored.select("doc_id", held.alias("held_out"), *scored.columns[1:])


# CRC-32 byte by byte through its table of 256 entries, which follows from the polynomial bit by bit.
MERKLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT)) AS crc),
d AS (
  SELECT doc_id, source, lang, n_chars, text, xor(4294967295, list_reduce(
    list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c // 256, crc[1 + xor(c % 256, b)]), 4294967295::BIGINT)) % 5 = 0 AS tampered FROM documents, t),
f AS (
  SELECT doc_id, source, tampered,
    [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
    [doc_id::VARCHAR, source, lang, n_chars::VARCHAR,
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')] AS w FROM d),
h AS (
  SELECT doc_id, source, tampered,
    sha256(array_to_string(list_transform(v, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '')) AS leaf,
    sha256(array_to_string(list_transform(w, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '')) AS changed
  FROM f),
g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM h)),
l AS (
  SELECT h.*, g.tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n
  FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source),
a AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS h FROM l
  UNION ALL
  SELECT tree, lvl + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM a WHERE n > 1 GROUP BY tree, lvl, n, place // 16),
s AS (SELECT tree, lvl AS height, h AS subroot, count(*) OVER () AS n FROM a WHERE a.n = 1),
b AS (
  SELECT 0 AS lvl, tree AS place, n, subroot AS h FROM s
  UNION ALL
  SELECT lvl + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM b WHERE n > 1 GROUP BY lvl, n, place // 16),
nodes AS (
  SELECT tree, lvl, place, n, h FROM a WHERE n > 1
  UNION ALL SELECT s.tree, s.height + b.lvl, b.place, b.n, b.h FROM s, b WHERE b.n > 1),
runs AS (
  SELECT tree, lvl, place, string_agg(h, '' ORDER BY place) OVER w AS lefts,
    string_agg(h, '' ORDER BY place) OVER (PARTITION BY tree, lvl, place // 16 ORDER BY place
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rights
  FROM nodes WINDOW w AS (PARTITION BY tree, lvl, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT l.doc_id, l.tree, l.leaf, l.place AS own, 0 AS lvl, l.place, '' AS proof,
    CASE WHEN tampered THEN changed ELSE leaf END AS folded FROM l
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.own, c.lvl + 1,
    CASE WHEN c.lvl = s.height THEN c.tree ELSE c.place END // 16,
    c.proof || coalesce(r.lefts, '') || coalesce(r.rights, ''),
    sha256(coalesce(r.lefts, '') || c.folded || coalesce(r.rights, ''))
  FROM c JOIN s USING (tree)
  JOIN runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.place = CASE WHEN c.lvl = s.height THEN c.tree ELSE c.place END),
z AS (SELECT *, row_number() OVER (PARTITION BY tree, own ORDER BY lvl DESC) AS k FROM c)
SELECT doc_id, leaf, subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = (SELECT h FROM b WHERE n = 1) AS verified
FROM z JOIN s USING (tree) WHERE k = 1"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark, sf_dir):
    folder = scratch_path(spark, "manifest")
    return verify_tampered(documents(spark, sf_dir), folder, held_out("doc_id", 5, 0))


@query(r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (
  SELECT lang, doc, unnest(range(len(pieces))) AS piece, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) t(m) WHERE len(ws) >= m),
f AS (SELECT lang, ws[i:i + m - 1] AS ws, m, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 100),
inner_ones AS (
  SELECT lang, ws[1:m - 1] AS ws, f FROM c WHERE m > 2 UNION ALL SELECT lang, ws[2:m] AS ws, f FROM c WHERE m > 2),
o AS (SELECT c.* FROM c ANTI JOIN inner_ones i ON c.lang = i.lang AND c.ws = i.ws AND 100 * i.f >= 100 * c.f),
k AS (SELECT *, unnest(range(1, m)) AS k FROM o),
s AS (
  SELECT k.lang, k.ws, k.k, k.f AS a, l.f AS l, r.f AS r, t.n, (1000 * k.f::HUGEINT * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN t ON k.lang = t.lang
  JOIN f l ON l.lang = k.lang AND l.ws = k.ws[1:k.k] JOIN f r ON r.lang = k.lang AND r.ws = k.ws[k.k + 1:k.m]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS place FROM s),
z AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang
    ORDER BY score DESC, a DESC, encode(array_to_string(ws, ' '))) AS rank FROM b WHERE place = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z WHERE rank <= 2000""")
def op12_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


def _sql_strings(pairs):
    return ", ".join("({}, '{}', '{}')".format(k, label, text.replace("'", "''")) for k, (label, text) in enumerate(pairs))


LICENSE_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
each_word AS (SELECT row, ws, unnest(range(len(ws))) AS pos FROM words),
phrases AS (SELECT label, string_split(p, ' ') AS p FROM (VALUES {_sql_strings(PHRASES)}) t(k, label, p)),
based AS (SELECT row, pos, label FROM each_word JOIN phrases ON ws[pos + 1:pos + len(p)] = p),
base AS (SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(label) AS labels FROM based GROUP BY row),
notices AS (
  SELECT k, label, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM (VALUES {_sql_strings(NOTICES)}) t(k, label, t)),
grams AS (SELECT k, label, len(ws) AS size, ws, unnest(range(len(ws) - 3)) AS tpos FROM notices),
hits AS (
  SELECT row, k, label, size, pos, pos - tpos AS diagonal
  FROM (SELECT row, pos, ws[pos + 1:pos + 4] AS g FROM each_word) a JOIN (SELECT *, ws[tpos + 1:tpos + 4] AS g FROM grams) b USING (g)),
lines AS (SELECT DISTINCT row, k, diagonal FROM hits),
steps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, k ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM lines),
bands AS (SELECT *, sum(fresh) OVER (PARTITION BY row, k ORDER BY diagonal) AS band FROM steps),
ahead AS (
  SELECT h.*, band, CASE WHEN pos - lag(pos) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh
  FROM hits h JOIN bands b USING (row, k, diagonal) WINDOW w AS (PARTITION BY row, k, band ORDER BY pos, diagonal)),
cut AS (SELECT *, sum(fresh) OVER (PARTITION BY row, k, band ORDER BY pos, diagonal) AS span FROM ahead),
spread AS (SELECT *, pos + unnest(range(4)) AS word FROM cut),
spans AS (
  SELECT row, label, count(DISTINCT word - diagonal) / size AS share,
    count(DISTINCT word) / (max(word) - min(word) + 1) AS density
  FROM spread GROUP BY row, k, label, size, band, span),
own AS (
  SELECT row, list(label) AS labels, max(share) AS share FROM spans
  WHERE share >= {LEAST_SHARE} AND density >= {LEAST_DENSITY} GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, own.labels))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(own.share, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (row) LEFT JOIN own USING (row)"""


@query(LICENSE_SQL)
def op13_license_scan(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))
