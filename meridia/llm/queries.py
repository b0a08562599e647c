"""The ten corpus queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import arrowseq, bestfit, bigru, bpefst, hilbert, jaccard, quality, substrings, tiff, urllists

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as TIFF in layouts of all kinds; digests of the samples read back, of all pages of a file."""
    docs = _table(spark, sf_dir, "documents")
    stored = tiff.texts_to_tiff(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    stored = stored.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = tiff.join_pages(tiff.tiff_pages(stored))
    size = F.octet_length("pixels")
    tail = F.expr("substring(pixels, octet_length(pixels) - 63, 64)")
    feature = F.concat_ws("|", F.concat(F.col("width"), F.lit("x"), F.col("height")), F.format_string("%08x", F.crc32("pixels")), F.hex(F.expr("substring(pixels, 1, 4)")))
    return pages.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), F.col("page").alias("pages"), "width", "height", "compression", "predictor", "tiled")


def op2_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in Arrow stream files of 1024-id rows, read back by document."""
    back = arrowseq.token_files(spark, _table(spark, sf_dir, "documents"), WORD_BPE)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _dated_list(pages: DataFrame) -> DataFrame:
    """The dated list of op3, by a rule from the hosts of all pages: a quarter of them are added some
    time in the year, a third of these removed 60 days later and half of those added again after 30
    more; with them a domain for the second quarter and a folder of every fourth host."""
    hosts = pages.select(urllists.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    n = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda shift: F.date_add(F.lit("2024-01-01").cast("date"), n % 200 + shift)
    event = lambda kind, value, shift, action: F.struct(F.lit(kind).alias("kind"), value.alias("value"), day(shift).alias("listed_on"), F.lit(action).alias("action"))
    host = F.col("host")
    added = F.array(event("host", host, 0, "add"), event("folder", F.concat(host, F.lit("/en")), 20, "add"))
    gone = F.when(n % 3 == 0, F.array(event("host", host, 60, "remove")))
    back = F.when(n % 6 == 0, F.array(event("host", host, 90, "add")))
    none = F.slice(added, 1, 0)
    events = hosts.where(n % 4 == 0).select(F.explode(F.concat(added, F.coalesce(gone, none), F.coalesce(back, none))).alias("e")).select("e.*")
    fixed = pages.sparkSession.createDataFrame([("domain", "example.net", "2024-04-01", "add"), ("domain", "example.net", "2024-07-01", "remove")], "kind string, value string, listed_on string, action string")
    return events.union(fixed.withColumn("listed_on", F.to_date("listed_on")))


def op3_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day of 2024 that follows from its id, against the list as of that day."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("page_id") * 37, F.lit(366))).cast("int")))
    return urllists.evaluate(captures, _dated_list(pages))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS h,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/', 1), '') AS folder,
         DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_on FROM pages),
c AS (SELECT page_id, url, regexp_replace(h, '\.$', '') AS host, folder, fetched_on FROM p),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n FROM c WHERE host IS NOT NULL),
events AS (
  SELECT 'host' AS kind, host AS value, DATE '2024-01-01' + n % 200 AS d, 'add' AS action FROM hosts WHERE n % 4 = 0
  UNION ALL SELECT 'folder', host || '/en', DATE '2024-01-01' + (n % 200 + 20), 'add' FROM hosts WHERE n % 4 = 0
  UNION ALL SELECT 'host', host, DATE '2024-01-01' + (n % 200 + 60), 'remove' FROM hosts WHERE n % 4 = 0 AND n % 3 = 0
  UNION ALL SELECT 'host', host, DATE '2024-01-01' + (n % 200 + 90), 'add' FROM hosts WHERE n % 4 = 0 AND n % 6 = 0
  UNION ALL VALUES ('domain', 'example.net', DATE '2024-04-01', 'add'), ('domain', 'example.net', DATE '2024-07-01', 'remove')),
daily AS (SELECT kind, value, d, max(action) AS action FROM events GROUP BY ALL),
spans AS (SELECT *, lead(d) OVER (PARTITION BY kind, value ORDER BY d) AS valid_to FROM daily),
keys AS (
  SELECT page_id, url, host, fetched_on, 'host' AS kind, host AS value FROM c
  UNION ALL SELECT page_id, url, host, fetched_on, 'folder', host || '/' || folder FROM c WHERE folder IS NOT NULL
  UNION ALL SELECT page_id, url, host, fetched_on, 'domain',
      unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) FROM c WHERE host IS NOT NULL),
met AS (
  SELECT k.page_id, k.url, k.host, k.fetched_on, s.kind AS kind, s.value AS value FROM keys k
  LEFT JOIN spans s ON s.action = 'add' AND s.kind = k.kind AND s.value = k.value AND s.d <= k.fetched_on AND (s.valid_to IS NULL OR k.fetched_on < s.valid_to))
SELECT page_id, host, fetched_on, count(DISTINCT kind || ':' || value) AS n_active, count(kind) > 0 AS blocked,
       arg_max(kind || ':' || value, (CASE kind WHEN 'folder' THEN 3 WHEN 'host' THEN 2 ELSE 1 END) * 1000000 + length(value)) FILTER (WHERE kind IS NOT NULL) AS reason
FROM met GROUP BY page_id, url, host, fetched_on
"""


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    found = jaccard.jaccard_components(spark, _table(spark, sf_dir, "documents"), jaccard.Threshold(85, 100, 4))
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 2048 tokens."""
    return bestfit.packed(spark, _table(spark, sf_dir, "documents"), WORD_BPE, 2048, 0)


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels that aren't held out."""
    return quality.quality_scores(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by the byte network, trained on those that aren't held out."""
    return bigru.language_of(spark, _table(spark, sf_dir, "documents"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE by the transducer, and the ids decoded again."""
    return bpefst.bpe_round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each vector whose id is divisible by 100, among all vectors."""
    return hilbert.nearest(spark, _table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 20-word windows that start earlier as well."""
    kept = substrings.without_repeats(spark, _table(spark, sf_dir, "documents"), 20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS sig FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, sig) AS class_id FROM sets),
own AS (SELECT sh.doc_id, s, n FROM sh JOIN cls USING (doc_id) WHERE sh.doc_id = class_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, other) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT r.node, e.v FROM reach r JOIN both_ways e ON e.u = r.other),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node), deg AS (SELECT u, count(*) AS k FROM both_ways GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, class_id, d.doc_id) AS component_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(k, 0) AS n_links
FROM d LEFT JOIN cls USING (doc_id) LEFT JOIN root ON node = class_id LEFT JOIN deg ON deg.u = class_id
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
marked AS (SELECT words.doc_id, k, word, max(i) OVER (PARTITION BY words.doc_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN again ON again.doc_id = words.doc_id AND again.i = words.k),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_arrow_sequences": op2_arrow_sequences,
    "op3_temporal_list_join": op3_temporal_list_join,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_pairwise_quality": op6_pairwise_quality,
    "op7_byte_gru": op7_byte_gru,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_hilbert_neighbours": op9_hilbert_neighbours,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES: dict[str, str] = {"op3_temporal_list_join": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op10_substring_dedup": OP10_SQL}
