"""The registered queries of the text operators, and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, fingerprint, langid, neardup, packing, quality, spans, tokenfile, toxicity, urlfilter
from spanloom.llm.common import fold, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, 3 bits."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through shards of bit planes: start, n_tokens and crc of each."""
    made = tokenfile.token_table(table(spark, sf_dir, "documents"), end_id=0)
    return made.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces of at most 1024 tokens, and their sequences."""
    made = packing.pack(table(spark, sf_dir, "documents"), end_id=2, as_ids=False)
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def captures_and_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures of ``pages`` with a fetch day, and a dated list of hosts.

    The tables have neither days nor a list, so both follow from a rule: page p was fetched
    p * 37 mod 366 days after 2024-01-01. Of the last three labels of every host, those whose md5
    begins with 0 to 3 are listed from a day told by its next digits; if the fifth digit is even
    they are taken off 30 days and more later, and if the sixth is below 4 put back 60 days after.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host <> ''")
    listed = hosts.select(F.substring_index("host", ".", -3).alias("entry")).distinct().withColumn("m", F.md5("entry"))
    for i in (1, 2, 3, 4, 5, 6):
        listed = listed.withColumn(f"d{i}", F.expr(f"instr('0123456789abcdef', substring(m, {i}, 1)) - 1"))
    listed = listed.where("d1 < 4").withColumn("a", F.expr("d2 * 16 + d3")).withColumn("b", F.expr("a + 30 + d4 * 4"))
    day = "date_add(date'2024-01-01', cast({} as int)) as day"
    entries = (
        listed.selectExpr("entry", "'add' as action", day.format("a"))
        .unionByName(listed.where("d5 % 2 = 0").selectExpr("entry", "'remove' as action", day.format("b")))
        .unionByName(listed.where("d5 % 2 = 0 and d6 < 4").selectExpr("entry", "'add' as action", day.format("b + 60")))
    )
    return captures, entries


def op3_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture against the list entries that were active at its fetch day."""
    return urlfilter.active_entries(*captures_and_list(spark, sf_dir))


OP3_SQL = """
WITH caps AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched
  FROM pages),
labels AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM caps WHERE host <> ''),
listed AS (
  SELECT entry, md5(entry) AS m FROM (
    SELECT DISTINCT array_to_string(l[greatest(1, len(l) - 2):len(l)], '.') AS entry FROM labels)),
digits AS (
  SELECT entry, instr('0123456789abcdef', m[2]) * 16 + instr('0123456789abcdef', m[3]) - 17 AS a,
         instr('0123456789abcdef', m[4]) - 1 AS d4, instr('0123456789abcdef', m[5]) - 1 AS d5,
         instr('0123456789abcdef', m[6]) - 1 AS d6
  FROM listed WHERE instr('0123456789abcdef', m[1]) <= 4),
spells AS (
  SELECT entry, a AS since, CASE WHEN d5 % 2 = 0 THEN a + 30 + d4 * 4 END AS until FROM digits
  UNION ALL
  SELECT entry, a + 30 + d4 * 4 + 60, NULL FROM digits WHERE d5 % 2 = 0 AND d6 < 4),
dated AS (
  SELECT entry, CAST(DATE '2024-01-01' + CAST(since AS INTEGER) AS DATE) AS since,
         coalesce(CAST(DATE '2024-01-01' + CAST(until AS INTEGER) AS DATE), DATE '9999-12-31') AS until FROM spells),
hits AS (
  SELECT c.page_id, d.entry, d.since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(d.entry) DESC, d.since) AS rn
  FROM caps c JOIN dated d ON (c.host = d.entry OR ends_with(c.host, '.' || d.entry))
   AND c.fetched >= d.since AND c.fetched < d.until)
SELECT c.page_id, c.host, c.fetched, h.entry IS NOT NULL AS blocked, h.entry, h.since
FROM caps c LEFT JOIN hits h ON h.page_id = c.page_id AND h.rn = 1
"""


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the four folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=fold(F.col("k"), 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents from weak labels alone."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from the two folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, learn=fold(F.col("k"), 3) != 1)
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op8_simhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; n_within: documents within 7 bits, asked for ids divisible by 20."""
    probe = written(fingerprint.edit_probe(table(spark, sf_dir, "documents")), "probe", compression="zstd")
    made = fingerprint.with_counts(probe, F.col("doc_id") % 20 == 0)
    return made.select("doc_id", "n_chars", "edited_sha256", fingerprint.hex_of("w").alias("fingerprint"), fingerprint.hex_of("e").alias("edited_fingerprint"), "near_edited", "near_next", "n_within")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts without the sentence spans (two units and 20 words at least) that an earlier document has; shorter repeated lines stay."""
    return spans.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) pairs: documents that hold a benchmark item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_pivots": op1_simhash_pivots,
        "op2_token_planes": op2_token_planes,
        "op3_temporal_list": op3_temporal_list,
        "op4_nnpu_toxicity": op4_nnpu_toxicity,
        "op5_weak_quality": op5_weak_quality,
        "op6_min_bin_slack": op6_min_bin_slack,
        "op7_subword_langid": op7_subword_langid,
        "op8_simhash_edits": op8_simhash_edits,
        "op9_sentence_spans": op9_sentence_spans,
        "op10_simhash_windows": op10_simhash_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_temporal_list": OP3_SQL}
