"""Queries opN_<name>: each operator over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import bpe, chroma, conversations, divergence, jaccard, langid, lines, packing, pii, pst, quality, suffixes, warc
from rankspark.llm.common import remainder_is, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_records(pages: DataFrame) -> DataFrame:
    """Captures of the pages table: a full response of each page, and a not-modified revisit by another spelling of its URL.

    Every fifth revisit carries another entity tag, every seventh none; the times put about half of them too early.
    """
    page = F.col("page_id")
    base = F.lit(1_700_000_000)
    ours = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.md5("html"), F.lit("date"), (page * 37 % 1000).cast("string"), F.lit("vary"), F.lit("accept"))
    tag = F.when(page % 5 == 0, F.md5("url")).otherwise(F.concat(F.lit("W/"), F.md5("html")))
    theirs = F.create_map(F.lit("etag"), F.when(page % 7 != 0, tag), F.lit("date"), (page * 53 % 1000).cast("string"), F.lit("set-cookie"), F.lit("x"), F.lit("cache-control"), F.lit("max-age=60"))
    full = pages.select((page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (base + page * 37 % 1000 * 3600).alias("at"), F.lit(200).alias("status"), ours.alias("headers"))
    again = F.concat(F.upper(F.substring_index("url", "://", 1)), F.lit("://"), F.substring_index("url", "://", -1), F.lit("#again"))
    return full.unionByName(pages.select((page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), again.alias("url"), (base + page * 53 % 1000 * 3600).alias("at"), F.lit(304).alias("status"), F.map_filter(theirs, lambda _, v: v.isNotNull()).alias("headers")))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "response_id", "canonical_url", "verdict", merged.alias("merged"))


# The table's URLs have no user, port, percent triplet or dot segment; the tests show what becomes of these.
OP1_SQL = r"""
WITH part AS (
  SELECT page_id, md5(html) AS body, md5(url) AS other,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1)), CASE WHEN lower(url) LIKE 'https%' THEN ':443$' ELSE ':80$' END, ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2), '/$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3), '&'), lambda x: x <> '')), '&') AS query
  FROM pages
), page AS (
  SELECT *, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS u FROM part
), asked AS (
  SELECT a.page_id, a.u, max(struct_pack(t := b.page_id * 37 % 1000, id := b.page_id)) AS m
  FROM page a LEFT JOIN page b ON a.u = b.u AND b.page_id * 37 % 1000 < a.page_id * 53 % 1000 GROUP BY a.page_id, a.u
), judged AS (
  SELECT a.page_id, a.u, b.page_id AS full_id, b.body AS ours, CASE WHEN a.page_id % 7 <> 0 THEN CASE WHEN a.page_id % 5 = 0 THEN p.other ELSE p.body END END AS theirs
  FROM asked a JOIN page p ON p.page_id = a.page_id LEFT JOIN page b ON b.page_id = a.m.id
)
SELECT page_id * 2 + 1 AS record_id, full_id * 2 AS response_id, u AS canonical_url,
  CASE WHEN full_id IS NULL THEN 'unresolved' WHEN theirs IS NULL THEN 'unverified' WHEN theirs = ours THEN 'resolved' ELSE 'mismatch' END AS verdict,
  CASE WHEN full_id IS NULL OR theirs <> ours THEN NULL ELSE 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || CAST(page_id * 53 % 1000 AS VARCHAR) || chr(10) ||
    'etag: ' || CASE WHEN theirs IS NULL THEN ours WHEN page_id % 5 = 0 THEN theirs ELSE 'W/' || theirs END || chr(10) || 'vary: accept' END AS merged
FROM judged
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_is("doc_id", 4, 2)
    return langid.identify(docs, ~held_out & F.col("lang").isNotNull()).withColumn("held_out", held_out)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_texts(table(spark, sf_dir, "documents"), ~remainder_is("doc_id", 7, 2))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 200)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Vectors of a recording; samples a second, in a window and between windows of its sound.
VECTORS, RATE, WINDOW, HOP = 32, 4096, 1024, 341


def recordings(vectors: DataFrame) -> DataFrame:
    """(rec_id, audio: 16-bit samples), since no table holds sound: each recording of ``VECTORS`` vectors, 2 * (vec_id / 32).

    All magnitudes, 12 at a time, are the loudness of the 12 semitones from 440 Hz for one hop. The recording after it, of
    an odd id, is an excerpt of 60 to 90 hops from a place of its own, with other loudness and noise.
    """

    def run(batches):
        tones = np.sin(2 * np.pi * 440 * np.outer(2 ** (np.arange(12) / 12), np.arange(HOP * (VECTORS * 64 // 12 + 1))) / RATE)
        for b in batches:
            for rec, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                loud = np.abs(np.array([x or 0.0 for _, row in sorted((r["vec_id"], r["embedding"]) for r in values) for x in row or ()]))[: VECTORS * 64]
                loud = np.pad(loud, (0, -len(loud) % 12)).reshape(-1, 12)
                sound = np.concatenate([np.empty(0), *((tones[:, k * HOP : (k + 1) * HOP] * loud[k][:, None]).sum(0) for k in range(len(loud)))])
                sound = sound * (20000 / max(1e-9, np.abs(sound).max(initial=0)))
                draw = np.random.default_rng(rec)
                start, n = int(draw.integers(0, 80)), int(draw.integers(60, 91))
                part = 0.4 * sound[start * HOP : (start + n) * HOP]
                part = part + 200 * draw.standard_normal(len(part))
                yield pa.RecordBatch.from_arrays([pa.array([2 * rec, 2 * rec + 1], pa.int64()), pa.array([x.astype("<i2").tobytes() for x in (sound, part)], pa.binary())], ["rec_id", "audio"])

    each = vectors.select(F.floor(F.col("vec_id") / VECTORS).cast("long").alias("rec"), F.struct("vec_id", "embedding").alias("x"))
    return each.groupBy("rec").agg(F.collect_list("x").alias("values")).mapInArrow(run, "rec_id long, audio binary")


def op9_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(chroma.audio_fingerprints(recordings(table(spark, sf_dir, "embeddings")), "rec_id", "audio", RATE, WINDOW, HOP))
    found = chroma.align(prints, F.col("rec") % 50 == 0)
    best = found.groupBy(F.col("query_id").alias("rec")).agg(F.count("*").alias("n_matches"), F.max_by(F.struct("match_id", "shift", "bit_errors"), F.struct(-F.col("bit_errors"), "overlap", -F.col("match_id"))).alias("best"), F.array_sort(F.collect_list(F.struct("match_id", "shift", "votes", "overlap", "bit_errors"))).alias("matches"))
    out = prints.join(best, "rec", "left")
    return out.select(F.col("rec").alias("rec_id"), F.floor(F.length("prints") / 4).alias("n_prints"), F.md5("prints").alias("prints_md5"), (F.col("rec") % 50 == 0).alias("is_query"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "best.match_id", "best.shift", "best.bit_errors", "matches")


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.query(table(spark, sf_dir, "conversations"))


def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": OP1_SQL, "op10_line_chunks": lines.SQL, "op11_conversation_repair": conversations.SQL, "op13_source_divergence": divergence.SQL}
