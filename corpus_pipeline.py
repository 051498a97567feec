"""The corpus pipeline: documents scored, cleaned, deduplicated, mixed and encoded.

``STAGES`` are applied in order; each takes the documents that its predecessor kept. ``run`` writes every stage's
result to the shared folder and reads it back, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import line_dedup, mixing, near_dedup, quality, segmentations
from evalspark.llm.common import saved, table
from evalspark.session import scratch_path

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*DOCUMENT)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; equal texts have equal scores, a null text is the empty one."""
    scored = quality.score_quality(docs.select(*DOCUMENT), table(spark, sf_dir, "labels"))
    return _documents(scored.where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more rows have; a null text becomes the empty one."""
    return _documents(line_dedup.drop_common_lines(docs.select(*DOCUMENT), min_docs=10))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more).

    It is the one of the smallest doc_id (null last), of several with that id the one of the least text hash, and of
    repeated rows one. Texts without words are in no group and stay. An empty table gives an empty table.
    """
    rows = docs.select(*DOCUMENT).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    near = saved(
        near_dedup.near_duplicates(docs.select(*DOCUMENT), words=5, numerator=80, denominator=100)
        .where("component IS NOT NULL")
        .groupBy("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_hash").alias("_hash")).alias("name"))
        .agg(F.count(F.lit(1)).alias("times")),
        scratch_path(spark, "near-names"),
    )
    first = near.groupBy("component").agg(F.min("name").alias("first"))
    marked = near.join(first, "component").select(
        F.col("name.doc_id").alias("_id"), F.col("name._hash").alias("_hash"), (F.col("name") == F.col("first")).alias("stays"), "times"
    )

    def named(names: DataFrame, how: str) -> DataFrame:
        keys = names.select("_id", F.col("_hash").alias("_other"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_other"))
        return rows.join(keys, same, how)

    # rows that stay and are there once never move beside a small list of the others
    single = named(marked.where("NOT stays OR times > 1"), "left_anti")
    several = named(marked.where("stays AND times > 1"), "left_semi").dropDuplicates(["doc_id", "_hash"])
    return _documents(single.unionByName(several))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _documents(mixing.repeated(mixing.mix_sources(docs.select(*DOCUMENT))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled encodings of every document taken, fewer where a text has fewer.

    doc_id, lang, source, sample, n_tokens, log_prob, log_inclusion, ids. Documents that the mix takes twice, and
    rows of one doc_id and text, have the same encodings each time. A null text is the empty one.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = segmentations.sample_encodings(docs.select(*DOCUMENT), model, samples=2)
    n_tokens = F.size("ids").cast("long").alias("n_tokens")
    return encoded.select("doc_id", "lang", "source", "sample", n_tokens, "log_prob", "log_inclusion", "ids")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]

# training, hashing into trees and sampling have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), scratch_path(spark, f"pipeline-{name}"))
    return docs
