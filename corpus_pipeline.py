"""The corpus pipeline: language ID, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the
columns of `documents`; the last one returns the packed pieces. run() writes each stage's result to
the shared folder and reads it back, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.exact_dedup import exact_dedup, sha256_of
from blockloom.llm.language_id import UNDETERMINED, fit, held_out, predict
from blockloom.llm.minhash import judged, text_key
from blockloom.llm.mixing import mix
from blockloom.llm.packing import default_tokenizer, pack_in_order
from blockloom.llm.shared import discard, pick, scratch, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than this are rejected, as are those without a letter. The score of a text
#: that is stranger than the labelled training rows falls to 0, see blockloom.llm.language_id.
LEAST_SCORE = 0.05
#: Up to so many part files the first positions of files are broadcast.
MOST_FILES = 100_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language and writes it into lang."""
    own = pick(docs, *COLUMNS)
    model = fit(own, ~held_out(F.col("doc_id")))
    found = predict(own, model, ("text", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays; of rows that repeat id and text, one."""
    kept = stored(exact_dedup(docs).where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")), "exact-kept")
    own = pick(docs, *COLUMNS).withColumn("own", sha256_of(F.coalesce("text", F.lit(""))))
    ids = kept.select(F.col("doc_id").alias("keep"), "digest", "rows")
    rows = own.join(ids, own["doc_id"].eqNullSafe(F.col("keep")) & (F.col("own") == F.col("digest")))
    if kept.where("rows > 1").take(1):
        again = rows.where("rows > 1").dropDuplicates(["doc_id", "text"])
        rows = rows.where("rows = 1").unionByName(again)
    return rows.select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays."""
    kept = judged(docs, words=5, percent=80, bands=48).where("kept").select(F.col("doc_id").alias("keep"), F.col("text_key").alias("key")).distinct()
    own = pick(docs, *COLUMNS)
    return own.join(kept, own["doc_id"].eqNullSafe(F.col("keep")) & (text_key("text") == F.col("key")), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the mixed order: part file after part file, row after row."""
    own = pick(docs, *COLUMNS)
    keyed = own.withColumn("key", text_key("text"))
    order = mix(keyed, passing=("key",)).groupBy(F.col("doc_id").alias("keep"), F.col("key").alias("keep_key")).agg(F.min("position").alias("position"))
    return keyed.join(order, keyed["doc_id"].eqNullSafe(F.col("keep")) & (F.col("key") == F.col("keep_key"))).orderBy("position").select(*COLUMNS)


def _positions(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: the number of the row, part file after part file, row after row."""
    at = ("_metadata.file_name", "_metadata.row_index")
    try:
        rows = docs.select("doc_id", "text", *[F.col(c) for c in at])
    except AnalysisException:  # not a table of Parquet files
        rows = stored(pick(docs, "doc_id", "text"), "in-order").select("doc_id", "text", *[F.col(c) for c in at])
    # One row a file.
    counts = stored(rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")), "file-rows")
    before = F.sum("n").over(Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("file_name").alias("name"), F.coalesce(before, F.lit(0)).alias("first"))
    small = F.broadcast if counts.count() <= MOST_FILES else (lambda d: d)
    return rows.join(small(starts), F.col("file_name") == F.col("name")).select("doc_id", "text", (F.col("first") + F.col("row_index")).alias("position"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences, which follow the order of the rows."""
    return pack_in_order(_positions(docs), default_tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID and packing are out of SQL's reach; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):  # a stage's own tables go with it
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
