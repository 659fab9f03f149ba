"""Exact dedup by a log-structured merge index of text digests.

Every task fills a memtable with (digest -> ids); a full memtable is flushed as one immutable run,
sorted by digest. Compaction merges the sorted runs digest range by digest range into one run a range and
keeps, for each digest, the smallest and the largest identifier and the number of rows. Digests seen more than
once are hits. Bloom filters over them, in blocks of RANGE_WORDS and of a size that follows their number, are
consulted for every row before its text goes on, and what passes is verified byte by byte: the
texts themselves are grouped, so two texts that only share a digest are never taken as equal. Where the
filters would be larger than FILTER_WORDS, rows meet the hits in a join instead.
DigestIndex.seen() asks the filters of every level in the same way before it looks a digest up.

Defined results: null text counts as empty text; empty texts are equal to each other; a null id
never stays while its group has another id; rows that repeat both id and text share one fate;
an empty table gives an empty table; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import pick, rows_literal, stored

#: Rows of a memtable before it is flushed; bounds the memory of a task.
MEMTABLE_ROWS = 1 << 17
#: 64-bit words that the filters over hit digests may have together (at BITS bits a hit), to be sent to every task.
FILTER_WORDS, BITS = 1 << 18, 16
#: Words of one filter.
RANGE_WORDS = 1 << 10
#: A digest that more than 1/HEAVY of all rows share is heavy: there are fewer than HEAVY of them.
HEAVY = 1000

RUN_SCHEMA = "run long, digest binary, low long, high long, n long"


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def memtables(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Sorted runs (digest, low, high, n) of at most `limit` input rows each."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.Table:
        made = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "min"), ("doc_id", "max"), ([], "count_all")])
        return pa.table({"digest": made["digest"], "low": made["doc_id_min"], "high": made["doc_id_max"], "n": made["count_all"]}).sort_by("digest")

    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            part = batch.slice(at, limit)
            if rows + part.num_rows > limit:
                yield flush()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield flush()


class DigestIndex:
    """Immutable sorted runs with filters; append() flushes new runs, compact() merges all of them."""

    def __init__(self, spark: SparkSession, memtable_rows: int = MEMTABLE_ROWS):
        self.spark, self.memtable_rows = spark, memtable_rows
        self.levels: list[DataFrame] = []

    def append(self, digests: DataFrame) -> DataFrame:
        """Flushes runs of a batch (digest binary, doc_id long); returns them."""
        limit = self.memtable_rows

        def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for k, run in enumerate(memtables(batches, limit)):
                yield from run.add_column(0, "run", pa.array([(part << 32) + k] * run.num_rows, pa.int64())).to_batches()

        runs = stored(pick(digests, "digest", "doc_id").mapInArrow(flush, RUN_SCHEMA), "digest-runs")
        self.levels.append(runs)
        return runs

    def compact(self) -> DataFrame:
        """Merges every level into one run per digest range, sorted; it replaces the levels."""
        every = self.levels[0]
        for more in self.levels[1:]:
            every = every.unionByName(more)
        # Equal digests are neighbours in their range: the aggregation needs no other exchange.
        ranges = every.repartitionByRange("digest").sortWithinPartitions("digest")
        merged = ranges.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        merged = stored(merged.sortWithinPartitions("digest").withColumn("run", F.spark_partition_id().cast("long")).select("run", "digest", "low", "high", "n"), "digest-level")
        self.levels = [merged]
        return merged

    def seen(self, digests: DataFrame) -> DataFrame:
        """The index rows (digest, low, high, n) of the batch's digests that some run holds."""
        wanted, out = pick(digests, "digest").distinct(), None
        for level in self.levels:
            made = level.join(may_be_in(wanted, level), "digest", "left_semi").select("digest", "low", "high", "n")
            out = made if out is None else out.unionByName(made)
        return out.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def run_filters(digests: DataFrame, words: int, ranges: int) -> Callable[[Column], Column]:
    """A test, made of built-in functions, that every one of the digests passes and few others do: a hash of the
    digest says in which of `ranges` filters of `words` 64-bit words it is looked up."""
    size = words * 64

    def slots(d: Column) -> list[Column]:
        own = F.pmod(F.xxhash64(d), F.lit(ranges)) * size
        return [(own + F.pmod(F.xxhash64(d, F.lit(i)), F.lit(size))).cast("long") for i in (1, 2, 3)]

    at = digests.select(F.explode(F.array(*slots(F.col("digest")))).alias("b"))
    at = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    every = digests.sparkSession.range(words * ranges).join(at, F.col("id") == F.col("w"), "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))
    # One row, of a bounded size, that goes to the tasks as a literal of the plan.
    held = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("words")).scalar()
    bit = lambda b: F.get(held, F.shiftright(b, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))) != 0
    return lambda d: bit(slots(d)[0]) & bit(slots(d)[1]) & bit(slots(d)[2])


def may_be_in(rows: DataFrame, run: DataFrame, most: int = FILTER_WORDS) -> DataFrame:
    """The rows (with a column digest) that the run (distinct digests) holds, and a few others: those that its
    filters let pass, or, if these would be larger than `most` words, those that it holds by a join."""
    held = run.select("digest")
    bits = BITS * held.count()
    if bits > 64 * most:
        return rows.join(held, "digest", "left_semi")
    ranges = -(-max(bits, 64) // (64 * RANGE_WORDS))
    words = min(RANGE_WORDS, -(-max(bits, 64) // 64))
    return rows.where(run_filters(held, words, ranges)(F.col("digest")))


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = sha256_of, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    keep: "smallest" or "largest" identifier of a group of equal texts stays. digest: Column
    function from text to binary; results don't depend on it being free of collisions.
    """
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    withdig = texts.withColumn("digest", digest(F.col("text")))
    digests = stored(withdig.select("doc_id", "digest"), "digests")
    index = DigestIndex(spark, memtable_rows)
    index.append(digests)
    merged = index.compact()
    end = "low" if keep == "smallest" else "high"
    hits = merged.where("n > 1").select("digest", F.col(end).alias("keep_id"), F.col("n").alias("group_size"))

    # Verification: the bytes of all texts with a hit digest are grouped; equal texts meet already
    # within each task, so a hot group sends one row a task.
    read = may_be_in(withdig, hits)
    classes = read.groupBy("digest", "text").agg(F.lit(1).alias("one"))
    clashes = stored(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("digest"), "clashes")
    clash = bool(clashes.take(1))

    total = digests.count()
    heavy = hits.where(F.col("group_size") > total // HEAVY).limit(HEAVY + 1)
    rest = hits.where(F.col("group_size") <= total // HEAVY)
    names = rows_literal(spark, [(d.hex(), k, n) for d, k, n in heavy.collect()], "hex string,keep_id bigint,group_size bigint").select(F.unhex("hex").alias("digest"), "keep_id", "group_size")
    plain = digests.join(clashes, "digest", "left_anti") if clash else digests
    hot = plain.join(F.broadcast(names), "digest", "inner")
    cold = plain.join(F.broadcast(names), "digest", "left_anti").join(rest, "digest", "left")
    out = hot.unionByName(cold.select("digest", "doc_id", "keep_id", "group_size"))
    if clash:
        mixed = withdig.join(clashes, "digest", "left_semi")
        own = mixed.groupBy("digest", "text").agg((F.min if keep == "smallest" else F.max)("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(mixed.join(own, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size"))
    single = F.col("group_size").isNull()
    out = out.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
