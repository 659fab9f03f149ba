"""What the operators of this subpackage have in common: column picking, shared tables and ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name, so that extra columns (even ones that differ
    by case alone, or appear twice) cannot make a reference ambiguous. The first of a name counts."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[flat[f"c{df.columns.index(n)}"].alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary
    folder is set for the session, but only if driver and executors are one process; else it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="blockloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches to Python workers hold so many bytes at most, however long the texts are. This is a setting of the session, and
    stays: what is made by an operator is read later, when it must still hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: For each scratch() that is open, the innermost last, the tables made in it.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside are deleted at the end, but for the last one, which the caller reads on."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop()[:-1]:
            remove(spark, path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go as soon as each job's result is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage ends there and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffle_files_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, folder)


def rows_literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side table as a plan literal: no RDD and no Python worker is involved."""
    import json

    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in schema.split(',')))}>>")))


#: A key that more than 1/HEAVY of all rows share is heavy: there are fewer than HEAVY of them.
HEAVY = 1000
#: Rows of a bucket in which ranked() numbers rows, on average.
BUCKET = 1 << 16
#: Rows by which a bucket may be above the usual before it is searched for heavy rows.
ROOM = 1000
PART = "_part"


def parted(df: DataFrame, name: str) -> DataFrame:
    """stored() with a column PART that is the same whenever the table is read; what ranked() takes."""
    return stored(df.withColumn(PART, F.pmod(F.spark_partition_id(), F.lit(1 << 12)).cast("int")), name)


def table_of(spark: SparkSession, rows: list[tuple], schema: str, name: str, each: int = 20_000) -> DataFrame:
    """Driver-side rows as a table in the shared folder, written in parts, so that no query plan holds them."""
    path = new_path(spark, name)
    for at in range(0, max(1, len(rows)), each):
        rows_literal(spark, rows[at : at + each], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranked(table: DataFrame, group: list[str], rank: str, least: int = 4) -> DataFrame:
    """Adds `rank`, gapless from 0 within each group, to a table made by parted(), without bringing a group
    into one task. There are few groups: one row for each must fit into memory.

    Rows follow the hash of all their columns, then the columns: the ranks depend on the rows alone and not on
    how they lie in files or partitions. A group is cut into buckets of hashes, `least` of them or more
    as its count grows; rows are numbered in their bucket, and each bucket starts where those before it end. A heavy row
    (a good part of the excess of a bucket that has twice the usual rows and over 1/HEAVY of all) has a bucket of its own,
    where order doesn't matter: it is cut by PART.
    """
    names = [c for c in table.columns if c != PART]
    sizes = table.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_size")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    buckets = F.greatest(F.lit(least), F.ceil(F.col("_size") / BUCKET)).cast("long")
    keyed = table.join(F.broadcast(sizes), same).withColumn("_hash", F.xxhash64(*names)).withColumn("_bucket", F.pmod("_hash", buckets)).withColumn("_usual", F.col("_size") / buckets).withColumn("_cut", F.lit(-1))
    counts = stored(keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("_usual").alias("_usual")), "bucket-counts")
    keyed = keyed.select(*names, PART, "_hash", "_bucket", "_cut")
    limit = (counts.agg(F.sum("_n")).first()[0] or 0) // HEAVY
    over = counts.where((F.col("_n") > limit) & (F.col("_n") > 2 * F.col("_usual") + ROOM)).select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*group, "_bucket"])])  # fewer than HEAVY buckets
    if over.take(1):
        full = keyed.join(F.broadcast(over), [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate([*group, "_bucket"])])
        heavy = full.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where((4 * F.col("_n") > limit) & (4 * F.col("_n") > ROOM)).select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(names)], F.lit(True).alias("_heavy"))
        marked = keyed.join(F.broadcast(stored(heavy, "heavy-rows")), [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(names)], "left")
        # A heavy row's bucket is told by its hash: all such buckets come before the others.
        heavy = F.coalesce("_heavy", F.lit(False))
        keyed = marked.select(*names, PART, "_hash", F.when(heavy, F.col("_hash")).otherwise(F.col("_bucket")).alias("_bucket"), F.when(heavy, F.col(PART)).otherwise(-1).alias("_cut"))
        counts = stored(keyed.groupBy(*group, "_bucket", "_cut").agg(F.count(F.lit(1)).alias("_n")), "bucket-counts")
    else:
        counts = counts.withColumn("_cut", F.lit(-1))
    # A row for each bucket meets in its group.
    before = Window.partitionBy(*group).orderBy(F.col("_cut") < 0, "_bucket", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.col("_cut").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*group, "_bucket", "_cut").orderBy("_hash", *names)
    numbered = keyed.withColumn("_r", F.row_number().over(own) - 1)
    joined = numbered.join(starts, [*same, F.col("_bucket") == F.col("_b"), F.col("_cut") == F.col("_c")], "inner")
    return joined.select(*names, (F.col("_start") + F.col("_r")).cast("long").alias(rank))
