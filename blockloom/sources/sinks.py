"""Writers. Files are committed by Spark's own protocol: readers see all of a write or none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_page(pages: DataFrame, blocks: DataFrame, doc: list[str], value: str = "target") -> DataFrame:
    """Every page with its values in block order, pages without blocks included."""
    own = blocks.groupBy(*doc, "page_no").agg(F.array_sort(F.collect_list(F.struct("block_id", value))).alias("_v"))
    return pages.select(*doc, "page_no").join(own, [*doc, "page_no"], "left").select(*doc, "page_no", F.coalesce(F.col(f"_v.{value}"), F.array().cast("array<string>")).alias("values"))


def check_aligned(blocks: DataFrame, values: DataFrame, keys: list[str]) -> None:
    """Raises where a block has no value or a value no block."""
    lost = blocks.select(*keys).join(values.select(*keys), keys, "left_anti").limit(1).count() + values.select(*keys).join(blocks.select(*keys), keys, "left_anti").limit(1).count()
    if lost:
        raise ValueError("blocks and values don't match")


def plain_text(paged: DataFrame, doc: list[str]) -> DataFrame:
    """One text per document: a heading per page, its non-blank texts, a blank line."""
    body = F.filter("values", lambda v: F.trim(v) != "")
    page = F.concat(F.lit("===== Page "), (F.col("page_no") + 1).cast("string"), F.lit(" =====\n"), F.array_join(body, "\n"), F.lit("\n"))
    rows = paged.select(*doc, F.struct("page_no", page.alias("t")).alias("p"))
    return rows.groupBy(*doc).agg(F.array_sort(F.collect_list("p")).alias("ps")).select(*doc, F.array_join("ps.t", "\n").alias("text"))


def markdown(pages: DataFrame, blocks: DataFrame, doc: list[str]) -> DataFrame:
    """Bilingual Markdown per document: a section per page with each target and its quoted source folded below."""
    lines = blocks.where(F.trim("target") != "").select(*doc, "page_no", F.struct("block_id", F.concat(F.col("target"), F.lit("\n\n<details><summary>source</summary>\n\n> "), F.regexp_replace("text", "\n", "\n> "), F.lit("\n\n</details>\n")).alias("t")).alias("b"))
    own = lines.groupBy(*doc, "page_no").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    every = pages.select(*doc, "page_no").join(own, [*doc, "page_no"], "left")
    page = F.concat(F.lit("## Page "), (F.col("page_no") + 1).cast("string"), F.lit("\n\n"), F.coalesce(F.array_join("bs.t", "\n"), F.lit("")))
    return every.select(*doc, F.struct("page_no", page.alias("t")).alias("p")).groupBy(*doc).agg(F.array_sort(F.collect_list("p")).alias("ps")).select(*doc, F.array_join("ps.t", "\n").alias("text"))


def interleaved(pages: DataFrame, doc: list[str]) -> DataFrame:
    """Output pages of a bilingual document: source page i is page 2i, its translation 2i + 1."""
    return pages.select(*doc, "page_no", F.explode(F.array(F.struct(F.lit("source").alias("side"), (F.col("page_no") * 2).alias("output_page")), F.struct(F.lit("target").alias("side"), (F.col("page_no") * 2 + 1).alias("output_page")))).alias("o")).select(*doc, "page_no", "o.side", "o.output_page")


def encode_page_map(first_pages: Column) -> Column:
    return F.array_join(first_pages.cast("array<string>"), ",")


def decode_page_map(text: Column) -> Column:
    """Array of first output pages; null unless all are whole, not negative and ascending."""
    parts = F.transform(F.filter(F.split(text, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).try_cast("int"))
    rising = F.forall(F.zip_with(parts, F.slice(parts, 2, 1 << 30), lambda a, b: b.isNull() | (a <= b)), lambda x: x)
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0)) & rising, parts)


def seed_cache(cache: DataFrame, pieces: DataFrame) -> DataFrame:
    """The cache with translated pieces under their own text's hash. Blank pieces and echoes don't count; of several
    for one text the last (by block_id) is kept, and it replaces an older entry."""
    fresh = pieces.where((F.trim("text") != "") & (F.trim("target") != "") & (F.trim("text") != F.trim("target")))
    new = fresh.groupBy(F.md5("text").alias("block_hash")).agg(F.max_by("target", "block_id").alias("text"))
    return cache.join(new, "block_hash", "left_anti").select("block_hash", "text").unionByName(new)


def write_text(rows: DataFrame, path: str) -> None:
    rows.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, *partitions: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def clear_cache(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Kinds of output and how they are made from (pages, blocks, document keys).
OUTPUTS: dict[str, Callable[[DataFrame, DataFrame, list[str]], DataFrame]] = {
    "text": lambda pages, blocks, doc: plain_text(by_page(pages, blocks, doc), doc),
    "markdown": markdown,
    "page_map": lambda pages, blocks, doc: interleaved(pages, doc),
}


def moved_pages(blocks: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """First output page of each source page where what doesn't fit moves to continuation pages of the same height."""
    extra = blocks.groupBy(*keys).agg(F.max("y1").alias("low")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("low") / limit)).cast("int"))
    before = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return extra.withColumn("first_page", F.coalesce(F.sum("pages").over(before), F.lit(0)).cast("int"))
