"""Block tables from the plain input tables, and targets derived from them for audits.

documents: a line of text is a block, 40 blocks are a page. lineitem: an order is a page and each of its
lines a sentence block or a row of grid cells. The derived target is a function of the source text, so
that an audit has findings of every kind without any model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_BLOCKS = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, local_no, block_id, text: non-blank lines in order. No shuffle: the ordinal
    comes from the array of lines itself."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("block_id", "text"))
    return rows.select("doc_id", F.floor(F.col("block_id") / PAGE_BLOCKS).cast("int").alias("page_no"), (F.col("block_id") % PAGE_BLOCKS).cast("int").alias("local_no"), F.col("block_id").cast("int"), "text")


def derived_target(key: Column, text: Column) -> Column:
    """A translation made up from the source: every 7th lacks its first digit, every 11th is empty, every
    13th is the source itself, the others are lower-cased behind a mark."""
    mark = F.lit("x ")
    return F.when(key % 11 == 0, "").when(key % 7 == 0, F.concat(mark, F.lower(F.regexp_replace(text, "^([^0-9]*)[0-9]", "$1")))).when(key % 13 == 0, text).otherwise(F.concat(mark, F.lower(text)))


def sentences(lineitem: DataFrame) -> DataFrame:
    """page_no, block_no, text, target: one sentence a line item; the target changes a unit, a digit or
    a sign, or is blank, by a key."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    quantity = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    rate = F.col("l_discount").cast("decimal(18,2)").cast("string")
    body = lambda amount: F.concat(F.lit("Quantity "), quantity, F.lit(" price "), amount, F.lit(" discount "), rate, F.lit("%"))
    source = body(F.format_number(price, 2))
    thousands = (price.cast("decimal(18,5)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,5)").cast("string")
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    target = (
        F.when(key % 11 == 0, "")
        .when(key % 13 == 0, F.regexp_replace(source, "^([^0-9]*)[0-9]", "$1"))
        .when(key % 17 == 0, body(F.concat(thousands, F.lit(" thousand yuan"))))
        .when(key % 19 == 0, body(F.concat(F.lit("-"), F.format_number(price, 2))))
        .otherwise(source)
    )
    return lineitem.select(F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("block_no"), source.alias("text"), target.alias("target"))


def numbered(lineitem: DataFrame) -> DataFrame:
    """lineitem with row_no from 1 in each order: line numbers repeat in some orders."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return lineitem.withColumn("row_no", F.row_number().over(order))


GRID_COLUMNS = ["l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def grid_cells(lineitem: DataFrame) -> DataFrame:
    """page_no, item_no, row_no, col_no, text and box: a table per order. Figures are right-aligned, as
    wide as their digits; odd rows sit two points lower, so that rows must be clustered."""
    text = lambda c: F.col(c) if c == "l_returnflag" else F.col(c).cast("decimal(18,2)").cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("col_no"), text(c).alias("text")) for i, c in enumerate(GRID_COLUMNS)])
    rows = numbered(lineitem).select(F.col("l_orderkey").alias("page_no"), "row_no", F.explode(cells).alias("cell")).select("page_no", "row_no", "cell.col_no", "cell.text")
    width = F.length("text") * 6.0
    left = F.when(F.col("col_no") == 0, 0.0).otherwise(F.col("col_no") * 120.0 + 100.0 - width)
    top = F.col("row_no") * 20.0 + F.when(F.col("col_no") % 2 == 1, 2.0).otherwise(0.0)
    return rows.select("page_no", (F.col("row_no") * 10 + F.col("col_no")).cast("int").alias("item_no"), "row_no", "col_no", "text", left.alias("x0"), top.alias("y0"), (left + width).alias("x1"), (top + 10.0).alias("y1"))
