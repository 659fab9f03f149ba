"""Readers and cleaners: lines from spans, OCR items, figure regions, structure boxes, caches, glossaries, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions import geometry as G
from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.operators.sequence import sorted_rows


def binary_pages(spark: SparkSession, path: str, extract, schema: str) -> DataFrame:
    """Pages of binary documents: extract(path, bytes) yields dicts of `schema`. The parser is injected; documents
    are read in parallel, one at a time per worker."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(extract(name, bytes(content)))
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def structured_documents(spark: SparkSession, path: str, extract, schema: str, keys: list[str], structure=None) -> tuple[DataFrame, DataFrame]:
    """(blocks, regions) of binary documents in one call: extract() gives blocks, `structure` (a function from blocks to regions, by
    default their geometry) the regions."""
    blocks = binary_pages(spark, path, extract, schema)
    return blocks, (structure or (lambda b: geometric_regions(b, keys)))(blocks)


def ocr_pages(pages: DataFrame, cache: DataFrame, recognise, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean items of all pages, raw items of the pages that the cache lacked, to be appended to it). pages: page_key (see ocr_key())
    and keys; cache: page_key and items as the recogniser gives them (item_no, points, text); recognise: a function from pages to rows
    (page_key, item_no, points, text). A page that was read without result has a row with null points. Numbers are repaired on the
    way out, so that cached pages gain from better rules."""
    todo = pages.join(cache.select("page_key").distinct(), "page_key", "left_anti")
    fresh = recognise(todo).select("page_key", "item_no", "points", "text")
    every = cache.select("page_key", "item_no", "points", "text").unionByName(fresh).join(pages.select("page_key", *keys), "page_key")
    return clean_ocr(every, keys), fresh


def lines_from_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per visual line: text in span order with single spaces, united box, upper median of sizes, bold from
    a flag or the font's name, most frequent colour (ties: the first), and the spans themselves."""
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.lower(F.coalesce("font", F.lit(""))).contains("bold")
    rows = sorted_rows(spans.withColumn("_bold", bold), [*keys, "line_no"], ["span_no"], ["text", "x0", "y0", "x1", "y1", "size", "_bold", "color"])
    colors = F.array_distinct("rows.color")
    often = F.transform(colors, lambda c, i: F.struct((-F.size(F.filter(F.col("rows.color"), lambda x: x == c))).alias("n"), i.alias("i"), c.alias("c")))
    out = rows.select(
        *keys, "line_no", X.clean_space(F.array_join("rows.text", "")).alias("text"), F.array_min("rows.x0").alias("x0"), F.array_min("rows.y0").alias("y0"), F.array_max("rows.x1").alias("x1"), F.array_max("rows.y1").alias("y1"),
        G.upper_median(F.col("rows.size")).alias("size"), F.exists("rows._bold", lambda b: b).alias("bold"), F.array_min(often)["c"].alias("color"),
        F.transform("rows", lambda r: F.struct(r["x0"], r["y0"], r["x1"], r["y1"], F.trim(r["text"]).alias("text"))).alias("spans"),
    )
    return out.where("text <> ''")


def drawn_spans(spans: DataFrame) -> DataFrame:
    """Spans with text and their glyph bands instead of line boxes."""
    band = G.glyph_band(F.col("x0"), F.col("x1"), F.col("origin_y"), F.col("size"), F.col("ascender"), F.col("descender"))
    return spans.where(F.trim("text") != "").withColumn("band", band)


def clean_ocr(items: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of points (array of x, y) as rectangles, text cleaned, numbers repaired. Items without text, with
    fewer than two points or with a point that isn't finite are dropped one by one; `fixed` marks repairs."""
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300)
    ok = (F.size(F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>"))) >= 2) & F.forall("points", lambda p: p.isNotNull() & real(p["x"]) & real(p["y"]))
    rows = items.withColumn("_text", X.clean_text(F.coalesce("text", F.lit("")))).where((F.col("_text") != "") & ok)
    repaired = N.repair_number(F.col("_text"))
    ends = lambda f, axis: f(F.transform("points", lambda p: p[axis]))
    return rows.select(*keys, "item_no", ends(F.array_min, "y").alias("y0"), ends(F.array_min, "x").alias("x0"), ends(F.array_max, "x").alias("x1"), ends(F.array_max, "y").alias("y1"), repaired.alias("text"), (repaired != F.col("_text")).alias("fixed"))


def needs_ocr(pages: DataFrame, lines: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Pages whose text layer has few lines."""
    n = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return pages.join(n, keys, "left").where(F.coalesce("_n", F.lit(0)) <= most).drop("_n")


def drop_signatures(items: DataFrame, keys: list[str], page_height: str = "page_height") -> DataFrame:
    """Without handwriting: items at the foot of the page, three times as high as the median item, short, with letters
    and without digits."""
    height = F.col("y1") - F.col("y0")
    median = items.groupBy(*keys).agg(F.median(F.greatest(F.lit(0.001), height)).alias("_median"))
    ink = (height >= F.greatest(F.lit(15.0), F.col("_median") * 3)) & ((F.col("y0") + F.col("y1")) / 2 >= F.col(page_height) * 0.7)
    short = (F.length(F.replace("text", F.lit(" "), F.lit(""))) <= 6) & F.col("text").rlike(r"\p{L}") & ~F.col("text").rlike(r"\d")
    return items.join(median, keys).where(~(ink & short)).drop("_median")


def figure_regions(images: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """Raster regions worth reading: 24 points a side, 2000 square points, at most 95 % of the page, the same box (in
    whole points) once, the first four of a page."""
    box = G.box()
    w, h = box[2] - box[0], box[3] - box[1]
    kept = images.where((w >= 24) & (h >= 24) & (w * h >= 2000) & (w * h <= F.col("page_area") * 0.95))
    rounded = [F.bround(c, 0) for c in box]
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *rounded).orderBy("image_no"))).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("image_no"))).where(F.col("_n") <= most).drop("_n")


def readable_figures(items: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Figures (image_no) whose texts have four characters together."""
    return items.groupBy(*keys, "image_no").agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") >= least)


#: Kinds of region by the class names of layout models; classes that are no region.
REGION_KINDS = {
    "text": ["text", "plain text", "paragraph", "header", "footer", "reference", "list", "abstract", "index"],
    "heading": ["title", "section_header", "subsection_header", "subtitle"],
    "figure": ["figure", "image", "chart", "diagram"],
    "caption": ["figure_caption", "table_caption", "formula_caption", "table_footnote", "caption"],
    "table": ["table"],
    "formula": ["isolate_formula", "equation", "formula"],
}
NO_REGION = ["abandon", "abandoned", "ignore", "none"]


def structure_boxes(boxes: DataFrame, dpi: int = 150) -> DataFrame:
    """Model boxes (class_name, pixel box) as regions in points; unknown classes are text."""
    name = F.lower(F.trim("class_name"))
    kind = F.lit("text")
    for k, names in REGION_KINDS.items():
        kind = F.when(name.isin(names), k).otherwise(kind)
    out = boxes.where(~name.isin(NO_REGION)).withColumn("kind", kind)
    for c in ("x0", "y0", "x1", "y1"):
        out = out.withColumn(c, F.col(c) * (72.0 / dpi))
    return out


CAPTION = r"(?i)^\s*(?:图\s*\d+|表\s*\d+|Fig(?:ure)?\.?\s*\d+|Table\.?\s*\d+)"


def geometric_regions(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Regions from block geometry alone: each formula, heading (bold single lines, level by rank of size) and caption,
    and one figure (chart labels) and one table (table cells) per page. kind, level, box, block_ids."""
    vertical = X.is_vertical_label(F.col("text"), *G.box(), F.col("single_line"), F.col("in_table"))
    b = blocks.withColumn("_chart", F.col("is_chart") | vertical)
    bold = F.col("bold") & F.col("single_line") & ~F.col("in_table") & ~F.col("_chart")
    rank = F.dense_rank().over(Window.partitionBy(*keys, bold).orderBy(F.desc("size")))
    b = b.withColumn("_bold", bold).withColumn("_level", F.when(bold, rank).otherwise(0))
    caption = ~F.col("_chart") & ~F.col("bold") & ~F.col("in_table") & (F.length(X.stripped(F.col("text"))) <= 60) & F.col("text").rlike(CAPTION)
    kinds = F.array(F.when(X.is_formula(F.col("text")), "formula"), F.when(F.col("_bold"), "heading"), F.when(caption, "caption"))
    single = b.withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    single = single.select(*keys, "kind", F.when(F.col("kind") == "heading", F.col("_level")).otherwise(0).alias("level"), "x0", "y0", "x1", "y1", F.array("block_id").alias("block_ids"))
    whole = lambda test, kind: b.where(test).groupBy(*keys).agg(F.lit(kind).alias("kind"), F.lit(0).alias("level"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list("block_id")).alias("block_ids"))
    return single.unionByName(whole(F.col("_chart"), "figure")).unionByName(whole(F.col("in_table"), "table"))


def html_regions(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Regions of web pages by tag: h1 to h6 are headings with their level, li entries, p text, figcaption captions."""
    inner = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6]|p|li|figcaption)\b[^>]*>(.*?)(?=</\1>|<(?:h[1-6]|p|li|figcaption|/article|/ul|/body)\b|\z)"), F.lit(2))
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6]|p|li|figcaption)\b[^>]*>(.*?)(?=</\1>|<(?:h[1-6]|p|li|figcaption|/article|/ul|/body)\b|\z)"), F.lit(1))
    rows = pages.select(page_id, F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("body"))).alias("region_no", "r"))
    tag = F.lower("r.tag")
    text = X.clean_space(F.regexp_replace("r.body", "<[^>]*>", " "))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "entry").when(tag == "figcaption", "caption").otherwise("text")
    return rows.select(page_id, "region_no", kind.alias("kind"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).try_cast("int")).otherwise(0).alias("level"), text.alias("text")).where("text <> ''")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a JSON object file of strings; an object that can't be read gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "target")).where((F.trim("source") != "") & F.col("target").isNotNull())


def read_cache(spark: SparkSession, path: str, cache_key: str | None = None) -> DataFrame:
    """Cache rows (cache_key, block_hash, text) without empty texts; of one key where it is given."""
    rows = spark.read.parquet(path).where("text <> ''")
    return rows if cache_key is None else rows.where(F.col("cache_key") == cache_key)


def translation_key(doc_path: Column, lang: Column, model: Column, glossary_hash: Column, version: int = 9) -> Column:
    return X.glossary_key(doc_path, lang, model, glossary_hash, F.lit(str(version)))


def ocr_key(path: Column, modified: Column, size: Column, version: int = 10) -> Column:
    return X.glossary_key(path, modified.cast("string"), size.cast("string"), F.lit(str(version)))


def out_document(docs: DataFrame, doc: str = "doc_id", raw: str = "raw") -> DataFrame:
    """(doc, block_id, text) of {"index": {"text": ...}} objects; indices that are no numbers are dropped."""
    rows = docs.select(doc, F.explode(F.from_json(raw, "map<string,struct<text:string>>")).alias("k", "v"))
    return rows.select(doc, F.col("k").try_cast("int").alias("block_id"), F.col("v.text").alias("text")).where("block_id is not null and text is not null")


def page_spec(spec: Column) -> Column:
    """Array of pages of "24-27,30"; null where the text isn't such a list or a range is inverted."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    high = lambda p: F.coalesce(F.regexp_extract(p, r"-\s*(\d+)$", 1).try_cast("int"), low(p))
    good = F.forall(parts, lambda p: p.rlike(r"^\d{1,6}(\s*-\s*\d{1,6})?$") & (high(p) >= low(p)))
    safe = F.filter(parts, lambda p: p.rlike(r"^\d{1,6}(\s*-\s*\d{1,6})?$") & (high(p) >= low(p)))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(safe, lambda p: F.sequence(low(p), high(p)))))))


def table_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per table (table_no): box, rows, columns and column edges from its cells."""
    edges = F.array_sort(F.array_distinct(F.concat(F.collect_set("x0"), F.collect_set("x1"))))
    return cells.groupBy(*keys, "table_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"), edges.alias("col_edges"))


def ruled_rows(rows: DataFrame, rules: DataFrame, keys: list[str], slack: float = 1.0) -> DataFrame:
    """Adds ruled: a printed rule lies at the row's top or bottom (y0, y1) across it."""
    r = rules.select(*keys, F.col("y").alias("_y"))
    hit = rows.join(r, keys).where((F.abs(F.col("_y") - F.col("y0")) <= slack) | (F.abs(F.col("_y") - F.col("y1")) <= slack)).select(*keys, "row_no").distinct().withColumn("ruled", F.lit(True))
    return rows.join(hit, [*keys, "row_no"], "left").withColumn("ruled", F.coalesce("ruled", F.lit(False)))


def body_items(items: DataFrame, tables: DataFrame, keys: list[str], most: float = 60.0) -> DataFrame:
    """Unruled text above and below a table that may be its body: items in its x range between the neighbouring tables of the page, row after row
    from the table on as long as the gap to what is taken already is at most `most`. Adds table_no and side."""
    t = tables.select(*keys, "table_no", *[F.col(c).alias("t_" + c) for c in ("x0", "y0", "x1", "y1")])
    order = Window.partitionBy(*keys).orderBy("t_y0", "table_no")
    t = t.withColumn("_from", F.coalesce(F.lag("t_y1").over(order), F.lit(-1e9))).withColumn("_until", F.coalesce(F.lead("t_y0").over(order), F.lit(1e9)))
    near = items.join(t, keys).where((F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0")))
    below = (F.col("y0") >= F.col("t_y1")) & (F.col("y1") <= F.col("_until"))
    above = (F.col("y1") <= F.col("t_y0")) & (F.col("y0") >= F.col("_from"))
    sided = near.withColumn("side", F.when(below, "below").when(above, "above")).where("side is not null")
    # Both sides as distances from the table: where an item begins and ends.
    start = F.when(F.col("side") == "below", F.col("y0") - F.col("t_y1")).otherwise(F.col("t_y0") - F.col("y1"))
    end = F.when(F.col("side") == "below", F.col("y1") - F.col("t_y1")).otherwise(F.col("t_y0") - F.col("y0"))
    out = Window.partitionBy(*keys, "table_no", "side").orderBy("_start", "_end")
    reached = F.coalesce(F.max("_end").over(out.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = sided.withColumn("_start", start).withColumn("_end", end).withColumn("_apart", (F.col("_start") - reached > most).cast("int"))
    return gaps.withColumn("_stop", F.max("_apart").over(out.rowsBetween(Window.unboundedPreceding, 0))).where("_stop = 0").select(*items.columns, "table_no", "side")


def is_table(cells: DataFrame, keys: list[str], borderless: bool = False) -> DataFrame:
    """Tables that are tables: two rows and two columns at least; borderless ones also with 60 % full rows and a median
    fill below 0.6. cells: table_no, row, col, fill."""
    per_row = cells.groupBy(*keys, "table_no", "row").agg(F.count(F.lit(1)).alias("n"))
    shape = per_row.groupBy(*keys, "table_no").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("cols"))
    full = per_row.join(shape, [*keys, "table_no"]).groupBy(*keys, "table_no").agg(F.avg((F.col("n") == F.col("cols")).cast("int")).alias("full"))
    out = shape.join(full, [*keys, "table_no"]).where("rows >= 2 and cols >= 2")
    if not borderless:
        return out
    fill = cells.groupBy(*keys, "table_no").agg(F.median("fill").alias("fill"))
    return out.join(fill, [*keys, "table_no"]).where("full >= 0.6 and fill < 0.6")


def finite_blocks(blocks: DataFrame, most: float = 1e6) -> DataFrame:
    ok = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < most)
    return blocks.where(ok & (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0")))


def ocr_table_pages(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that hold only scanned table cells, and page furniture outside of them."""
    cell = F.col("ocr") & F.col("in_table") & ~F.col("is_chart")
    page = Window.partitionBy(*keys)
    edge = {c: f(F.when(cell, F.col(c))).over(page) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))}
    out = blocks.withColumn("_cell", cell)
    for c, e in edge.items():
        out = out.withColumn("_" + c, e)
    outside = (F.col("y1") <= F.col("_y0")) | (F.col("y0") >= F.col("_y1")) | (F.col("x1") <= F.col("_x0")) | (F.col("x0") >= F.col("_x1"))
    fine = F.col("_cell") | (X.is_page_furniture(F.col("text"), F.col("ocr"), F.col("is_chart")) & outside)
    return out.groupBy(*keys).agg((F.bool_or("_cell") & F.bool_and(F.coalesce(fine, F.lit(False)))).alias("redraw"))
