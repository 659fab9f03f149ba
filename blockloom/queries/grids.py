"""Spatial queries over grids of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import aggregates as A
from blockloom.operators import joins as J
from blockloom.operators import sequence as S
from blockloom.queries.registry import GRID, ITEMS, query
from blockloom.sources import ingest as I
from blockloom.sources import tables as T

P = ["page_no"]


def _grid(spark, d):
    return T.grid_cells(T.read(spark, d, "lineitem"))


@query("grid", f"WITH {GRID} SELECT * FROM grid")
def grid(spark, d):
    return _grid(spark, d)


def _regions(spark, d):
    """Per order: the left half is a table region (0), the whole page a text region (1), the last column a figure (2)."""
    pages = _grid(spark, d).groupBy("page_no").agg(F.max("y1").alias("h"))
    make = lambda no, kind, x0, x1: F.struct(F.lit(no).alias("region_no"), F.lit(kind).alias("kind"), F.lit(no).alias("level"), F.lit(x0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x1).alias("x1"), F.col("h").alias("y1"), F.array().cast("array<int>").alias("block_ids"))
    return pages.select("page_no", F.explode(F.array(make(0, "table", 0.0, 260.0), make(1, "text", 0.0, 460.0), make(2, "figure", 300.0, 900.0))).alias("r")).select("page_no", "r.*")


@query("region_claim", f"WITH {GRID} SELECT page_no, item_no AS block_id, CASE WHEN (x0 + x1) / 2 <= 260 THEN 0 WHEN (x0 + x1) / 2 <= 460 THEN 1 ELSE 2 END AS region_no, CASE WHEN (x0 + x1) / 2 <= 260 THEN 'table' WHEN (x0 + x1) / 2 <= 460 THEN 'text' ELSE 'figure' END AS kind, CASE WHEN (x0 + x1) / 2 <= 260 THEN 0 WHEN (x0 + x1) / 2 <= 460 THEN 1 ELSE 2 END AS level FROM grid")
def region_claim(spark, d):
    return J.claim_regions(_grid(spark, d).withColumnRenamed("item_no", "block_id"), _regions(spark, d), P)


@query("block_roles", f"WITH {GRID} SELECT page_no, CASE WHEN item_no % 10 = 4 THEN 'figure' WHEN (x0 + x1) / 2 <= 260 THEN 'table' ELSE 'text' END AS role, count(*) AS n FROM grid GROUP BY ALL")
def block_roles(spark, d):
    b = _grid(spark, d).withColumnRenamed("item_no", "block_id")
    return J.block_roles(b, J.claim_regions(b, _regions(spark, d), P), P).groupBy("page_no", "role").agg(F.count(F.lit(1)).alias("n"))


def _cells(spark, d):
    """Cells 100 wide and 20 high under every grid place; each is listed twice, so that the first must win."""
    li = T.numbered(T.read(spark, d, "lineitem"))
    at = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")
    rows = li.select(F.col("l_orderkey").alias("page_no"), F.col("row_no").alias("row"), at).withColumn("col", (F.col("k") % 5).cast("int"))
    x = F.when(F.col("col") == 0, 0.0).otherwise(F.col("col") * 120.0)
    return rows.select("page_no", "row", "col", (F.col("row") * 10 + F.col("k")).cast("int").alias("cell_no"), x.alias("x0"), (F.col("row") * 20.0 - 4).alias("y0"), (x + 100).alias("x1"), (F.col("row") * 20.0 + 16).alias("y1"))


@query("cell_assign", f"WITH {GRID} SELECT page_no, item_no, (row_no * 10 + col_no)::INTEGER AS cell_no, row_no AS row, col_no AS col FROM grid")
def cell_assign(spark, d):
    return J.assign_cells(_grid(spark, d), _cells(spark, d), P)


@query("cell_or_row", f"WITH {GRID} SELECT page_no, item_no, row_no AS row, CASE WHEN col_no = 0 THEN NULL ELSE col_no END AS col FROM grid")
def cell_or_row(spark, d):
    """Labels are moved out of their column: they only fall into their row."""
    moved = _grid(spark, d).withColumn("x0", F.when(F.col("col_no") == 0, -50.0).otherwise(F.col("x0"))).withColumn("x1", F.when(F.col("col_no") == 0, -40.0).otherwise(F.col("x1")))
    return J.assign_cells_or_rows(moved, _cells(spark, d), P)


@query("nearest_below", f"WITH {GRID}, n AS (SELECT a.page_no, a.item_no, min(b.y0) AS y FROM grid a JOIN grid b ON a.page_no = b.page_no AND a.item_no <> b.item_no AND b.y0 >= a.y1 - 0.5 AND b.x0 < a.x1 AND b.x1 > a.x0 GROUP BY ALL) SELECT page_no, item_no AS block_id, round(y - y1, 6) AS gap FROM grid LEFT JOIN n USING (page_no, item_no)")
def nearest_below(spark, d):
    return J.gap_below(_grid(spark, d).withColumnRenamed("item_no", "block_id"), P).select("page_no", "block_id", F.round("gap", 6).alias("gap"))


def _spans(spark, d):
    """Spans that drift to the left by two points a row, so that some collide with their neighbour."""
    g = _grid(spark, d)
    x0 = F.col("x0") - F.when(F.col("col_no") == 2, F.col("row_no") * 20.0).otherwise(0.0)
    return g.select("page_no", F.col("item_no").alias("span_no"), "text", x0.alias("x0"), F.col("y0"), (x0 + F.col("x1") - F.col("x0")).alias("x1"), F.col("y1"), (F.lit(10.0) - F.col("row_no")).alias("size"))


_SPANS = "spans AS (SELECT page_no, item_no AS span_no, text, x0 - CASE WHEN col_no = 2 THEN row_no * 20.0 ELSE 0 END AS x0, y0, x1 - CASE WHEN col_no = 2 THEN row_no * 20.0 ELSE 0 END AS x1, y1, 10.0 - row_no AS size FROM grid)"


@query(
    "span_overlap",
    f"""WITH {GRID}, {_SPANS},
    p AS (SELECT a.page_no, a.span_no AS a_no, b.span_no AS b_no, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS w, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS h,
                 least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small FROM spans a JOIN spans b ON a.page_no = b.page_no AND a.span_no < b.span_no)
    SELECT page_no, a_no, b_no, round(w * h / small, 6) AS share FROM p WHERE w > 0 AND h > 0 AND w * h / small >= 0.25""",
)
def span_overlap(spark, d):
    return J.colliding_spans(_spans(spark, d), P).withColumn("share", F.round("share", 6))


def _credited(spark, d):
    blocks = _grid(spark, d).withColumnRenamed("item_no", "block_id")
    spans = _spans(spark, d).where("span_no % 7 <> 0")
    return blocks, J.credited_blocks(spans, blocks, P)


_CREDIT = f"""WITH {GRID}, {_SPANS},
    c AS (SELECT s.page_no, s.span_no, b.item_no AS block_id, s.x0 AS sx0, s.y0 AS sy0, s.x1 AS sx1, s.y1 AS sy1, b.x0, b.y0, b.x1, b.y1, (b.y1 - b.y0) / 2 + 12 AS reach FROM spans s JOIN grid b USING (page_no) WHERE s.span_no % 7 <> 0 AND trim(b.text) <> ''),
    m AS (SELECT *, greatest(0, least(sx1, x1) - greatest(sx0, x0)) AS w, greatest(0, least(sy1, y1) - greatest(sy0, y0)) AS h,
                 greatest(0, least(sx1, x1 + 2) - greatest(sx0, x0 - 2)) AS nw, greatest(0, least(sy1, y1 + reach) - greatest(sy0, y0 - reach)) AS nh FROM c),
    k AS (SELECT *, CASE WHEN (sx0 + sx1) / 2 BETWEEN x0 AND x1 AND (sy0 + sy1) / 2 BETWEEN y0 AND y1 THEN 0 ELSE 1 END AS inside, greatest(0, y0 - sy1, sy0 - y1) AS dist FROM m
          WHERE (w > 0 AND h > 0 AND w * h >= 0.30 * (sx1 - sx0) * (sy1 - sy0)) OR (nw >= 0.5 * (sx1 - sx0) AND nh >= 0.5 * (sy1 - sy0))),
    best AS (SELECT page_no, span_no, block_id FROM k QUALIFY row_number() OVER (PARTITION BY page_no, span_no ORDER BY inside, dist, block_id) = 1)"""


@query("best_block", f"{_CREDIT} SELECT * FROM best")
def best_block(spark, d):
    return _credited(spark, d)[1]


@query("missing_block", f"{_CREDIT} SELECT g.page_no, g.item_no AS block_id FROM grid g ANTI JOIN best b ON g.page_no = b.page_no AND g.item_no = b.block_id WHERE trim(g.text) <> ''")
def missing_block(spark, d):
    blocks, credited = _credited(spark, d)
    return J.missing_blocks(blocks, credited, P).select("page_no", "block_id")


@query("nearest_point", f"WITH {GRID}, p AS (SELECT page_no, row_no AS point_no, row_no * 20.0 + 5 AS y FROM grid WHERE col_no = 1), c AS (SELECT p.page_no, point_no, item_no, greatest(0, x0 - 250, 250 - x1) + greatest(0, y0 - y, y - y1) AS dist FROM p JOIN grid USING (page_no)) SELECT page_no, point_no, arg_min(item_no, dist * 1000000 + item_no) AS block_id FROM c WHERE dist <= 60 GROUP BY ALL")
def nearest_point(spark, d):
    g = _grid(spark, d)
    y = F.col("row_no") * 20.0 + 5
    points = g.where("col_no = 1").select("page_no", F.col("row_no").alias("point_no"), F.lit(250.0).alias("x0"), y.alias("y0"), F.lit(250.0).alias("x1"), y.alias("y1"))
    return J.nearest_block(points, g.withColumnRenamed("item_no", "block_id"), P, 60.0)


@query("figure_gaps", f"WITH {GRID} SELECT a.page_no, a.item_no AS line_no, round(min(CASE WHEN b.y0 >= a.y1 AND b.x0 < a.x1 AND b.x1 > a.x0 THEN b.y0 - a.y1 END), 6) AS below, round(min(CASE WHEN b.x0 >= a.x1 AND b.y0 < a.y1 AND b.y1 > a.y0 THEN b.x0 - a.x1 END), 6) AS beside FROM grid a LEFT JOIN grid b ON a.page_no = b.page_no AND a.item_no <> b.item_no GROUP BY ALL")
def figure_gaps(spark, d):
    g = _grid(spark, d).withColumnRenamed("item_no", "line_no")
    return J.free_bands(g, g, P).select("page_no", "line_no", F.round("below", 6).alias("below"), F.round("beside", 6).alias("beside"))


@query("row_clusters", f"WITH {GRID} SELECT page_no, item_no, (dense_rank() OVER (PARTITION BY page_no ORDER BY row_no) - 1)::INTEGER AS row_id FROM grid")
def row_clusters(spark, d):
    return S.cluster_rows(_grid(spark, d), P).select("page_no", "item_no", "row_id")


@query("numeric_columns", f"WITH {GRID} SELECT page_no, col_no, count(*) AS cells, count(*) FILTER (WHERE col_no > 0) AS figures, bool_or(col_no > 0) AS strong, col_no > 0 AS numeric FROM grid GROUP BY ALL")
def numeric_columns(spark, d):
    return A.numeric_columns(_grid(spark, d), ["page_no", "col_no"])


_ROWS = f"""WITH {GRID}, r AS (SELECT page_no, row_no AS row_id, min(y0) AS y0, max(y1) AS y1 FROM grid GROUP BY ALL)"""


def _rows(spark, d):
    return _grid(spark, d).groupBy("page_no", F.col("row_no").alias("row_id")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))


@query("row_bands", f"{_ROWS}, c AS (SELECT *, (y0 + y1) / 2 AS c FROM r) SELECT page_no, row_id, coalesce((lag(c) OVER w + c) / 2, y0) AS top, coalesce((lead(c) OVER w + c) / 2, y1) AS bottom FROM c WINDOW w AS (PARTITION BY page_no ORDER BY row_id)")
def row_bands(spark, d):
    return S.row_bands(_rows(spark, d), P)


@query("fit_heights", f"{_ROWS} SELECT page_no, row_id, greatest(0, coalesce(lead(y0) OVER (PARTITION BY page_no ORDER BY row_id) - y0 - 1.5, 0)) AS fit_height FROM r")
def fit_heights(spark, d):
    return S.fit_heights(_rows(spark, d), P).select("page_no", "row_id", "fit_height")


@query("pushdown", f"WITH {GRID}, e AS (SELECT page_no, item_no, y0, (item_no % 3)::DOUBLE AS extra FROM grid) SELECT page_no, item_no, coalesce(sum(extra) OVER (PARTITION BY page_no ORDER BY y0 RANGE BETWEEN UNBOUNDED PRECEDING AND 0.000000001 PRECEDING), 0) AS shift FROM e")
def pushdown(spark, d):
    return S.push_down(_grid(spark, d).withColumn("extra", (F.col("item_no") % 3).cast("double")), P).select("page_no", "item_no", "shift")


@query("row_growth", f"{_ROWS} SELECT page_no, row_id AS row_no, coalesce(sum(greatest(0, row_id * 3.0 - 10)) OVER (PARTITION BY page_no ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cum FROM r")
def row_growth(spark, d):
    rows = _rows(spark, d).select("page_no", F.col("row_id").alias("row_no"), (F.col("row_id") * 3.0).alias("needed"), F.lit(10.0).alias("had"))
    return S.row_growth(rows, P).select("page_no", "row_no", "cum")


@query("continuation", f"WITH {GRID} SELECT page_no, item_no, max(y1 > 75) OVER (PARTITION BY page_no ORDER BY y0, item_no ROWS UNBOUNDED PRECEDING) AS moves FROM grid")
def continuation(spark, d):
    return S.continuation(_grid(spark, d).withColumn("ordinal", F.col("item_no")), P, 75.0).select("page_no", "item_no", "moves")


#: Rows with flags that follow their texts: figures where the characters of a row make a multiple of three, prose where they leave 1 by four.
_MARKED = f"""WITH {GRID}, r AS (SELECT page_no, row_no AS row_id, sum(length(text)) % 3 = 0 AS num, sum(length(text)) % 4 = 1 AS prose FROM grid GROUP BY ALL)"""


def _marked(spark, d):
    n = F.sum(F.length("text"))
    return _grid(spark, d).groupBy("page_no", F.col("row_no").alias("row_id")).agg((n % 3 == 0).alias("numeric"), (n % 4 == 1).alias("prose"))


@query("header_rows", f"{_MARKED} SELECT page_no, row_id AS row_no, min((NOT num)::INTEGER) OVER (PARTITION BY page_no ORDER BY row_id) = 1 AND row_number() OVER (PARTITION BY page_no ORDER BY row_id) <= 2 AND row_number() OVER (PARTITION BY page_no ORDER BY row_id) < count(*) OVER (PARTITION BY page_no) AS header FROM r")
def header_rows(spark, d):
    return S.header_rows(_marked(spark, d).withColumnRenamed("row_id", "row_no"), P).select("page_no", "row_no", "header")


@query(
    "prose_split",
    f"""{_MARKED}, m AS (SELECT *, min(row_id) FILTER (WHERE num) OVER w AS a, max(row_id) FILTER (WHERE num) OVER w AS z FROM r WINDOW w AS (PARTITION BY page_no)),
    e AS (SELECT *, max(row_id) FILTER (WHERE prose AND row_id < a) OVER w AS t, min(row_id) FILTER (WHERE prose AND row_id > z) OVER w AS b FROM m WINDOW w AS (PARTITION BY page_no))
    SELECT page_no, row_id, a IS NULL OR (row_id > coalesce(t, -1) AND row_id < coalesce(b, 1000000000)) AS in_table FROM e""",
)
def prose_split(spark, d):
    return S.prose_split(_marked(spark, d), P).select("page_no", "row_id", "in_table")


@query("table_edges", f"WITH {GRID} SELECT page_no, 0 AS table_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(DISTINCT row_no) AS rows, count(DISTINCT col_no) AS cols, list_sort(list_distinct(list(x0) || list(x1))) AS col_edges FROM grid GROUP BY page_no")
def table_edges(spark, d):
    return I.table_edges(_grid(spark, d).withColumnsRenamed({"row_no": "row", "col_no": "col"}).withColumn("table_no", F.lit(0)), P)


@query("table_gate", f"WITH {GRID}, n AS (SELECT page_no, row_no, count(*) AS k FROM grid WHERE length(text) % 4 <> 0 GROUP BY ALL) SELECT page_no, 0 AS table_no, count(*) AS rows, max(k) AS cols FROM n GROUP BY page_no HAVING count(*) >= 2 AND max(k) >= 2")
def table_gate(spark, d):
    """Ragged tables: cells with a multiple of four characters aren't there."""
    cells = _grid(spark, d).where("length(text) % 4 <> 0").withColumnsRenamed({"row_no": "row", "col_no": "col"}).withColumn("table_no", F.lit(0))
    return I.is_table(cells, P).select("page_no", "table_no", "rows", "cols")


@query(
    "borderless_tables",
    f"""WITH {GRID}, c AS (SELECT *, length(text) / 12.0 AS fill FROM grid WHERE length(text) % 4 <> 0), n AS (SELECT page_no, row_no, count(*) AS k FROM c GROUP BY ALL), s AS (SELECT page_no, count(*) AS rows, max(k) AS cols FROM n GROUP BY page_no),
    f AS (SELECT page_no, avg((k = cols)::INTEGER) AS full_rows FROM n JOIN s USING (page_no) GROUP BY page_no), m AS (SELECT page_no, median(fill) AS fill FROM c GROUP BY page_no)
    SELECT page_no, rows, cols FROM s JOIN f USING (page_no) JOIN m USING (page_no) WHERE rows >= 2 AND cols >= 2 AND full_rows >= 0.6 AND fill < 0.6""",
)
def borderless_tables(spark, d):
    cells = _grid(spark, d).where("length(text) % 4 <> 0").withColumnsRenamed({"row_no": "row", "col_no": "col"}).withColumns({"table_no": F.lit(0), "fill": F.length("text") / 12.0})
    return I.is_table(cells, P, borderless=True).select("page_no", "rows", "cols")


def _flagged(spark, d):
    g = _grid(spark, d)
    return g.select("page_no", F.col("item_no").alias("block_id"), "text", ((F.col("page_no") % 4 == 0) | ((F.col("page_no") % 4 == 1) & (F.col("col_no") == 0))).alias("ocr"), ((F.col("page_no") % 4 == 2) & (F.col("col_no") == 1)).alias("vertical"))


_KIND = "CASE WHEN page_no % 4 = 0 THEN 'scan' WHEN page_no % 4 = 2 AND count(DISTINCT row_no) >= 3 THEN 'chart' WHEN page_no % 4 = 1 THEN 'uncertain' WHEN page_no % 8 = 3 THEN 'formula' ELSE 'normal' END"


def _kinds(spark, d):
    b = _flagged(spark, d)
    pages = b.select("page_no").distinct()
    regions = pages.where("page_no % 8 = 3").select("page_no", F.explode(F.array(F.lit("formula"), F.lit("formula"), F.lit("text"))).alias("kind"))
    return A.page_kind(A.dominant_kind(pages, regions, P), b, P), b


@query("page_kind", f"WITH {GRID} SELECT page_no, {_KIND} AS kind FROM grid GROUP BY page_no")
def page_kind(spark, d):
    return _kinds(spark, d)[0]


@query(
    "doc_info",
    f"""WITH {GRID}, k AS (SELECT page_no, page_no % 50 AS doc_id, {_KIND} AS kind, count(*) AS n, sum(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) AS latin FROM grid GROUP BY page_no)
    SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE kind = 'normal') AS text_pages, count(*) FILTER (WHERE kind = 'scan') AS scan_pages, count(*) FILTER (WHERE kind = 'chart') AS chart_pages, 0::BIGINT AS table_pages,
           count(*) FILTER (WHERE kind = 'uncertain') AS uncertain_pages, count(*) FILTER (WHERE kind = 'formula') AS formula_pages, 0::BIGINT AS figure_pages, count(*) FILTER (WHERE kind <> 'normal') AS special_pages,
           sum(n)::BIGINT AS block_count, CASE WHEN sum(latin) > 0 THEN 'en' ELSE 'unknown' END AS language FROM k GROUP BY doc_id""",
)
def doc_info(spark, d):
    kinds, b = _kinds(spark, d)
    doc = F.col("page_no") % 50
    return A.document_info(kinds.withColumn("doc_id", doc), b.withColumn("doc_id", doc))


_REGION = "['formula', 'text', 'figure', 'table', 'heading'][length(text) % 5 + 1]"


@query(
    "structure_summary",
    f"""WITH {GRID}, k AS (SELECT page_no, count(*) FILTER (WHERE {_REGION} = 'formula') AS f, count(*) FILTER (WHERE {_REGION} = 'figure') AS g, count(*) FILTER (WHERE {_REGION} = 'table') AS t, count(*) FILTER (WHERE {_REGION} = 'text') AS x FROM grid GROUP BY page_no)
    SELECT page_no, CASE WHEN f > x THEN 'formula' WHEN g > x THEN 'figure' WHEN t > x THEN 'table' END AS dominant FROM k""",
)
def structure_summary(spark, d):
    """Regions whose kind follows the length of a cell's text."""
    g = _grid(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ["formula", "text", "figure", "table", "heading"])), (F.length("text") % 5 + 1).cast("int"))
    return A.dominant_kind(g.select("page_no").distinct(), g.select("page_no", kind.alias("kind")), P)


@query("geometric_headings", f"WITH {GRID}, b AS (SELECT page_no, item_no, row_no FROM grid WHERE col_no = 0 AND row_no % 2 = 0) SELECT page_no, item_no AS block_id, dense_rank() OVER (PARTITION BY page_no ORDER BY row_no DESC)::INTEGER AS level FROM b")
def geometric_headings(spark, d):
    g = _grid(spark, d).withColumnRenamed("item_no", "block_id")
    g = g.withColumns({"bold": (F.col("col_no") == 0) & (F.col("row_no") % 2 == 0), "single_line": F.lit(True), "in_table": F.lit(False), "is_chart": F.lit(False), "size": F.col("row_no").cast("double")})
    return I.geometric_regions(g, P).where("kind = 'heading'").select("page_no", F.col("block_ids")[0].alias("block_id"), F.col("level").cast("int").alias("level"))


@query("ocr_table_pages", f"WITH {GRID} SELECT page_no, page_no % 3 <> 1 AS redraw FROM grid GROUP BY page_no")
def ocr_table_pages(spark, d):
    """Scanned grids; one page in three also has a text-layer value inside of the table, which keeps it from redrawing."""
    g = _grid(spark, d)
    inner = (F.col("page_no") % 3 == 1) & (F.col("col_no") == 2)
    b = g.select("page_no", "text", "x0", "y0", "x1", "y1", (~inner).alias("ocr"), (~inner).alias("in_table"), F.lit(False).alias("is_chart"))
    return I.ocr_table_pages(b, P)


@query("rule_coverage", f"{_ROWS}, x AS (SELECT page_no, row_id, y0, row_id % 3 AS k FROM r) SELECT page_no, y0 AS y, 400.0::DOUBLE AS covered FROM x WHERE k = 0")
def rule_coverage(spark, d):
    """Rules drawn in segments: whole, with a gap (its last run begins inside of the table), and too short."""
    rows = _rows(spark, d)
    k = F.col("row_id") % 3
    seg = lambda a, b: F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"))
    parts = F.when(k == 0, F.array(seg(0, 200), seg(150, 400))).when(k == 1, F.array(seg(0, 190), seg(210, 400))).otherwise(F.array(seg(0, 100), seg(300, 400)))
    segs = rows.select("page_no", F.col("y0").alias("y"), F.explode(parts).alias("s")).select("page_no", "y", "s.x0", "s.x1", F.lit(0.0).alias("t_x0"), F.lit(400.0).alias("t_x1"))
    return A.rule_coverage(segs, P)


@query("label_merge", f"WITH {GRID} SELECT page_no, row_no AS row_id, string_agg(text, ' ' ORDER BY col_no) AS text, min(x0) AS x0, max(x1) AS x1, (row_no * 10)::INTEGER AS item_no FROM (SELECT page_no, row_no, col_no, 'L' || col_no AS text, col_no * 30.0::DOUBLE AS x0, col_no * 30.0 + 12.0::DOUBLE AS x1 FROM grid WHERE col_no < 3) GROUP BY page_no, row_no")
def label_merge(spark, d):
    """Three fragments of a label, 18 points apart, of each row."""
    g = _grid(spark, d).where("col_no < 3")
    x = F.col("col_no") * 30.0
    cells = g.select("page_no", F.col("row_no").alias("row_id"), "item_no", F.concat(F.lit("L"), F.col("col_no").cast("string")).alias("text"), x.alias("x0"), "y0", (x + 12.0).alias("x1"), "y1", F.lit(0).alias("col_id"), F.lit(False).alias("numeric"))
    return S.merge_labels(cells, P).select("page_no", "row_id", "text", "x0", "x1", "item_no")


@query("ocr_items", f"WITH {GRID} SELECT page_no, item_no, y0, x0, x1, y1, text, false AS fixed FROM grid WHERE item_no % 6 <> 5")
def ocr_items(spark, d):
    """Boxes as points; every sixth has a point that isn't finite and is dropped."""
    g = _grid(spark, d)
    nan = F.when(F.col("item_no") % 6 == 5, F.lit(float("nan"))).otherwise(F.col("x1"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(pt(F.col("x0"), F.col("y0")), pt(nan, F.col("y0")), pt(nan, F.col("y1")), pt(F.col("x0"), F.col("y1")))
    return I.clean_ocr(g.select("page_no", "item_no", "text", points.alias("points")), P)


@query("figure_regions", f"WITH {ITEMS}, i AS (SELECT l_orderkey AS page_no, row_no AS image_no, l_quantity * 3 AS w FROM li), k AS (SELECT *, row_number() OVER (PARTITION BY page_no, w ORDER BY image_no) AS dup FROM i WHERE w >= 24 AND w * 100 >= 2000 AND w * 100 <= 0.95 * 13000) SELECT page_no, image_no FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY image_no) AS n FROM k WHERE dup = 1) WHERE n <= 4")
def figure_regions(spark, d):
    li = T.numbered(T.read(spark, d, "lineitem"))
    images = li.select(F.col("l_orderkey").alias("page_no"), F.col("row_no").alias("image_no"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") * 3).alias("x1"), F.lit(100.0).alias("y1"), F.lit(13000.0).alias("page_area"))
    return I.figure_regions(images, P).select("page_no", "image_no")


@query("signatures", f"WITH {GRID} SELECT page_no, item_no FROM grid WHERE NOT (col_no = 0 AND row_no >= 4)")
def signatures(spark, d):
    """Labels from the fourth row on are made as high as handwriting at the foot of the page."""
    g = _grid(spark, d)
    ink = (F.col("col_no") == 0) & (F.col("row_no") >= 4)
    rows = g.withColumn("y1", F.when(ink, F.col("y0") + 40).otherwise(F.col("y1"))).withColumn("page_height", F.lit(100.0))
    return I.drop_signatures(rows, P).select("page_no", "item_no")


@query("finite_blocks", f"WITH {GRID} SELECT page_no, item_no FROM grid WHERE item_no % 10 <> 3")
def finite_blocks(spark, d):
    return I.finite_blocks(_grid(spark, d).withColumn("x1", F.when(F.col("item_no") % 10 == 3, F.lit(float("inf"))).otherwise(F.col("x1")))).select("page_no", "item_no")


@query("block_styles", "SELECT l_orderkey AS page_no, list_sort(list(l_quantity))[count(*) // 2 + 1] AS size, bool_or(l_linenumber = 3) AS bold, count(DISTINCT l_linenumber) <= 1 AS single_line FROM lineitem GROUP BY l_orderkey")
def block_styles(spark, d):
    li = T.read(spark, d, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("page_no"), F.col("l_quantity").alias("size"), (F.col("l_linenumber") == 3).alias("bold"), F.lit(0.0).alias("x0"), F.lit(50.0).alias("x1"), (F.col("l_linenumber") * 20.0).alias("y0"), F.lit(0.0).alias("b_x0"), F.lit(50.0).alias("b_x1"), F.lit(0.0).alias("p_x0"), F.lit(400.0).alias("p_x1"))
    return A.block_style(spans, P).select("page_no", "size", "bold", "single_line")


@query("lines_from_spans", f"WITH {ITEMS} SELECT l_orderkey AS page_no, string_agg(l_returnflag || l_linestatus, '' ORDER BY row_no) AS text, list_sort(list(l_quantity))[count(*) // 2 + 1] AS size, bool_or(row_no = 2) AS bold, min(row_no * 10.0)::DOUBLE AS x0, max(row_no * 10.0 + 8)::DOUBLE AS x1 FROM li GROUP BY l_orderkey")
def lines_from_spans(spark, d):
    li = T.numbered(T.read(spark, d, "lineitem"))
    x = F.col("row_no") * 10.0
    spans = li.select(F.col("l_orderkey").alias("page_no"), F.lit(0).alias("line_no"), F.col("row_no").alias("span_no"), F.concat("l_returnflag", "l_linestatus").alias("text"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 8).alias("x1"), F.lit(10.0).alias("y1"), F.col("l_quantity").alias("size"), F.when(F.col("row_no") == 2, 16).otherwise(0).alias("flags"), F.lit("Serif").alias("font"), (F.col("row_no") % 2).alias("color"))
    return I.lines_from_spans(spans, P).select("page_no", "text", "size", "bold", "x0", "x1")
