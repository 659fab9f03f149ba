"""Queries of the composite checks and of operators over pages made of phrases, with SQL that evaluates the same rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.audit import checks as C
from blockloom.operators import aggregates as A
from blockloom.operators import joins as J
from blockloom.operators import sequence as S
from blockloom.queries.grids import _CREDIT, _grid, _spans
from blockloom.queries.phrases import FIGURE, NEEDS, PH, _phrases, chosen, chosen_sql
from blockloom.queries.registry import BLOCKS, GRID, amounts_sql, query
from blockloom.sources import sinks as K
from blockloom.sources import tables as T

#: Pages of 40 documents: a heading, a phrase and an amount; every tenth page is a scan. Target pages differ by key: another
#: amount, heading or style, or ideographs left; of some documents a page is missing or one more, and some are bilingual.
WORDS = ["the report of the year", "营业收入增长", "risk and return", "现金流量"]
_PAGES = f"""
base AS (SELECT c_custkey AS k, c_custkey % 40 AS doc_id, (c_custkey // 40)::INTEGER AS page_no, {chosen_sql(WORDS, "c_custkey")} AS w, abs(c_acctbal)::DECIMAL(18,2) AS a FROM customer),
src AS (SELECT *, CASE WHEN k % 10 = 9 THEN '' ELSE 'Section ' || (page_no + 1) || ' Terms' || chr(10) || w || ' ' || format('{{:,.2f}}', a) END AS text, CASE WHEN k % 10 = 9 THEN 'total -5,138,116,000.00' ELSE '' END AS ocr_text, max(page_no) OVER (PARTITION BY doc_id) AS top FROM base),
made AS (SELECT *, CASE WHEN k % 20 = 9 THEN 'total 5,138,116,000.00' WHEN k % 20 = 19 THEN 'total -5,138,116,000.00'
                 ELSE CASE WHEN doc_id % 9 = 4 AND page_no % 2 = 1 THEN '' ELSE 'Section ' END || (page_no + 1 + (k % 6 = 0)::INTEGER) || CASE WHEN doc_id % 9 = 4 AND page_no % 2 = 1 THEN '. Terms' ELSE ' Terms' END || chr(10)
                      || CASE WHEN k % 4 = 1 OR k % 3 = 0 THEN w ELSE 'plain words' END || ' ' || format('{{:,.2f}}', a + (k % 5 = 0)::INTEGER) END AS target FROM src),
tgt AS (SELECT doc_id, page_no, target AS text FROM made WHERE doc_id % 7 NOT IN (0, 1) OR (doc_id % 7 = 0 AND page_no < top)
        UNION ALL SELECT doc_id, page_no * 2, text FROM made WHERE doc_id % 7 = 1 UNION ALL SELECT doc_id, page_no * 2 + 1, target FROM made WHERE doc_id % 7 = 1
        UNION ALL SELECT doc_id, top + 1, 'extra' FROM made WHERE doc_id % 7 = 2 AND page_no = top),
counts AS (SELECT * FROM (SELECT doc_id, count(*) AS ns FROM src GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS nt FROM tgt GROUP BY doc_id) USING (doc_id)),
paired AS (SELECT s.doc_id, s.page_no, s.k, s.text, s.ocr_text, t.text AS target FROM src s JOIN counts c USING (doc_id) JOIN tgt t ON t.doc_id = s.doc_id AND t.page_no = CASE WHEN c.nt = 2 * c.ns THEN 2 * s.page_no + 1 ELSE s.page_no END WHERE t.page_no < c.nt)"""


def _documents(spark, d):
    """(source, target) pages as told above."""
    k = F.col("c_custkey")
    base = T.read(spark, d, "customer").select(k.alias("k"), (k % 40).alias("doc_id"), F.floor(k / 40).cast("int").alias("page_no"), chosen(WORDS, k).alias("w"), F.abs("c_acctbal").cast("decimal(18,2)").alias("a"))
    k, p, odd = F.col("k"), F.col("page_no"), (F.col("doc_id") % 9 == 4) & (F.col("page_no") % 2 == 1)
    scan = k % 10 == 9
    lines = lambda head, body, amount: F.concat(head, F.lit("\n"), body, F.lit(" "), F.format_number(amount, 2))
    source = lines(F.concat(F.lit("Section "), (p + 1).cast("string"), F.lit(" Terms")), F.col("w"), F.col("a"))
    head = F.concat(F.when(odd, "").otherwise("Section "), (p + 1 + (k % 6 == 0).cast("int")).cast("string"), F.when(odd, ". Terms").otherwise(" Terms"))
    target = lines(head, F.when((k % 4 == 1) | (k % 3 == 0), F.col("w")).otherwise("plain words"), F.col("a") + (k % 5 == 0).cast("int"))
    made = base.select("k", "doc_id", "page_no", F.when(scan, "").otherwise(source).alias("text"), F.when(scan, "total -5,138,116,000.00").otherwise("").alias("ocr_text"), F.when(k % 20 == 9, "total 5,138,116,000.00").when(k % 20 == 19, "total -5,138,116,000.00").otherwise(target).alias("target"))
    made = made.withColumn("top", F.max("page_no").over(Window.partitionBy("doc_id")))
    group = F.col("doc_id") % 7
    page = lambda no, text: F.struct(no.alias("page_no"), text.alias("text"))
    none = F.array().cast("array<struct<page_no:int,text:string>>")
    own = F.when(group == 1, F.array(page(p * 2, F.col("text")), page(p * 2 + 1, F.col("target")))).when((group == 0) & (p == F.col("top")), none)
    own = own.when((group == 2) & (p == F.col("top")), F.array(page(p, F.col("target")), page(p + 1, F.lit("extra")))).otherwise(F.array(page(p, F.col("target"))))
    return made.select("doc_id", "page_no", "text", "ocr_text"), made.select("doc_id", F.explode(own).alias("t")).select("doc_id", "t.page_no", "t.text")


TERMS = [("risk and return", "Rendite"), ("the report", "plain"), ("absent", "x")]
_HEAD = "coalesce(try_cast(regexp_extract({0}, '^Section ([0-9]{{1,9}}) ', 1) AS BIGINT), try_cast(regexp_extract({0}, '^([0-9]{{1,2}})\\. [^0-9]', 1) AS BIGINT))"
_STYLE = "CASE WHEN regexp_matches(target, '^Section [0-9]{1,9} ') THEN 'word' WHEN regexp_matches(target, '^[0-9]{1,2}\\. [^0-9]') THEN 'plain' END"


@query(
    "document_check",
    f"""WITH {_PAGES}, real AS (SELECT * FROM paired WHERE text <> ''), a AS ({amounts_sql("real", "doc_id, page_no", "text")}), b AS ({amounts_sql("real", "doc_id, page_no", "target")}),
    sums AS (SELECT doc_id, page_no, value, sum(x) AS x, sum(y) AS y FROM (SELECT doc_id, page_no, value, 1 AS x, 0 AS y FROM a UNION ALL SELECT doc_id, page_no, value, 0, 1 FROM b) WHERE value IS NOT NULL GROUP BY ALL),
    whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS s, string_agg(target, chr(10) ORDER BY page_no) AS t FROM paired GROUP BY doc_id),
    terms(s, t) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in TERMS)})
    SELECT doc_id, NULL::INTEGER AS page_no, 'page_count' AS "check", abs(nt - ns) AS n FROM counts WHERE nt < ns OR (nt > ns AND nt <> 2 * ns)
    UNION ALL SELECT doc_id, page_no, 'numeric', count(*) FROM sums WHERE x <> y GROUP BY ALL
    UNION ALL SELECT doc_id, page_no, 'residual', length(target) - length(regexp_replace(target, '[一-鿿]', '', 'g')) FROM paired WHERE regexp_matches(target, '[一-鿿]')
    UNION ALL SELECT doc_id, page_no, 'sections', 1 FROM real WHERE {_HEAD.format("text")} IS DISTINCT FROM {_HEAD.format("target")}
    UNION ALL SELECT doc_id, NULL, 'style', count(DISTINCT {_STYLE}) FROM real GROUP BY doc_id HAVING count(DISTINCT {_STYLE}) > 1
    UNION ALL SELECT doc_id, page_no, 'signs', 1 FROM paired WHERE text = '' AND contains(ocr_text, '-5,138') AND NOT contains(target, '-5,138')
    UNION ALL SELECT doc_id, NULL, 'glossary', count(*) FROM whole w JOIN terms g ON contains(w.s, g.s) AND NOT contains(w.t, g.t) GROUP BY doc_id""",
)
def document_check(spark, d):
    """Page counts, amounts, ideographs left, headings, their style, signs of scans and terms of 40 documents."""
    terms = spark.createDataFrame(TERMS, "source string, target string")
    return C.document_check(*_documents(spark, d), ["doc_id"], glossary=terms)


@query("extra_pages", f"WITH {_PAGES}, pairs AS (SELECT s.doc_id, CASE WHEN c.nt = 2 * c.ns THEN 2 * s.page_no + 1 ELSE s.page_no END AS page_no FROM src s JOIN counts c USING (doc_id)) SELECT doc_id, page_no FROM tgt ANTI JOIN pairs USING (doc_id, page_no)")
def extra_pages(spark, d):
    source, target = _documents(spark, d)
    return C.extra_pages(target, J.pair_pages(source, target, None, ["doc_id"]), ["doc_id"])


_LIVE = """pg AS (SELECT page_no, page_no % 50 AS doc_id, (row_number() OVER (PARTITION BY page_no % 50 ORDER BY page_no) - 1)::INTEGER AS p, count(*) OVER (PARTITION BY page_no % 50) AS ns FROM (SELECT DISTINCT page_no FROM grid)),
live AS (SELECT * FROM pg WHERE doc_id % 3 <> 1 OR p < ns - 1), s AS (SELECT * FROM spans JOIN live USING (page_no) WHERE span_no % 7 <> 0)"""


@query(
    "layout_check",
    f"""{_CREDIT}, {_LIVE}
    SELECT a.doc_id, a.p AS page_no, 'overlap' AS "check", a.span_no::BIGINT AS item FROM s a JOIN s b ON a.page_no = b.page_no AND a.span_no < b.span_no
      WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.25
    UNION ALL SELECT doc_id, p, 'off_page', span_no FROM s WHERE x0 < -1 OR x1 > 571 OR y1 > 131
    UNION ALL SELECT doc_id, p, 'rule', span_no FROM s WHERE span_no % 2 = 1 AND (y1 - y0) * 0.6 >= 1 AND 45 BETWEEN y0 + (y1 - y0) * 0.2 AND y1 - (y1 - y0) * 0.2 AND x1 > 0 AND x0 < 500
    UNION ALL SELECT doc_id, p, 'small', span_no FROM s LEFT JOIN best USING (page_no, span_no) WHERE size < CASE WHEN block_id IS NULL THEN 3.0 ELSE 6.3 END - 0.01
    UNION ALL SELECT doc_id, p, 'missing', item_no FROM grid JOIN live USING (page_no) WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM best b WHERE b.page_no = grid.page_no AND b.block_id = grid.item_no)
    UNION ALL SELECT doc_id, p, 'page_size', p FROM live WHERE p % 5 = 0
    UNION ALL SELECT DISTINCT doc_id, ns::INTEGER, 'extra_page', ns FROM pg WHERE doc_id % 3 = 2""",
)
def layout_check(spark, d):
    """Orders as the pages of 50 documents; spans move to the left row by row, every seventh isn't drawn."""
    g, doc = _grid(spark, d), ["doc_id"]
    own = F.col("page_no") % 50
    pages = g.select(F.col("page_no").alias("okey"), own.alias("doc_id")).distinct()
    order = Window.partitionBy("doc_id")
    pages = pages.withColumn("page_no", F.row_number().over(order.orderBy("okey")) - 1).withColumn("ns", F.count(F.lit(1)).over(order))
    source = pages.select("doc_id", "page_no", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    live = pages.where((F.col("doc_id") % 3 != 1) | (F.col("page_no") < F.col("ns") - 1))
    target = live.select("doc_id", "page_no", F.when(F.col("page_no") % 5 == 0, 601.5).otherwise(600.5).alias("width"), F.lit(800.0).alias("height"))
    target = target.unionByName(pages.where("doc_id % 3 = 2").select("doc_id", F.col("ns").cast("int").alias("page_no"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct())
    at = lambda rows, on: rows.withColumnRenamed("page_no", "okey").join(on.select("okey", "doc_id", "page_no"), "okey").drop("okey")
    spans = at(_spans(spark, d).where("span_no % 7 <> 0"), live).withColumns({"page_x0": F.lit(0.0), "page_x1": F.lit(570.0), "page_y1": F.lit(130.0), "source_ink": F.col("span_no") % 2 == 0})
    blocks = at(g.withColumnRenamed("item_no", "block_id"), pages).withColumn("floor", F.lit(6.3))
    rules = live.select("doc_id", "page_no", F.lit(45.0).alias("y"), F.lit(0.0).alias("x0"), F.lit(500.0).alias("x1"))
    return C.layout_check(source, target, spans, blocks, rules, doc)


BANKS = ["Huishang Bank announced", "Beijing Bank announced", "the Company announced", "Huishang Bank met Everbright Bank", "nobody"]


@query(
    "entity_anchor",
    f"""WITH p AS (SELECT c_custkey % 25 AS doc_id, (c_custkey // 25)::INTEGER AS page_no, CASE WHEN c_custkey % 3 = 0 THEN '今日公告' ELSE '徽商银行今日' END AS source, {chosen_sql(BANKS, "c_custkey // 25 * 3 + CASE WHEN c_custkey // 25 % 4 = 0 THEN c_custkey ELSE 0 END")} AS target FROM customer),
    n AS (SELECT *, regexp_extract_all(target, '[A-Z][a-z]+ Bank') AS names FROM p),
    each AS (SELECT doc_id, page_no, unnest(names) AS name, unnest(range(len(names))) AS pos FROM n),
    top AS (SELECT doc_id, arg_min(name, -k * 1000000000 + f) AS dominant FROM (SELECT doc_id, name, count(*) AS k, min(page_no * 1000 + pos) AS f FROM each GROUP BY ALL) GROUP BY doc_id),
    own AS (SELECT DISTINCT doc_id FROM p WHERE contains(source, '徽商银行'))
    SELECT n.doc_id, n.page_no, '徽商银行' AS own, dominant, list_sort(list_distinct(list_filter(list_transform(names, lambda x: lower(string_split(x, ' ')[1])), lambda x: x <> lower(string_split(dominant, ' ')[1])))) ::VARCHAR AS foreign_words
    FROM n JOIN top USING (doc_id) JOIN own USING (doc_id) WHERE contains(source, '徽商银行') AND len(names) > 0 AND NOT list_contains(names, dominant)""",
)
def entity_anchor(spark, d):
    """Pages that name their bank in the source; some targets name another one."""
    k = F.col("c_custkey")
    page = F.floor(k / 25).cast("int")
    pages = T.read(spark, d, "customer").select((k % 25).alias("doc_id"), page.alias("page_no"), F.when(k % 3 == 0, "今日公告").otherwise("徽商银行今日").alias("source"), chosen(BANKS, page * 3 + F.when(page % 4 == 0, k).otherwise(0)).alias("target"))
    out = A.entity_anchor(pages, ["doc_id"])
    return out.select("doc_id", "page_no", "own", "dominant", F.concat(F.lit("["), F.array_join("foreign", ", "), F.lit("]")).alias("foreign_words"))


# -- tables and pages -----------------------------------------------------------------------------------------


@query(
    "cell_texts",
    f"""WITH {GRID}, runs AS (SELECT page_no, row_no // 3 AS row, col_no // 2 AS col, item_no, text, x0, row_no // 2 * 20.0 + CASE WHEN col_no = 1 THEN 0.5 ELSE 0 END AS y0, x1 FROM grid),
    l AS (SELECT page_no, row, col, round(y0 / 20) AS line, string_agg(text, ' ' ORDER BY item_no) AS t, min(x0) AS x0, max(x1) AS x1 FROM runs GROUP BY ALL)
    SELECT page_no, row, col, string_agg(t, chr(10) ORDER BY line) AS text, min(x0) AS x0, max(x1) AS x1, count(*) AS lines FROM l GROUP BY ALL""",
)
def cell_texts(spark, d):
    """Three rows and two columns of an order's grid make one cell; two rows share a visual line."""
    g = _grid(spark, d)
    y = F.floor(F.col("row_no") / 2) * 20.0 + F.when(F.col("col_no") == 1, 0.5).otherwise(0.0)
    runs = g.select("page_no", F.floor(F.col("row_no") / 3).alias("row"), F.floor(F.col("col_no") / 2).alias("col"), F.col("item_no").alias("line_no"), "text", "x0", y.alias("y0"), "x1", (y + 10).alias("y1"))
    return S.cell_texts(runs, ["page_no"]).select("page_no", "row", "col", "text", "x0", "x1", "lines")


@query(
    "ocr_grid",
    f"""WITH {GRID}, own AS (SELECT page_no, row_no, col_no, col_no * 100.0::DOUBLE AS x0, y0, col_no * 100.0::DOUBLE + 60 AS x1, y1 FROM grid WHERE page_no % 3 <> 0 OR col_no = 0), t AS (SELECT page_no FROM own GROUP BY page_no HAVING count(*) >= 4 AND count(DISTINCT row_no) >= 2 AND count(DISTINCT col_no) >= 2),
    r AS (SELECT page_no, row_no, min(y0) AS y0, max(y1) AS y1 FROM own GROUP BY ALL), c AS (SELECT page_no, col_no, min(x0) AS x0, max(x1) AS x1 FROM own GROUP BY ALL)
    SELECT page_no, (row_number() OVER (PARTITION BY page_no, col_no ORDER BY row_no) - 1)::INTEGER AS row_id, col_no AS col_id, x0, y0, x1, y1 FROM t JOIN r USING (page_no) JOIN c USING (page_no)""",
)
def ocr_grid(spark, d):
    """Grids of scanned cells; every third page has its labels only and is no table."""
    g = _grid(spark, d).where("page_no % 3 <> 0 or col_no = 0")
    x = F.col("col_no") * 100.0
    return S.ocr_grid(g.select("page_no", "item_no", "text", x.alias("x0"), "y0", (x + 60.0).alias("x1"), "y1"), ["page_no"])


_FLOW = """WITH RECURSIVE el AS (SELECT l_orderkey AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n, l_linenumber % 4 = 3 AS prose, l_quantity::DOUBLE * 2 AS h FROM lineitem),
walk AS (
  SELECT page_no, n, 0 AS page, 36.0::DOUBLE + CASE WHEN prose THEN 0 ELSE 15 END AS y, CASE WHEN prose THEN 0.0 ELSE 15.0 END::DOUBLE AS repeated, 36.0::DOUBLE + CASE WHEN prose THEN 0 ELSE 15 END + h AS after, NOT prose AS shown FROM el WHERE n = 1
  UNION ALL
  SELECT page_no, n, page, y, lead, y + h, shown FROM (
    SELECT e.page_no, e.n, e.h, w.page + fresh::INTEGER AS page, CASE WHEN prose THEN 0.0 WHEN fresh OR NOT w.shown THEN 15.0 ELSE 0.0 END::DOUBLE AS lead, CASE WHEN fresh THEN 36.0 ELSE w.after END + CASE WHEN prose THEN 0.0 WHEN fresh OR NOT w.shown THEN 15.0 ELSE 0.0 END AS y, CASE WHEN fresh THEN NOT prose ELSE w.shown OR NOT prose END AS shown
    FROM (SELECT e.*, w.after + CASE WHEN e.prose OR w.shown THEN 0 ELSE 15 END + e.h > 264 AS fresh FROM walk w JOIN el e ON e.page_no = w.page_no AND e.n = w.n + 1) e JOIN walk w ON w.page_no = e.page_no AND w.n = e.n - 1)
) SELECT page_no, n, page, y, repeated FROM walk"""


@query("continuation_pages", _FLOW)
def continuation_pages(spark, d):
    """An order's lines as elements that moved off a page: every fourth is prose, the others rows of a table with a header."""
    li = T.numbered(T.read(spark, d, "lineitem"))
    rows = li.select(F.col("l_orderkey").alias("page_no"), F.col("row_no").alias("ordinal"), F.when(F.col("l_linenumber") % 4 == 3, "prose").otherwise("row").alias("kind"), F.lit(0).alias("table_no"), F.lit(False).alias("is_header"), (F.col("l_quantity").cast("double") * 2).alias("height"), F.lit(0.0).alias("orig_y0"), F.lit(0.0).alias("orig_y1"), F.lit(15.0).alias("head"))
    return S.continuation_pages(rows, ["page_no"], 300.0).select("page_no", F.col("ordinal").cast("long").alias("n"), "page", "y", "repeated")


# -- plans, policies, texts -----------------------------------------------------------------------------------


@query(
    "plan_summaries",
    f"""WITH {BLOCKS}, kinds AS (SELECT DISTINCT doc_id, page_no, ['normal', 'scan', 'normal', 'chart', 'uncertain'][(doc_id + page_no) % 5 + 1] AS kind FROM blocks),
    t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM blocks), x AS (SELECT doc_id, page_no, count(*) AS n, string_agg(c[1:60], ' / ' ORDER BY block_id) FILTER (WHERE r <= 3 AND c <> '') AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, c = '' ORDER BY block_id) AS r FROM t) GROUP BY ALL),
    l AS (SELECT doc_id, page_no, kind, n, 'page ' || (page_no + 1) || ' [' || kind || '] ' || n || ' blocks' || coalesce(': ' || x, '') AS line FROM kinds JOIN x USING (doc_id, page_no)),
    o AS (SELECT doc_id, 'pages=' || count(*) || ' blocks=' || sum(n) || ' normal=' || count(*) FILTER (WHERE kind = 'normal') || ' scan=' || count(*) FILTER (WHERE kind = 'scan') || ' chart=' || count(*) FILTER (WHERE kind = 'chart') || ' uncertain=' || count(*) FILTER (WHERE kind = 'uncertain') || chr(10) || string_agg(line, chr(10) ORDER BY kind = 'normal', page_no) AS text FROM l GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(text) > 600 THEN text[1:600] || chr(10) || '…' ELSE text END AS text FROM o""",
)
def plan_summaries(spark, d):
    b = T.line_blocks(T.read(spark, d, "documents"))
    pages = b.select("doc_id", "page_no").distinct().withColumn("kind", chosen(["normal", "scan", "normal", "chart", "uncertain"], F.col("doc_id") + F.col("page_no")))
    return A.plan_summary(pages, b, ["doc_id"], budget=600)


@query("picked_blocks", f"WITH {PH}, asked AS (SELECT id % 10 AS doc_id, id AS pos, (id * 7 + 3) % 400 AS block_id FROM ph UNION ALL SELECT id % 10, id + 1000000, (id * 3) % 400 FROM ph), f AS (SELECT doc_id, block_id, min(pos) AS pos FROM asked GROUP BY ALL), ok AS (SELECT id % 10 AS doc_id, id AS block_id FROM ph WHERE {NEEDS} AND NOT {FIGURE}) SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, block_id) - 1 AS rank FROM f SEMI JOIN ok USING (doc_id, block_id)")
def picked_blocks(spark, d):
    """Blocks asked for twice, out of range, of other documents, figures among them."""
    rows = _phrases(spark, d)
    i = F.col("id")
    asked = rows.select((i % 10).alias("doc_id"), F.explode(F.array(F.struct(i.alias("pos"), ((i * 7 + 3) % 400).alias("block_id")), F.struct((i + 1000000).alias("pos"), ((i * 3) % 400).alias("block_id")))).alias("a")).select("doc_id", "a.pos", "a.block_id")
    return J.pick_translatable(asked, rows.select((i % 10).alias("doc_id"), i.alias("block_id"), "text")).withColumn("rank", F.col("rank").cast("long"))


@query("bilingual_markdown", f"WITH {BLOCKS}, p AS (SELECT doc_id, page_no, '## Page ' || (page_no + 1) || chr(10) || chr(10) || coalesce(string_agg('x ' || lower(text) || chr(10) || chr(10) || '<details><summary>source</summary>' || chr(10) || chr(10) || '> ' || text || chr(10) || chr(10) || '</details>' || chr(10), chr(10) ORDER BY block_id) FILTER (WHERE regexp_matches(text, '[A-Z]')), '') AS t FROM blocks GROUP BY doc_id, page_no) SELECT doc_id, string_agg(t, chr(10) ORDER BY page_no) AS text FROM p GROUP BY doc_id")
def bilingual_markdown(spark, d):
    """Blocks without a capital letter have no target."""
    b = T.line_blocks(T.read(spark, d, "documents")).withColumn("target", F.when(F.col("text").rlike("[A-Z]"), F.concat(F.lit("x "), F.lower("text"))).otherwise(""))
    return K.markdown(b.select("doc_id", "page_no").distinct(), b, ["doc_id"])


# -- scans and tables -----------------------------------------------------------------------------------------


@query(
    "table_bodies",
    f"""WITH {GRID}, t AS (SELECT page_no, row_no AS table_no, min(x0) AS tx0, min(y0) AS ty0, max(x1) AS tx1, max(y1) AS ty1 FROM grid WHERE row_no % 4 = 2 AND col_no < 3 GROUP BY ALL),
    l AS (SELECT *, coalesce(lag(ty1) OVER w, -1e9) AS f, coalesce(lead(ty0) OVER w, 1e9) AS u FROM t WINDOW w AS (PARTITION BY page_no ORDER BY ty0, table_no)),
    i AS (SELECT page_no, item_no, text, x0, x1, y0 + CASE WHEN row_no % 7 = 6 THEN 9 ELSE 0 END AS y0, y1 + CASE WHEN row_no % 7 = 6 THEN 9 ELSE 0 END AS y1 FROM grid WHERE row_no % 4 <> 2),
    n AS (SELECT i.*, table_no, CASE WHEN y0 >= ty1 AND y1 <= u THEN 'below' WHEN y1 <= ty0 AND y0 >= f THEN 'above' END AS side, ty0, ty1 FROM i JOIN l USING (page_no) WHERE x0 < tx1 AND x1 > tx0),
    d AS (SELECT *, CASE side WHEN 'below' THEN y0 - ty1 ELSE ty0 - y1 END AS s, CASE side WHEN 'below' THEN y1 - ty1 ELSE ty0 - y0 END AS e FROM n WHERE side IS NOT NULL),
    g AS (SELECT *, (s - coalesce(max(e) OVER (PARTITION BY page_no, table_no, side ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 12)::INTEGER AS apart FROM d)
    SELECT page_no, table_no, side, count(*) AS items, min(item_no) AS first FROM (SELECT *, max(apart) OVER (PARTITION BY page_no, table_no, side ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS stop FROM g) WHERE stop = 0 GROUP BY ALL""",
)
def table_bodies(spark, d):
    """Every fourth row of an order as a ruled table of three columns; the other rows may be its body."""
    from blockloom.sources import ingest as I

    g = _grid(spark, d)
    tables = g.where("row_no % 4 = 2 and col_no < 3").groupBy("page_no", F.col("row_no").alias("table_no")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    lower = F.when(F.col("row_no") % 7 == 6, 9.0).otherwise(0.0)
    items = g.where("row_no % 4 <> 2").select("page_no", "item_no", "text", "x0", (F.col("y0") + lower).alias("y0"), "x1", (F.col("y1") + lower).alias("y1"))
    found = I.body_items(items, tables, ["page_no"], most=12.0)
    return found.groupBy("page_no", "table_no", "side").agg(F.count(F.lit(1)).alias("items"), F.min("item_no").alias("first"))


@query("cached_ocr", f"WITH {GRID} SELECT page_no, item_no, text, page_no % 3 = 0 AS fresh FROM grid WHERE NOT (page_no % 3 = 0 AND item_no % 6 = 5)")
def cached_ocr(spark, d):
    """Pages whose items are in the cache, and others that the recogniser reads, where every sixth item has no box."""
    from blockloom.sources import ingest as I

    g = _grid(spark, d).withColumn("page_key", I.ocr_key(F.col("page_no").cast("string"), F.lit(1), F.lit(2)))
    points = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    cache = g.where("page_no % 3 <> 0").select("page_key", "item_no", points.alias("points"), "text")
    read = g.select("page_key", "item_no", F.when(F.col("item_no") % 6 != 5, points).alias("points"), "text")
    items, fresh = I.ocr_pages(g.select("page_key", "page_no").distinct(), cache, lambda todo: read.join(todo.select("page_key"), "page_key", "left_semi"), ["page_no"])
    new = fresh.select("page_key").distinct().join(g.select("page_key", "page_no").distinct(), "page_key").select("page_no", F.lit(True).alias("fresh"))
    return items.select("page_no", "item_no", "text").join(new, "page_no", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


@query(
    "merged_blocks",
    f"""WITH {BLOCKS}, b AS (SELECT doc_id, page_no, block_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM blocks WHERE length(text) % 3 <> 0), o AS (SELECT doc_id, page_no, block_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM blocks WHERE length(text) % 2 = 0),
    n AS (SELECT doc_id, page_no, block_id, true AS ocr FROM o WHERE t <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = o.doc_id AND b.page_no = o.page_no AND b.block_id = o.block_id AND b.t <> '' AND (contains(o.t, b.t) OR contains(b.t, o.t))) UNION ALL SELECT doc_id, page_no, block_id, false FROM b)
    SELECT doc_id, page_no, block_id, ocr, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_id, ocr) - 1)::INTEGER AS read_no FROM n""",
)
def merged_blocks(spark, d):
    """A text layer that lacks lines and a scan that has some of them, one below the other."""
    b = T.line_blocks(T.read(spark, d, "documents")).withColumn("item_no", F.col("block_id"))
    b = b.withColumns({"x0": F.lit(10.0), "y0": F.col("block_id") * 20.0, "x1": F.lit(200.0), "y1": F.col("block_id") * 20.0 + 12.0})
    rows = b.select("doc_id", "page_no", "block_id", "item_no", "text", "x0", "y0", "x1", "y1")
    out = J.merged_blocks(rows.where("length(text) % 3 <> 0"), rows.where("length(text) % 2 = 0"), ["doc_id", "page_no"])
    return out.select("doc_id", "page_no", "block_id", "ocr", "read_no")


_ASKED = f"""WITH {PH}, b AS (SELECT id % 10 AS doc_id, id // 10 AS block_id, id // 50 AS page_no FROM ph), asked AS (SELECT id % 10 AS doc_id, id // 10 * CASE WHEN id % 7 = 0 THEN 9 ELSE 1 END AS block_id, id // 50 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS page_no FROM ph)"""


def _asked(spark, d):
    i = F.col("id")
    rows, part = _phrases(spark, d), lambda n: F.floor(i / n).cast("long")
    blocks = rows.select((i % 10).alias("doc_id"), part(10).alias("block_id"), part(50).alias("page_no"), (i % 4 == 0).alias("keep_original"), (i % 6 == 0).alias("released"))
    asked = rows.select((i % 10).alias("doc_id"), (part(10) * F.when(i % 7 == 0, 9).otherwise(1)).alias("block_id"), (part(50) + F.when(i % 3 == 0, 1).otherwise(0)).alias("page_no"))
    return asked, blocks


@query("page_guard", f"{_ASKED} SELECT a.doc_id, a.block_id, a.page_no, b.page_no AS actual_page FROM asked a LEFT JOIN b USING (doc_id, block_id) WHERE b.page_no IS DISTINCT FROM a.page_no")
def page_guard(spark, d):
    """Blocks asked for on a page that they aren't on, or that don't exist."""
    return J.on_page(*_asked(spark, d))[1].select("doc_id", "block_id", "page_no", "actual_page")


@query("scoped_blocks", f"{_ASKED}, s AS (SELECT DISTINCT doc_id, page_no FROM asked WHERE page_no % 2 = 1), k AS (SELECT id % 10 AS doc_id, id // 10 AS block_id, id // 50 AS page_no, id % 4 = 0 AS keep, id % 6 = 0 AS rel FROM ph) SELECT k.doc_id, block_id, keep OR s.page_no IS NULL AS keep_original, rel AND s.page_no IS NOT NULL AS released FROM k LEFT JOIN s USING (doc_id, page_no)")
def scoped_blocks(spark, d):
    """Odd pages are in scope; other blocks keep their text and aren't released."""
    asked, blocks = _asked(spark, d)
    return J.in_scope(blocks, asked.where("page_no % 2 = 1"))[0].select("doc_id", "block_id", "keep_original", "released")


@query("scope_mismatch", f"{_ASKED} SELECT DISTINCT doc_id, page_no FROM asked WHERE page_no % 2 = 1 AND (doc_id, page_no) NOT IN (SELECT doc_id, page_no FROM b)")
def scope_mismatch(spark, d):
    asked, blocks = _asked(spark, d)
    return J.in_scope(blocks, asked.where("page_no % 2 = 1"))[1]
