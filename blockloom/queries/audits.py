"""Audit and score queries over documents with derived targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.audit import checks as C
from blockloom.audit import scores as E
from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.operators import layout as L
from blockloom.operators import replies as R
from blockloom.operators.aggregates import judge_mean, page_progress
from blockloom.queries.documents import _FORMULA
from blockloom.queries.phrases import chosen, chosen_sql
from blockloom.queries.registry import BLOCKS, PAIRS, query, signature_sql
from blockloom.sources import tables as T

K = ["doc_id", "page_no"]


def _pairs(spark, d):
    b = T.line_blocks(T.read(spark, d, "documents"))
    b = b.withColumn("target", T.derived_target(F.col("doc_id") + F.col("block_id"), F.col("text")))
    return b.withColumns({n: F.lit(False) for n in ("is_chart", "keep_original", "in_table", "ocr", "vertical", "in_image")})


_NUMCELL = "regexp_matches(text, '^\\s*[（(－\\-−]?\\s*(?:\\d{1,3}(?:\\s*[，,]\\s*\\d{3})+(?:\\s*[.．]\\s*\\d+)?|\\d+(?:\\s*[.．]\\s*\\d+)?)\\s*[%％]?\\s*[）)]?\\s*$')"
_OPEN = f"regexp_matches(text, '\\p{{L}}') AND NOT {_FORMULA} AND NOT {_NUMCELL}"
_SAME = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(target, '\\s+', ' ', 'g'))) AND (length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 12 OR len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 3)"
_LATIN = "NOT regexp_matches(target, '[一-鿿]') AND len(regexp_extract_all(target, '[A-Za-z]+(?:[’''-][A-Za-z]+)*')) >= 3"


@query("derived_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def derived_pairs(spark, d):
    return _pairs(spark, d).select("doc_id", "page_no", "block_id", "text", "target")


@query("residual_latin", f"WITH {PAIRS} SELECT doc_id, page_no, block_id, CASE WHEN trim(target) = '' THEN 'empty' ELSE 'residual_latin' END AS kind FROM pairs WHERE {_OPEN} AND (trim(target) = '' OR ({_LATIN}))")
def residual_latin(spark, d):
    return C.residual(_pairs(spark, d), K, True).select(*K, "block_id", "kind")


@query("residual_cjk", f"WITH {PAIRS} SELECT doc_id, page_no, block_id, 'empty' AS kind FROM pairs WHERE {_OPEN} AND trim(target) = ''")
def residual_cjk(spark, d):
    return C.residual(_pairs(spark, d), K).select(*K, "block_id", "kind")


@query("missing", f"WITH {PAIRS} SELECT doc_id, page_no, block_id FROM pairs WHERE {_OPEN} AND trim(target) = ''")
def missing(spark, d):
    return C.missing(_pairs(spark, d), K).select(*K, "block_id")


_NUMBERS = f"""WITH {PAIRS}, open AS (SELECT * FROM pairs WHERE {_OPEN} AND trim(target) <> ''), a AS ({signature_sql("open", "doc_id, page_no, block_id", "text")}), b AS ({signature_sql("open", "doc_id, page_no, block_id", "target")}),
    sums AS (SELECT doc_id, page_no, block_id, value, sum(x) AS x, sum(fx) AS fx, sum(y) AS y, sum(fy) AS fy FROM (SELECT doc_id, page_no, block_id, value, 1 AS x, figure::INTEGER AS fx, 0 AS y, 0 AS fy FROM a UNION ALL SELECT doc_id, page_no, block_id, value, 0, 0, 1, figure::INTEGER FROM b) GROUP BY ALL),
    lost AS (SELECT doc_id, page_no, block_id, value, greatest(x - y, 0)::BIGINT AS missing, greatest(fy - fx, 0)::BIGINT AS extra FROM sums WHERE x > y OR fy > fx)"""


@query("number_check", f"{_NUMBERS} SELECT * FROM lost")
def number_check(spark, d):
    """Block values lost or made up."""
    return C.number_findings(_pairs(spark, d), K)


@query("table_completeness", f"WITH {PAIRS} SELECT doc_id, page_no, count(*) FILTER (WHERE block_id % 2 = 0) AS source_cells, count(*) FILTER (WHERE block_id % 2 = 0 AND trim(target) <> '') AS translated_cells, count(*) FILTER (WHERE block_id % 2 = 0 AND trim(target) = '') AS empty_cells, count(*) FILTER (WHERE block_id % 2 = 1 AND trim(target) = '') AS empty_text, count(*) FILTER (WHERE trim(target) = '') = 0 AS complete FROM pairs WHERE {_OPEN} GROUP BY ALL")
def table_completeness(spark, d):
    return C.table_completeness(_pairs(spark, d).withColumn("in_table", F.col("block_id") % 2 == 0), K)


@query("page_progress", f"WITH {PAIRS} SELECT doc_id, page_no, count(*) FILTER (WHERE {_OPEN}) AS translatable, count(*) FILTER (WHERE {_OPEN} AND trim(target) <> '') AS translated FROM pairs GROUP BY ALL")
def progress(spark, d):
    rows = _pairs(spark, d).withColumn("protected", C.protected(F.col("text"), F.col("keep_original")))
    return page_progress(rows, K)


@query(
    "audit_pages",
    f"""{_NUMBERS}, found AS (
      SELECT doc_id, page_no, 'residual' AS c FROM pairs WHERE {_OPEN} AND (trim(target) = '' OR regexp_matches(target, '[一-鿿]{{2}}') OR regexp_matches(regexp_replace(target, '[元圆角分万亿年月日号个]', '', 'g'), '[一-鿿]'))
      UNION ALL SELECT doc_id, page_no, 'missing' FROM pairs WHERE {_OPEN} AND trim(target) = ''
      UNION ALL SELECT DISTINCT doc_id, page_no, 'numbers' || block_id FROM lost
      UNION ALL SELECT doc_id, page_no, 'table' FROM pairs WHERE {_OPEN} GROUP BY ALL HAVING count(*) FILTER (WHERE trim(target) = '') > 0),
    p AS (SELECT DISTINCT doc_id, page_no FROM pairs)
    SELECT doc_id, page_no, 0::BIGINT AS layout, count(c) FILTER (WHERE c = 'residual') AS residual, count(c) FILTER (WHERE c = 'missing') AS missing, count(c) FILTER (WHERE c LIKE 'numbers%') AS numbers, count(c) FILTER (WHERE c = 'table') AS "table", count(c) AS issues, count(c) = 0 AS clean
    FROM p LEFT JOIN found USING (doc_id, page_no) GROUP BY doc_id, page_no""",
)
def audit_pages(spark, d):
    """Findings of residual, missing, numbers and table per page."""
    rows = _pairs(spark, d)
    found, _ = C.audit(rows, K, ["residual", "missing", "numbers", "table"])
    return C.audit_summary(found, rows.select(*K).distinct(), K)


@query(
    "completeness",
    f"""WITH {PAIRS}, m AS (SELECT *, trim(target) = '' AS e, {_SAME} AS same FROM pairs WHERE {_OPEN})
    SELECT doc_id, page_no, count(*) FILTER (WHERE e) AS missing, count(*) FILTER (WHERE NOT e AND same) AS identity, 0::BIGINT AS residual, count(*) FILTER (WHERE NOT e) AS measured FROM m GROUP BY ALL""",
)
def completeness(spark, d):
    rows = _pairs(spark, d).withColumn("measurable", C.measurable(F.col("text"), F.col("is_chart"), F.col("vertical")))
    return E.completeness(rows, K)


_SCORE = f"""WITH {PAIRS}, m AS (SELECT *, trim(target) = '' AS e, {_SAME} AS same FROM pairs WHERE {_OPEN}),
    c AS (SELECT doc_id, count(*) FILTER (WHERE e) AS missing, count(*) FILTER (WHERE NOT e AND same) AS identity, count(*) FILTER (WHERE NOT e) AS total FROM m GROUP BY doc_id)"""


def _scores(spark, d, weight: float):
    rows = _pairs(spark, d).withColumn("measurable", C.measurable(F.col("text"), F.col("is_chart"), F.col("vertical")))
    c = E.completeness(rows, ["doc_id"]).withColumnRenamed("measured", "total").withColumns({"weighted": F.lit(weight), "numbers": F.lit(0)})
    return E.final_score(c)


@query("eval_score", f"{_SCORE} SELECT doc_id, missing, identity, total, CASE WHEN total + missing + identity > 0 THEN round_even(100 * (1 - least(1.0, (1.5 + missing * 2.0 + identity * 3.0) / (total + missing + identity))), 2) ELSE 0 END::DOUBLE AS score FROM c")
def eval_score(spark, d):
    return _scores(spark, d, 1.5).select("doc_id", "missing", "identity", "total", "score")


@query("eval_compare", f"{_SCORE}, s AS (SELECT doc_id, round_even(100 * (1 - least(1.0, (missing * 2.0 + identity * 3.0) / (total + missing + identity))), 2) AS b, round_even(100 * (1 - least(1.0, (1.5 + missing * 2.0 + identity * 3.0) / (total + missing + identity))), 2) AS c, missing FROM c) SELECT doc_id, 'score' AS metric, round_even((c - b)::DOUBLE, 2) AS delta FROM s WHERE b <> 0 OR c <> 0 UNION ALL SELECT doc_id, 'missing', 0.0::DOUBLE FROM s WHERE missing > 0")
def eval_compare(spark, d):
    return E.compare(_scores(spark, d, 0.0), _scores(spark, d, 1.5), ["doc_id"], ["score", "missing"])


def _fitted(spark, d):
    """Sizes and heights made up from line items: what a fit would give."""
    li = T.read(spark, d, "lineitem")
    k = F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("page_no"), k.alias("block_id"), (F.lit(2.0) + k).alias("fs"), F.lit(6.3).alias("floor"), (F.col("l_quantity") * 1.0).alias("height"), (k % 3).alias("n_lines"), F.when(k % 2 == 0, F.lit(5.0)).alias("gap"), (k % 4 * 6.0).alias("fit_height"), (k % 2 == 1).alias("in_table"), F.lit(0.0).alias("y0"), F.lit(20.0).alias("y1"))


_FIT = "WITH f AS (SELECT l_orderkey AS page_no, l_linenumber AS k, 2.0 + l_linenumber AS fs, l_quantity AS h, l_linenumber % 3 AS n, CASE WHEN l_linenumber % 2 = 0 THEN 5.0 END AS gap, l_linenumber % 4 * 6.0 AS fh, l_linenumber % 2 = 1 AS t FROM lineitem)"


@query(
    "layout_buckets",
    f"""{_FIT} SELECT page_no, count(*) AS total, count(*) FILTER (WHERE fs < 6.3) AS too_small, count(*) FILTER (WHERE h > 22) AS overflow, count(*) FILTER (WHERE h > 20 + gap + 2) AS crowding,
      count(*) FILTER (WHERE t AND fh > 0 AND h > fh + 0.05 AND n > 1) AS band_violation, count(*) FILTER (WHERE t AND fh > 0 AND h > fh + 0.05 AND n = 1) AS single_over, count(*) FILTER (WHERE fs < 5) AS severe_tiny,
      count(*) FILTER (WHERE n > 1 AND fs <= 6.3) AS too_many_lines, count(*) FILTER (WHERE fs < 4) AS b_lt4, count(*) FILTER (WHERE fs >= 4 AND fs < 5) AS b_4_5, count(*) FILTER (WHERE fs >= 5 AND fs < 6) AS b_5_6, count(*) FILTER (WHERE fs >= 6) AS b_ge6 FROM f GROUP BY page_no""",
)
def layout_buckets(spark, d):
    return E.layout_counts(_fitted(spark, d), ["page_no"])


@query(
    "layout_score",
    f"""{_FIT}, c AS (SELECT page_no % 10 AS doc, count(*) AS total, 1.5 * count(*) FILTER (WHERE fs < 6.3) + 2.0 * count(*) FILTER (WHERE h > 22) + 1.5 * count(*) FILTER (WHERE h > 20 + gap + 2) + 2.0 * count(*) FILTER (WHERE t AND fh > 0 AND h > fh + 0.05 AND n > 1)
      + 2.0 * count(*) FILTER (WHERE fs < 5) + count(*) FILTER (WHERE n > 1 AND fs <= 6.3) AS w FROM f GROUP BY 1)
    SELECT doc, total, w::DOUBLE AS weighted, round_even(100 * (1 - least(1.0, w / total)), 2)::DOUBLE AS score FROM c""",
)
def layout_score(spark, d):
    counts = E.layout_counts(_fitted(spark, d), ["page_no"]).withColumn("doc", F.col("page_no") % 10)
    return E.layout_score(counts, ["doc"]).select("doc", "total", "weighted", "score")


@query("layout_findings", f"{_FIT} SELECT page_no, k AS block_id, unnest(list_filter([CASE WHEN fs < 6.3 THEN 'too_small' END, CASE WHEN h > 22 AND gap IS NULL THEN 'overflow' END, CASE WHEN h > 20 + gap + 2 THEN 'crowding' END], lambda x: x IS NOT NULL)) AS kind FROM f")
def layout_findings(spark, d):
    return C.layout_findings(_fitted(spark, d), ["page_no"]).select("page_no", "block_id", "kind")


@query("fitted_sizes", None)
def fitted_sizes(spark, d):
    """Sentences fitted into boxes 120 points wide, with a fixed-advance metric."""
    s = T.sentences(T.read(spark, d, "lineitem")).where("target <> ''")
    boxes = s.withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(120.0), "y1": F.lit(24.0), "size": F.lit(12.0), "in_table": F.col("block_no") % 2 == 0})
    return L.with_fit(boxes).select("page_no", "block_no", "fs", "n_lines", F.round("height", 4).alias("height"))


#: Replies to requests for up to three blocks: whole, with a number twice, missing, out of range or blank, and without numbers.
RAWS = [
    "[[1]] first\n[[2]] second\n[[3]] third", "[[1]] a\n[[1]] b", "[[1]] a\n[[4]] d", "[[2]] b\n[[1]] a", "[[1]]\n[[2]] b", "one line", "one\ntwo\n\nthree", "", "   ", "noise before\n[[1]] a\nmore of a\n[[2]]  b  c", "[[1]] a", "[[1]] a\n[[2]] b", "in [[1]] text", "a\nb",
]
_RAW = f"""WITH c AS (SELECT c_custkey AS id, (c_custkey % 4)::INTEGER AS n, {chosen_sql(RAWS, "c_custkey")} AS raw FROM customer),
    p AS (SELECT *, list_transform(regexp_extract_all(raw, '(?m)^\\s*\\[\\[(\\d{{1,9}})\\]\\]', 1), lambda x: x::INTEGER - 1) AS pos, list_transform(string_split_regex(raw, '(?m)^\\s*\\[\\[\\d{{1,9}}\\]\\]\\s*')[2:], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS texts,
                 list_filter(list_transform(string_split_regex(raw, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM c)"""


def _raws(spark, d):
    k = F.col("c_custkey")
    return T.read(spark, d, "customer").select(k.alias("id"), (k % 4).cast("int").alias("n"), chosen(RAWS, k).alias("raw"))


@query(
    "reply_protocol",
    f"""{_RAW} SELECT id, n, CASE WHEN len(pos) > 0 AND len(list_distinct(pos)) < len(pos) THEN 'duplicate' WHEN len(pos) > 0 AND list_sort(pos) <> range(n)::INTEGER[] THEN 'incomplete' WHEN len(pos) > 0 AND list_contains(texts, '') THEN 'empty'
      WHEN len(pos) = 0 AND n = 1 AND trim(raw) = '' THEN 'blank' WHEN len(pos) = 0 AND n <> 1 AND len(lines) <> n THEN 'lines' END AS reason FROM p""",
)
def reply_protocol(spark, d):
    return _raws(spark, d).select("id", "n", R.strict_reply(F.col("raw"), F.col("n"))[1].alias("reason"))


@query(
    "reply_lenient",
    f"""{_RAW} SELECT id, array_to_string(CASE WHEN len(pos) > 0 THEN list_transform(range(n), lambda i: coalesce(list_filter(list_zip(pos, texts), lambda z: z[1] = i AND z[2] <> '')[1][2], 's' || i)) WHEN len(lines) = n THEN lines ELSE list_transform(range(n), lambda i: 's' || i) END, '|') AS texts FROM p""",
)
def reply_lenient(spark, d):
    """The first text with a block's number, else its source."""
    sources = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("s"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return _raws(spark, d).select("id", F.array_join(R.lenient_reply(F.col("raw"), sources), "|").alias("texts"))


GRIDS = ['{"rows": [["a", "b"], ["c"]]}', 'Sure: {"rows": [[], ["x", "y", "z"], ["1"]]} ok', '{"rows": []}', "nothing", '{"rows": [["only"]]}', '{"rows": "no"}', '{"rows": [[]]}']


@query(
    "grid_parse",
    f"""WITH c AS (SELECT s_suppkey AS id, regexp_extract({chosen_sql(GRIDS, "s_suppkey")}, '(?s)\\{{.*\\}}') AS body FROM supplier), j AS (SELECT id, CASE WHEN json_valid(body) AND json_type(body, '$.rows') = 'ARRAY' THEN CAST(json_extract(body, '$.rows') AS VARCHAR[][]) END AS r FROM c),
    w AS (SELECT *, list_max(list_transform(r, lambda x: len(x))) AS width FROM j)
    SELECT id, CASE WHEN len(r) BETWEEN 1 AND 200 AND width BETWEEN 1 AND 40 THEN array_to_string(list_transform(r, lambda x: array_to_string(list_transform(range(1, width + 1), lambda i: coalesce(x[i], '')), ',')), ';') END AS grid FROM w""",
)
def grid_parse(spark, d):
    """Ragged grids in noisy replies, read and padded."""
    grid = R.table_grid(chosen(GRIDS, F.col("s_suppkey")))
    return T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(F.transform(grid, lambda r: F.array_join(r, ",")), ";").alias("grid"))


VERDICTS = ['Sure: {"release": [1, 2, 4.5], "keep": [2, 3, true, 99]}', '{"release": ["5", 0], "keep": []}', '{"keep": [1.0, -1]}', "no answer", '{"release": [1, 1, 3]}']


@query(
    "policy_decisions",
    f"""WITH {BLOCKS}, v AS (SELECT doc_id, regexp_extract({chosen_sql(VERDICTS, "doc_id")}, '(?s)\\{{.*\\}}') AS body FROM documents), sides AS (
      SELECT doc_id, unnest(CAST(json_extract(body, '$.release') AS JSON[])) AS x, 'translate' AS action, 0 AS k FROM v WHERE json_valid(body) AND json_type(body, '$.release') = 'ARRAY'
      UNION ALL SELECT doc_id, unnest(CAST(json_extract(body, '$.keep') AS JSON[])), 'keep', 1 FROM v WHERE json_valid(body) AND json_type(body, '$.keep') = 'ARRAY'),
    n AS (SELECT doc_id, regexp_extract(x::VARCHAR, '(-?[0-9]+)', 1)::INTEGER AS block_id, action, k FROM sides WHERE regexp_matches(x::VARCHAR, '^"?\\s*-?[0-9]{{1,9}}(\\.0+)?\\s*"?$'))
    SELECT doc_id, block_id, arg_max(action, k) AS action FROM n SEMI JOIN (SELECT doc_id, block_id FROM blocks WHERE length(text) % 5 <> 0) o USING (doc_id, block_id) GROUP BY doc_id, block_id""",
)
def policy_decisions(spark, d):
    """Replies that release and keep blocks, some of them twice, as fractions or booleans, or not on offer."""
    raw = chosen(VERDICTS, F.col("doc_id"))
    docs = T.read(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return R.policy_decisions(docs, T.line_blocks(T.read(spark, d, "documents")).where("length(text) % 5 <> 0"))


@query("judge_mean", "SELECT l_orderkey % 100 AS doc, round(avg(CASE WHEN l_linenumber = 3 THEN 0 ELSE least(100, greatest(0, l_quantity * 3 - 20)) END), 6) AS score FROM lineitem GROUP BY 1")
def judges(spark, d):
    li = T.read(spark, d, "lineitem")
    s = li.select((F.col("l_orderkey") % 100).alias("doc"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 3 - 20).alias("score"))
    return judge_mean(s, ["doc"]).withColumn("score", F.round("score", 6))


@query("block_values", f"WITH {PAIRS}, a AS ({signature_sql('pairs', 'doc_id', 'text')}) SELECT doc_id, value, count(*) AS n FROM a GROUP BY doc_id, value")
def block_values(spark, d):
    """Value multisets of derived blocks by the block-level rules."""
    return N.signature_rows(_pairs(spark, d), ["doc_id"], F.col("text")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("off_page_spans", "SELECT l_orderkey AS page_no, l_linenumber AS span_no FROM lineitem WHERE l_quantity * 10 + 50 > 401")
def off_page_spans(spark, d):
    li = T.read(spark, d, "lineitem")
    x = F.col("l_quantity") * 10
    s = li.select(F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("span_no"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 50).alias("x1"), F.lit(10.0).alias("y1"), F.lit(0.0).alias("page_x0"), F.lit(400.0).alias("page_x1"), F.lit(800.0).alias("page_y1"))
    return C.off_page(s, ["page_no"])
