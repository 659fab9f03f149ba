"""Queries over made-up phrases: every row of a table gets one by its key, so that rules for ideographs, broken replies
and odd marks, which the test tables don't hold, meet real cases; the SQL evaluates the rule on the phrase."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.audit import checks as C
from blockloom.functions import geometry as G
from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.operators import aggregates as A
from blockloom.operators import joins as J
from blockloom.operators import replies as R
from blockloom.queries.documents import _FORMULA
from blockloom.queries.registry import query
from blockloom.sources import ingest as I
from blockloom.sources import tables as T

PHRASES = [
    "Revenue rose in the third quarter", "营业收入同比增长", "编号 A12号(二)", "12号文件", "第3号", "2025年", "1,234.56", "(1,234.56)", "E = m × c^2 + ∑x", "净利润为 3.14 亿元 and more",
    "—", "", "   ", "• first entry", "1. numbered", "（一）条款", "Label: value", "标签：数值", "12.5%", "万", "元角分", "x", "the Bank of Nation said so", "徽商银行股份有限公司今日公告", "商银行股份", "a-b", "合计", "表 3 单位：万元",
]
LETTERS = "regexp_matches(text, '\\p{L}')"
FIGURE = "(NOT regexp_matches(text, '^\\s*[（(]?\\s*[一二三四五六七八九十0-9]{1,3}\\s*[)）]\\s*$') AND regexp_matches(text, '^\\s*[（(－\\-−]?\\s*(?:\\d{1,3}(?:\\s*[，,]\\s*\\d{3})+(?:\\s*[.．]\\s*\\d+)?|\\d+(?:\\s*[.．]\\s*\\d+)?)\\s*[%％]?\\s*[）)]?\\s*$'))"
NEEDS = f"({LETTERS} AND NOT {_FORMULA})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(texts: list[str]) -> str:
    return "[" + ", ".join(map(quoted, texts)) + "]"


def chosen(texts: list[str], key):
    return F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))


def chosen_sql(texts: list[str], key: str) -> str:
    return f"{listed(texts)}[({key}) % {len(texts)} + 1]"


PH = f"ph AS (SELECT c_custkey AS id, {chosen_sql(PHRASES, 'c_custkey')} AS text FROM customer)"


def _phrases(spark, d):
    return T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), chosen(PHRASES, F.col("c_custkey")).alias("text"))


def _flag(name: str, test, sql: str) -> None:
    @query(name, f"WITH {PH} SELECT id, text, coalesce({sql}, false) AS hit FROM ph")
    def run(spark, d):
        return _phrases(spark, d).select("id", "text", F.coalesce(test(F.col("text")), F.lit(False)).alias("hit"))


_flag("phrase_residual_cjk", X.has_residual_cjk, "regexp_matches(text, '[一-鿿]{2}') OR regexp_matches(regexp_replace(text, '[元圆角分万亿年月日号个]', '', 'g'), '[一-鿿]')")
_flag("phrase_latin_prose", X.is_latin_prose, "NOT regexp_matches(text, '[一-鿿]') AND len(regexp_extract_all(text, '[A-Za-z]+(?:[’''-][A-Za-z]+)*')) >= 3")
_flag("phrase_needs_translation", X.needs_translation, NEEDS)
_flag("phrase_statement_code", X.is_statement_code, "length(trim(text)) BETWEEN 1 AND 16 AND regexp_matches(text, '\\d') AND length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) BETWEEN 1 AND 4 AND regexp_matches(trim(text), '^[一-鿿A-Za-z0-9][一-鿿A-Za-z0-9\\-－（）()、\\s]{0,15}$')")
_flag("phrase_figure", N.is_numeric_cell, FIGURE)
_flag("phrase_scan_like", X.is_scan_like, "text = '' OR (NOT regexp_matches(text, '\\p{L}') AND NOT regexp_matches(array_to_string(regexp_extract_all(text, '[+-]?[0-9][0-9,.，．]*[0-9%]|[+-]?[0-9]'), ' '), '[,，.．%]'))")


@query(
    "phrase_language",
    f"WITH {PH}, docs AS (SELECT id % 40 AS doc_id, sum(length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')))::BIGINT AS cjk, sum(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::BIGINT AS latin FROM ph GROUP BY 1) SELECT *, CASE WHEN cjk = 0 AND latin = 0 THEN 'unknown' WHEN cjk >= latin THEN 'zh' WHEN latin >= cjk * 5 THEN 'en' ELSE 'mixed' END AS language FROM docs",
)
def phrase_language(spark, d):
    return A.document_language(_phrases(spark, d).withColumn("doc_id", F.col("id") % 40))


_CODE = "(length(r) BETWEEN 1 AND 16 AND regexp_matches(r, '\\d') AND length(r) - length(regexp_replace(r, '[一-鿿]', '', 'g')) BETWEEN 1 AND 4 AND regexp_matches(r, '^[一-鿿A-Za-z0-9][一-鿿A-Za-z0-9\\-－（）()、\\s]{0,15}$'))"


@query("cjk_residual", f"WITH {PH} SELECT id, coalesce(list_sum(list_transform(regexp_extract_all(text, '[一-鿿0-9A-Za-z\\-－（）()、]+'), lambda r: CASE WHEN {_CODE} THEN 0 ELSE length(r) - length(regexp_replace(r, '[一-鿿]', '', 'g')) END)), 0)::INTEGER AS residual FROM ph")
def cjk_residual(spark, d):
    return _phrases(spark, d).select("id", X.cjk_residual(F.col("text")).alias("residual"))


_FRACTION = f"WITH {PH}, pages AS (SELECT id // 4 AS page_no, string_agg(text, chr(10) ORDER BY id) AS target FROM ph GROUP BY 1)"


@query("page_residual", f"{_FRACTION} SELECT * FROM (SELECT page_no, coalesce(list_sum(list_transform(regexp_extract_all(target, '[一-鿿0-9A-Za-z\\-－（）()、]+'), lambda r: CASE WHEN {_CODE} THEN 0 ELSE length(r) - length(regexp_replace(r, '[一-鿿]', '', 'g')) END)), 0)::INTEGER AS residual FROM pages) WHERE residual > 0")
def page_residual(spark, d):
    pages = _phrases(spark, d).groupBy(F.floor(F.col("id") / 4).cast("long").alias("page_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("target"))
    return C.page_residual(pages, ["page_no"])


NAMES = ["Simplified Chinese", " zh ", "English", "中文", "ja", "Deutsch", "zh-CN", "Korean", "cn", "Français", "한국어", "日本語", "JPN", "zh_Hant", "Czech", "普通话", "Kannada", "chi"]


@query(
    "cjk_languages",
    f"WITH n AS (SELECT c_custkey AS id, {chosen_sql(NAMES, 'c_custkey')} AS name FROM customer), l AS (SELECT *, lower(trim(name)) AS t FROM n) SELECT id, name, len(list_filter({listed(X.CJK_LANGUAGE_NAMES)}, lambda x: contains(t, x))) > 0 AS by_name, regexp_matches(t, '[一-鿿]') OR list_contains({listed(X.CJK_TARGET_CODES)}, regexp_replace(t, '[^a-z]', '', 'g')) OR len(list_filter({listed(X.CJK_TARGET_NAMES)}, lambda x: contains(t, x))) > 0 AS by_code FROM l",
)
def cjk_languages(spark, d):
    rows = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), chosen(NAMES, F.col("c_custkey")).alias("name"))
    return rows.select("id", "name", X.is_cjk_language(F.col("name")).alias("by_name"), X.is_cjk_target(F.col("name")).alias("by_code"))


NUMERALS = [str(n) for n in (7, 42, 123456789)] + [t + o for t in ("", "十", "二十", "九十") for o in ("", "一", "五", "九")] + ["一百", "三千零一", "十x", "零", "1234567890"]
_DIGIT = "(instr('零一二三四五六七八九', {}) - 1)"


@query(
    "cn_numerals",
    f"""WITH n AS (SELECT c_custkey AS id, {chosen_sql(NUMERALS, "c_custkey")} AS t FROM customer),
    p AS (SELECT *, instr(t, '十') AS ten, regexp_matches(t, '^[零一二三四五六七八九]?十[零一二三四五六七八九]?$') AS tens, regexp_matches(t, '^[零一二三四五六七八九]$') AS one FROM n)
    SELECT id, t AS numeral, (CASE WHEN regexp_matches(t, '^[0-9]{{1,9}}$') THEN t::INTEGER WHEN one THEN {_DIGIT.format("t")} WHEN t = '' THEN 0
      WHEN tens THEN CASE WHEN ten = 1 THEN 10 ELSE {_DIGIT.format("t[1:1]")} * 10 END + CASE WHEN ten = length(t) THEN 0 ELSE {_DIGIT.format("t[ten + 1:ten + 1]")} END END)::INTEGER AS value FROM p WHERE NOT regexp_matches(t, '^[0-9]{{10,}}$')""",
)
def cn_numerals(spark, d):
    rows = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), chosen(NUMERALS, F.col("c_custkey")).alias("numeral"))
    return rows.where(~F.col("numeral").rlike("^[0-9]{10,}$")).select("id", "numeral", N.cn_to_int(F.col("numeral")).cast("int").alias("value"))


ORDINALS = ["一、总则", "（四） 条款", "第二节 财务", "第十二章", "二十一、附注 1,234", "共三项", "甲、乙", "( 十 )项", "第 九 条", "无 ordinal here", "三、1,000 和 四、2,000", "第100条"]


def _ordinal_sql() -> str:
    """One replacement after the other for every numeral from 1 to 99, longer ones first."""
    digits = "一二三四五六七八九"
    names = {n: ("" if n < 20 else digits[n // 10 - 1]) + ("十" if n > 9 else "") + (digits[n % 10 - 1] if n % 10 else "") for n in range(1, 100)}
    out = "t"
    for n, name in sorted(names.items(), key=lambda x: -len(x[1])):
        out = f"regexp_replace(regexp_replace(regexp_replace({out}, '第\\s*{name}\\s*([章节条篇])', '{n}\\1', 'g'), '[（(]\\s*{name}\\s*[)）]', '({n})', 'g'), '{name}\\s*([、．])', '{n}\\1', 'g')"
    return out


@query("ordinal_marks", f"SELECT id, t AS text, {_ordinal_sql()} AS normal FROM (SELECT p_partkey AS id, {chosen_sql(ORDINALS, 'p_partkey')} AS t FROM part)")
def ordinal_marks(spark, d):
    rows = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), chosen(ORDINALS, F.col("p_partkey")).alias("text"))
    return rows.select("id", "text", N.normalize_ordinals(F.col("text")).alias("normal"))


COMPANIES = ["徽商银行", "徽商银行股份有限公司", "Nation", "the Bank of Nation", "首创集团", "银行"]


@query(
    "shared_names",
    f"WITH {PH}, n AS (SELECT *, {chosen_sql(COMPANIES, 'id // 3')} AS name FROM ph), m AS (SELECT *, greatest(4, length(name) // 2) AS need FROM n) SELECT id, name, contains(text, name) OR len(list_filter(range(1, greatest(1, length(name) - need + 2)), lambda i: contains(text, name[i:i + need - 1]))) > 0 AS shared FROM m",
)
def shared_names(spark, d):
    rows = _phrases(spark, d).withColumn("name", chosen(COMPANIES, F.floor(F.col("id") / 3)))
    return rows.select("id", "name", A.shares_name(F.col("text"), F.col("name")).alias("shared"))


_TRIO = f"l AS (SELECT c_custkey AS id, [{chosen_sql(PHRASES, 'c_custkey')}, {chosen_sql(PHRASES, 'c_custkey * 7 + 3')}, {chosen_sql(PHRASES, 'c_custkey * 5 + 1')}] AS lines FROM customer)"


def _trios(spark, d):
    key = F.col("c_custkey")
    return T.read(spark, d, "customer").select(key.alias("id"), F.array(chosen(PHRASES, key), chosen(PHRASES, key * 7 + 3), chosen(PHRASES, key * 5 + 1)).alias("lines"))


@query("joined_texts", f"WITH {_TRIO} SELECT id, list_reduce(lines, lambda a, t: CASE WHEN a = '' THEN t WHEN t = '' THEN a ELSE a || CASE WHEN regexp_matches(right(a, 1), '[一-鿿]') AND regexp_matches(left(t, 1), '[一-鿿]') THEN '' ELSE ' ' END || t END) AS text FROM l")
def joined_texts(spark, d):
    return _trios(spark, d).select("id", X.join_texts(F.col("lines")).alias("text"))


WORDS = ["inter-", "national busi-", "ness", "Self-", "Help", "plain line", "end-", "é-", "trés", "9-"]


@query("dehyphenated", f"WITH l AS (SELECT c_custkey AS id, [{chosen_sql(WORDS, 'c_custkey')}, {chosen_sql(WORDS, 'c_custkey + 1')}, {chosen_sql(WORDS, 'c_custkey * 3 + 2')}] AS lines FROM customer) SELECT id, list_reduce(lines, lambda a, t: CASE WHEN a LIKE '%-' AND regexp_matches(t, '^\\p{{Ll}}') THEN a[:-2] || t ELSE a || ' ' || t END) AS text FROM l")
def dehyphenated(spark, d):
    key = F.col("c_custkey")
    lines = F.array(chosen(WORDS, key), chosen(WORDS, key + 1), chosen(WORDS, key * 3 + 2))
    return T.read(spark, d, "customer").select(key.alias("id"), X.dehyphenate(lines).alias("text"))


ANSWERS = ["跳过", "skip it", "保留图注，翻译标题", "保留原样", "翻译", "OCR please", "Translate", "none", "", "维持", "译成中文", "do nothing", "STOP", "停", "keep the 文字 保留"]


@query(
    "decisions_of_answers",
    f"""WITH a AS (SELECT s_suppkey AS id, lower(trim({chosen_sql(ANSWERS, "s_suppkey")})) AS v FROM supplier)
    SELECT id, CASE WHEN regexp_matches(v, '跳过|略过|停') OR v LIKE 'skip%' OR v IN ('skipped', 'none') THEN 'skip' WHEN contains(v, '保留') AND regexp_matches(v, '翻译|译|说明|图注|表注|文字|标题') THEN 'translate'
      WHEN regexp_matches(v, '保留|原样|不动|不翻|别译|不用|维持') THEN 'keep' WHEN regexp_matches(v, '翻译|ocr|转成|译成|换成') OR v LIKE 'translate%' THEN 'translate' ELSE 'keep' END AS decision FROM a""",
)
def decisions_of_answers(spark, d):
    return T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.interpret_decision(chosen(ANSWERS, F.col("s_suppkey"))).alias("decision"))


# -- flags and tiers ------------------------------------------------------------------------------------------

_BITS = "id % 2 = 0 AS keep_original, id % 3 = 0 AS is_chart, id % 5 = 0 AS vertical, id % 7 = 0 AS ocr, id % 4 = 1 AS in_table, id % 6 = 2 AS in_image, id % 9 = 4 AS released, id % 11 = 3 AS verbatim, ['text', 'formula', 'figure', 'heading'][id % 4 + 1] AS role"


def _flagged(spark, d):
    i = F.col("id")
    return _phrases(spark, d).select("*", (i % 2 == 0).alias("keep_original"), (i % 3 == 0).alias("is_chart"), (i % 5 == 0).alias("vertical"), (i % 7 == 0).alias("ocr"), (i % 4 == 1).alias("in_table"), (i % 6 == 2).alias("in_image"), (i % 9 == 4).alias("released"), (i % 11 == 3).alias("verbatim"), chosen(["text", "formula", "figure", "heading"], i).alias("role"))


_ENTRY = "regexp_matches(trim(text), '^[•▪●■◆◇✦✧❖❤➡→←▸▶»‣⁃∙·❚◘○]|^(?:\\*|-|–|—)\\s+|^\\d{1,3}[.)]|^(?:[（(]\\s*[一二三四五六七八九十百零〇0-9]{1,4}\\s*[）)]|[①-⑳]|[一二三四五六七八九十百零〇0-9]{1,3}[、．])|^[A-Za-z一-鿿][^:\\n]{0,40}:(?:\\s|$)|^[A-Za-z一-鿿][^:\\n：]{0,14}：')"


@query(
    "block_tiers",
    f"""WITH {PH}, b AS (SELECT *, {_BITS} FROM ph) SELECT id, NOT {NEEDS} OR {FIGURE} OR keep_original AS protected, NOT is_chart AND NOT vertical AND {NEEDS} AND NOT {FIGURE} AS measurable,
      CASE WHEN verbatim THEN true WHEN role = 'formula' AND NOT in_image THEN true WHEN released THEN false WHEN keep_original THEN true ELSE role IN ('formula', 'figure') AND NOT in_image END AS keeps,
      is_chart AND ocr AND NOT released AS default_keep, role = 'text' AND NOT in_table AND NOT ocr AND NOT is_chart AND NOT keep_original AND NOT coalesce({_ENTRY}, false) AS joinable FROM b""",
)
def block_tiers(spark, d):
    from blockloom.operators.sequence import joinable

    c = F.col
    rows = _flagged(spark, d)
    return rows.select(
        "id", C.protected(c("text"), c("keep_original")).alias("protected"), C.measurable(c("text"), c("is_chart"), c("vertical")).alias("measurable"), C.keeps_source(c("verbatim"), c("role"), c("in_image"), c("released"), c("keep_original")).alias("keeps"),
        C.default_keep(c("is_chart"), c("ocr"), c("released")).alias("default_keep"), joinable(rows).alias("joinable"),
    )


@query("vertical_labels", "SELECT p_partkey AS id, p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 120 >= 2 * p_size AND p_size <= 30 AND p_partkey % 120 >= 22 AS vertical FROM part")
def vertical_labels(spark, d):
    k, w = F.col("p_partkey"), F.col("p_size").cast("double")
    text = F.when(k % 7 == 0, "two\nlines").otherwise("Label")
    return T.read(spark, d, "part").select(k.alias("id"), X.is_vertical_label(text, F.lit(5.0), F.lit(7.0), w + 5, (k % 120) + 7.0, k % 3 != 0, k % 5 == 0).alias("vertical"))


# -- geometry -------------------------------------------------------------------------------------------------

_BOX = "b AS (SELECT p_partkey AS id, (p_partkey % 50)::DOUBLE AS ax0, (p_partkey % 31)::DOUBLE AS ay0, (p_partkey % 50 + p_size)::DOUBLE AS ax1, (p_partkey % 31 + p_size % 9)::DOUBLE AS ay1, (p_partkey % 23)::DOUBLE AS bx0, (p_partkey % 17)::DOUBLE AS by0, (p_partkey % 23 + 40)::DOUBLE AS bx1, (p_partkey % 17 + 20)::DOUBLE AS by1 FROM part)"


def _boxes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    made = {"ax0": k % 50, "ay0": k % 31, "ax1": k % 50 + s, "ay1": k % 31 + s % 9, "bx0": k % 23, "by0": k % 17, "bx1": k % 23 + 40, "by1": k % 17 + 20}
    return T.read(spark, d, "part").select(k.alias("id"), *[c.cast("double").alias(n) for n, c in made.items()])


@query(
    "box_cover",
    f"""WITH {_BOX}, o AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) AS w, greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS h FROM b)
    SELECT id, round(w * h / greatest(0.000001, (ax1 - ax0) * (ay1 - ay0)), 9) AS covered, w > 0.5 AND h > 0.5 AS overlaps, (ax0 + ax1) / 2 BETWEEN bx0 AND bx1 AND (ay0 + ay1) / 2 BETWEEN by0 AND by1 AS inside,
      greatest(0, ax0 - bx1, bx0 - ax1) + greatest(0, ay0 - by1, by0 - ay1) AS distance FROM o""",
)
def box_cover(spark, d):
    a, b = G.box("a"), G.box("b")
    return _boxes(spark, d).select("id", F.round(G.covered_ratio(a, b), 9).alias("covered"), G.overlaps(a, b).alias("overlaps"), G.centre_in(a, b).alias("inside"), G.gap_distance(a, b).alias("distance"))


@query(
    "rotated_boxes",
    f"""WITH {_BOX}, r AS (SELECT *, (id % 4) * 90 AS rot FROM b) SELECT id, CASE rot WHEN 90 THEN 200 - ay1 WHEN 180 THEN 200 - ax1 WHEN 270 THEN ay0 ELSE ax0 END AS x0, CASE rot WHEN 90 THEN ax0 WHEN 180 THEN 300 - ay1 WHEN 270 THEN 300 - ax1 ELSE ay0 END AS y0,
      CASE rot WHEN 90 THEN 200 - ay0 WHEN 180 THEN 200 - ax0 WHEN 270 THEN ay1 ELSE ax1 END AS x1, CASE rot WHEN 90 THEN ax1 WHEN 180 THEN 300 - ay0 WHEN 270 THEN 300 - ax0 ELSE ay1 END AS y1 FROM r""",
)
def rotated_boxes(spark, d):
    r = G.rotated(G.box("a"), (F.col("id") % 4) * 90, F.lit(200.0), F.lit(300.0))
    return _boxes(spark, d).select("id", r.alias("r")).select("id", "r.*")


@query("page_skew", "WITH a AS (SELECT l_orderkey AS page_no, (l_partkey % 3600)::DOUBLE / 10 - 180 AS deg FROM lineitem), f AS (SELECT page_no, list_sort(list(((deg + 45) % 90 + 90) % 90 - 45)) AS s FROM a GROUP BY page_no) SELECT page_no, round(s[len(s) // 2 + 1], 6) AS angle FROM f")
def page_skew(spark, d):
    a = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_no"), G.folded_angle((F.col("l_partkey") % 3600).cast("double") / 10 - 180).alias("a"))
    return a.groupBy("page_no").agg(F.round(G.upper_median(F.collect_list("a")), 6).alias("angle"))


@query("rgb_parts", "SELECT p_partkey AS id, (c >> 16 & 255) / 255.0::DOUBLE AS r, (c >> 8 & 255) / 255.0::DOUBLE AS g, (c & 255) / 255.0::DOUBLE AS b FROM (SELECT p_partkey, (p_partkey * 7919 % 16777216)::INTEGER AS c FROM part)")
def rgb_parts(spark, d):
    c = X.rgb((F.col("p_partkey") * 7919 % 16777216).cast("int"))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), c.alias("c")).select("id", "c.r", "c.g", "c.b")


# -- sources --------------------------------------------------------------------------------------------------

CLASSES = ["Title", " plain text ", "figure", "table_caption", "Table", "isolate_formula", "abandon", "mystery", "none", "header", "chart", "equation"]


@query(
    "structure_boxes",
    f"""WITH c AS (SELECT p_partkey AS id, lower(trim({chosen_sql(CLASSES, "p_partkey")})) AS name, p_size::DOUBLE AS s FROM part)
    SELECT id, CASE WHEN name = 'title' THEN 'heading' WHEN name IN ('figure', 'chart') THEN 'figure' WHEN name = 'table_caption' THEN 'caption' WHEN name = 'table' THEN 'table' WHEN name IN ('isolate_formula', 'equation') THEN 'formula' ELSE 'text' END AS kind,
      round(s * 0.48::DOUBLE, 6) AS x0, round((s + 50) * 0.48::DOUBLE, 6) AS x1 FROM c WHERE name NOT IN ('abandon', 'none')""",
)
def structure_boxes(spark, d):
    s = F.col("p_size").cast("double")
    rows = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), chosen(CLASSES, F.col("p_partkey")).alias("class_name"), s.alias("x0"), s.alias("y0"), (s + 50).alias("x1"), (s + 50).alias("y1"))
    return I.structure_boxes(rows).select("id", "kind", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("drawn_bands", "SELECT l_orderkey AS page_no, l_linenumber AS span_no, 100 - l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 0.75 ELSE 0.9 END AS y0, 100 + l_quantity * CASE WHEN l_linenumber % 3 = 0 THEN 0.25 ELSE 0.2 END AS y1 FROM lineitem WHERE l_linenumber <> 4")
def drawn_bands(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    s = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_no"), n.alias("span_no"), F.when(n == 4, "  ").otherwise("x").alias("text"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("x1"), F.lit(100.0).alias("origin_y"), q.alias("size"), F.when(n % 2 == 0, 0.0).otherwise(0.9).alias("ascender"), F.when(n % 3 == 0, F.lit(None).cast("double")).otherwise(-0.2).alias("descender"))
    return I.drawn_spans(s).select("page_no", "span_no", "band.y0", "band.y1")


SPECS = ["24-27,30", "1", " 3 , 2-2,", "5-3", "a", "7,7,6-8", "1-2-3", "10 - 12"]


@query(
    "page_specs",
    f"""WITH s AS (SELECT c_custkey AS id, {chosen_sql(SPECS, "c_custkey")} AS spec FROM customer), p AS (SELECT *, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM s),
    v AS (SELECT *, len(list_filter(parts, lambda x: NOT regexp_matches(x, '^\\d{{1,6}}(\\s*-\\s*\\d{{1,6}})?$') OR coalesce(try_cast(regexp_extract(x, '-\\s*(\\d+)$', 1) AS INTEGER), try_cast(regexp_extract(x, '^(\\d+)', 1) AS INTEGER)) < try_cast(regexp_extract(x, '^(\\d+)', 1) AS INTEGER))) = 0 AS good FROM p)
    SELECT id, CASE WHEN good THEN list_sort(list_distinct(flatten(list_transform(parts, lambda x: range(regexp_extract(x, '^(\\d+)', 1)::INTEGER, coalesce(try_cast(regexp_extract(x, '-\\s*(\\d+)$', 1) AS INTEGER), regexp_extract(x, '^(\\d+)', 1)::INTEGER) + 1))))) [1:] END::INTEGER[]::VARCHAR AS pages FROM v""",
)
def page_specs(spark, d):
    rows = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), I.page_spec(chosen(SPECS, F.col("c_custkey"))).alias("p"))
    return rows.select("id", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x.cast("string")), ", "), F.lit("]")).alias("pages"))


@query("cache_keys", "SELECT c_custkey AS id, sha1(c_name || '|zh|' || c_mktsegment || '|h|9')[1:16] AS translation, sha1(c_name || '|' || c_custkey || '|' || c_nationkey || '|10')[1:16] AS ocr FROM customer")
def cache_keys(spark, d):
    c = T.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), I.translation_key(F.col("c_name"), F.lit("zh"), F.col("c_mktsegment"), F.lit("h")).alias("translation"), I.ocr_key(F.col("c_name"), F.col("c_custkey"), F.col("c_nationkey")).alias("ocr"))


@query("out_documents", f"WITH {PH} SELECT id % 50 AS doc_id, (id // 50)::INTEGER AS block_id, text FROM ph WHERE id % 7 <> 3")
def out_documents(spark, d):
    """A JSON object per document, {"index": {"text": ...}}; every seventh index is no number."""
    key = F.when(F.col("id") % 7 == 3, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(F.floor(F.col("id") / 50).cast("string"))
    entry = F.struct(key.alias("k"), F.struct("text").alias("v"))
    docs = _phrases(spark, d).groupBy((F.col("id") % 50).alias("doc_id")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("raw"))
    return I.out_document(docs)


# -- replies --------------------------------------------------------------------------------------------------

NOISE = ['Sure! {"pages": [1, 2], "note": "a {b} c"} done', '{"pages": []}', "no object", "{broken", 'x {"pages": "no"} y', '```json\n{"note": "n"}\n```', "{}"]


@query("json_notes", f"SELECT s_suppkey AS id, CASE s_suppkey % {len(NOISE)} WHEN 0 THEN 'a {{b}} c' WHEN 5 THEN 'n' END AS note, CASE s_suppkey % {len(NOISE)} WHEN 0 THEN 2 WHEN 1 THEN 0 END AS pages FROM supplier")
def json_notes(spark, d):
    j = R.json_object(chosen(NOISE, F.col("s_suppkey")), "pages array<int>, note string")
    return T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), j["note"].alias("note"), F.when(j["pages"].isNotNull(), F.size(j["pages"])).alias("pages"))


@query("cell_merges", "SELECT l_orderkey, l_linenumber, (l_linenumber % 3)::INTEGER AS row, (l_partkey % 5)::INTEGER AS col, (l_suppkey % 4 + 1)::INTEGER AS rowspan FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_partkey % 7 <> 2")
def cell_merges(spark, d):
    """Tool calls of each line: one of another tool, one whose arguments are broken, else a merge."""
    li = T.read(spark, d, "lineitem")
    arguments = F.when(F.col("l_partkey") % 7 == 2, "{row: oops").otherwise(F.to_json(F.struct((F.col("l_linenumber") % 3).alias("row"), (F.col("l_partkey") % 5).alias("col"), (F.col("l_suppkey") % 4 + 1).alias("rowspan"))))
    call = F.struct(F.when(F.col("l_linenumber") % 4 == 0, "other").otherwise("detect_table_merge").alias("name"), arguments.alias("arguments"))
    rows = li.select("l_orderkey", "l_linenumber", F.explode(R.merge_calls(F.array(call))).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.row", "m.col", "m.rowspan")


@query(
    "glossary_merge",
    f"WITH {PH}, g AS (SELECT id % 60 AS k, max(text) FILTER (WHERE id % 2 = 0) AS inline, max(text) FILTER (WHERE id % 3 = 0) AS disk FROM ph WHERE trim(text) <> '' GROUP BY 1) SELECT k, coalesce(inline, disk) AS target FROM g WHERE coalesce(inline, disk) IS NOT NULL",
)
def glossary_merge(spark, d):
    """Maps of one term each; the inline one wins over the one on disk."""
    rows = _phrases(spark, d).where(F.trim("text") != "").groupBy((F.col("id") % 60).alias("k")).agg(F.max(F.when(F.col("id") % 2 == 0, F.col("text"))).alias("i"), F.max(F.when(F.col("id") % 3 == 0, F.col("text"))).alias("o"))
    one = lambda c: F.map_filter(F.create_map(F.lit("term"), F.col(c)), lambda _, v: v.isNotNull())
    return rows.select("k", F.element_at(R.merged_glossary(one("i"), one("o")), "term").alias("target")).where("target is not null")


@query("learned_terms", f"WITH {PH} SELECT text AS term, lower(text) AS target FROM (SELECT DISTINCT text FROM ph) WHERE trim(text) <> '' AND trim(lower(text)) <> text")
def learned_terms(spark, d):
    return R.learned_glossary(_phrases(spark, d).select(F.col("text").alias("term"), F.lower("text").alias("target")).distinct())


@query(
    "glossary_entries",
    f"""WITH {PH}, e AS (SELECT id, id % 5 AS doc_id, id AS priority, CASE WHEN id % 4 = 0 THEN 'not there' ELSE text END AS source, CASE WHEN id % 11 = 0 THEN ' ' ELSE 't' || id END AS target FROM ph),
    t AS (SELECT id % 5 AS doc_id, string_agg(text, chr(10) ORDER BY id) AS body FROM ph GROUP BY 1),
    j AS (SELECT e.*, CASE WHEN trim(source) = '' OR trim(target) = '' THEN 'blank' WHEN NOT contains(body, source) THEN 'not in the source' END AS reason FROM e JOIN t USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, reason IS NULL ORDER BY priority, source) AS n FROM j) SELECT id, coalesce(reason, CASE WHEN n > 8 THEN 'above the cap' END) AS reason FROM r""",
)
def glossary_entries(spark, d):
    i = F.col("id")
    rows = _phrases(spark, d)
    entries = rows.select("id", (i % 5).alias("doc_id"), i.alias("priority"), F.when(i % 4 == 0, "not there").otherwise(F.col("text")).alias("source"), F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("t"), i.cast("string"))).alias("target"))
    bodies = rows.groupBy((i % 5).alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    good, bad = R.validate_glossary(entries, bodies, most=8)
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


# -- joins with decisions -------------------------------------------------------------------------------------


@query("decided_blocks", f"WITH {PH}, dec AS (SELECT id * 2 AS block_id, ['keep', 'translate'][id % 2 + 1] AS action FROM ph) SELECT p.id AS block_id, coalesce(action = 'keep', false) OR p.id % 3 = 0 AS keep_original, coalesce(action = 'translate', false) AS released FROM ph p LEFT JOIN dec ON dec.block_id = p.id")
def decided_blocks(spark, d):
    rows, dec = _decided(spark, d)
    return J.apply_decisions(rows, dec)[0].select("block_id", "keep_original", "released")


@query("lost_decisions", f"WITH {PH} SELECT id * 2 AS block_id FROM ph WHERE id * 2 > (SELECT max(id) FROM ph)")
def lost_decisions(spark, d):
    """Decisions on blocks that don't exist."""
    return J.apply_decisions(*_decided(spark, d))[1].select("block_id")


def _decided(spark, d):
    rows = _phrases(spark, d)
    blocks = rows.select(F.lit("d").alias("doc_id"), F.col("id").alias("block_id"), (F.col("id") % 3 == 0).alias("keep_original"))
    return blocks, rows.select(F.lit("d").alias("doc_id"), (F.col("id") * 2).alias("block_id"), chosen(["keep", "translate"], F.col("id")).alias("action"))


@query("translations_joined", f"WITH {PH} SELECT p.id, coalesce(lower(q.text), '') AS target FROM ph p LEFT JOIN (SELECT * FROM ph WHERE id % 3 <> 1) q USING (id)")
def translations_joined(spark, d):
    rows = _phrases(spark, d)
    return J.with_translation(rows, rows.where("id % 3 <> 1").select("id", F.lower("text").alias("text")), ["id"]).select("id", "target")


@query("unit_statistics", f"WITH {PH}, b AS (SELECT id % 20 AS doc_id, id // 60 AS unit_no, ['text', 'formula', 'figure', 'heading'][id % 4 + 1] AS role FROM ph), u AS (SELECT doc_id, unit_no, count(*) AS k, count(*) FILTER (WHERE role = 'text') AS t FROM b GROUP BY ALL) SELECT doc_id, sum(k)::BIGINT AS blocks, sum(t)::BIGINT AS text_blocks, count(*) AS units, count(*) FILTER (WHERE k > 1) AS merged_units, ceil(count(*) / 25.0)::BIGINT AS requests_25, ceil(count(*) / 40.0)::BIGINT AS requests_40 FROM u GROUP BY doc_id")
def unit_statistics(spark, d):
    return A.grouping_statistics(_flagged(spark, d).select((F.col("id") % 20).alias("doc_id"), F.floor(F.col("id") / 60).alias("unit_no"), "role"))


@query("audit_changes", f"WITH {PH}, a AS (SELECT id % 30 AS page_no, count(*) AS n FROM ph WHERE {LETTERS} GROUP BY 1), b AS (SELECT id % 30 AS page_no, count(*) AS n FROM ph WHERE regexp_matches(text, '[一-鿿]') GROUP BY 1) SELECT page_no, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b USING (page_no)")
def audit_changes(spark, d):
    rows = _phrases(spark, d).withColumn("page_no", F.col("id") % 30)
    return C.audit_change(rows.where(F.col("text").rlike(r"\p{L}")), rows.where(F.col("text").rlike("[一-鿿]")), ["page_no"])


@query("capped_findings", f"WITH {PH} SELECT page_no, id FROM (SELECT id % 30 AS page_no, id, row_number() OVER (PARTITION BY id % 30 ORDER BY id) AS n FROM ph WHERE {LETTERS}) WHERE n <= 3")
def capped_findings(spark, d):
    rows = _phrases(spark, d).where(F.col("text").rlike(r"\p{L}")).select((F.col("id") % 30).alias("page_no"), "id")
    return C.capped(rows, ["page_no"], 3, ["id"])


SCOPES = ["只翻第3页", "第2页到第5页", "检查 3-7页 的数字", "第 12 页的表格", "全文", "第10至12页", "page 3", "12~ 第 14 页 和 第1页"]
_RANGE, _PAGE = X.SCOPE_RANGE, X.SCOPE_PAGE


@query("page_scopes", f"WITH s AS (SELECT c_custkey AS id, {chosen_sql(SCOPES, 'c_custkey')} AS t FROM customer) SELECT id, coalesce(try_cast(regexp_extract(t, '{_RANGE}', 1) AS INTEGER), try_cast(regexp_extract(t, '{_PAGE}', 1) AS INTEGER)) - 1 AS low, coalesce(try_cast(regexp_extract(t, '{_RANGE}', 2) AS INTEGER), try_cast(regexp_extract(t, '{_PAGE}', 1) AS INTEGER)) - 1 AS high FROM s")
def page_scopes(spark, d):
    return T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.scope_pages(chosen(SCOPES, F.col("c_custkey"))).alias("p")).select("id", "p.low", "p.high")


@query(
    "column_widths",
    """WITH c AS (SELECT l_orderkey AS table_no, l_linenumber AS col, l_partkey, l_quantity::DOUBLE AS width, (l_partkey % 80)::DOUBLE AS demand, l_suppkey % 3 = 0 AS num FROM lineitem),
    n AS (SELECT *, CASE WHEN num THEN greatest(demand, width) ELSE demand END AS need FROM c), f AS (SELECT *, NOT num AND need > 0 AS flex FROM n),
    s AS (SELECT *, sum(CASE WHEN flex THEN need ELSE 0 END) OVER t AS asked, sum(CASE WHEN flex THEN width ELSE 0 END) OVER t AS budget, sum(need) OVER t <= sum(width) OVER t OR NOT bool_or(flex) OVER t AS fits FROM f WINDOW t AS (PARTITION BY table_no)),
    h AS (SELECT *, budget * need / nullif(asked, 0) AS share, least(need, greatest(10.0, width)) AS low FROM s),
    g AS (SELECT *, sum(CASE WHEN flex THEN greatest(0, low - share) ELSE 0 END) OVER t AS lack, sum(CASE WHEN flex THEN greatest(0, share - low) ELSE 0 END) OVER t AS spare FROM h WINDOW t AS (PARTITION BY table_no))
    SELECT table_no, col, l_partkey, round(CASE WHEN flex AND NOT fits THEN greatest(greatest(share, low) - (greatest(share, low) - low) * CASE WHEN lack > 0 AND spare > 0 THEN least(1.0, lack / spare) ELSE 0 END, 5.0) ELSE width END, 6) AS new_width FROM g""",
)
def column_widths(spark, d):
    """Line items as the columns of a table an order: quantities are widths, part numbers demands."""
    from blockloom.operators.layout import rebalanced_columns

    c = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_no"), F.col("l_linenumber").alias("col"), "l_partkey", F.col("l_quantity").cast("double").alias("width"), (F.col("l_partkey") % 80).cast("double").alias("demand"), (F.col("l_suppkey") % 3 == 0).alias("numeric"))
    return rebalanced_columns(c, ["table_no"]).select("table_no", "col", "l_partkey", F.round("new_width", 6).alias("new_width"))


@query("layout_grids", f"WITH {PH}, b AS (SELECT id % 20 AS doc_id, id // 200 AS page_no, id, text, id % 3 * 100.0::DOUBLE AS x, (id // 20 % 4) * 20.0 + id % 3 AS y FROM ph) SELECT doc_id, page_no, (dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY r) - 1)::INTEGER AS row_id, texts FROM (SELECT doc_id, page_no, round((y - y % 20) / 20) AS r, string_agg(text, '|' ORDER BY x, id) AS texts FROM b GROUP BY ALL)")
def layout_grids(spark, d):
    """Texts of made-up pages by row, rows within three points, from left to right."""
    from blockloom.api import Session

    i = F.col("id")
    x, y = (i % 3) * 100.0, (F.floor(i / 20) % 4) * 20.0 + i % 3
    blocks = _phrases(spark, d).select((i % 20).alias("doc_id"), F.floor(i / 200).cast("int").alias("page_no"), i.cast("int").alias("local_no"), i.cast("int").alias("block_id"), "text", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10).alias("y1"))
    return Session(blocks).layout_grid().select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("long").alias("page_no"), "row_id", F.array_join("texts", "|").alias("texts"))
