"""Queries over numbers in sentences of line items and in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.operators import aggregates as A
from blockloom.queries.registry import BLOCKS, SENTENCES, amounts_sql, query
from blockloom.sources import tables as T


def _sentences(spark, d):
    return T.sentences(T.read(spark, d, "lineitem"))


@query("sentences", f"WITH {SENTENCES} SELECT * FROM sentences")
def sentences(spark, d):
    return _sentences(spark, d)


@query("amount_values", f"WITH {SENTENCES}, a AS ({amounts_sql('sentences', 'page_no', 'target')}) SELECT page_no, value, count(*) AS n FROM a GROUP BY page_no, value")
def amount_values(spark, d):
    return A.amount_counts(_sentences(spark, d), ["page_no"], "target").groupBy("page_no", "value").agg(F.sum("n").alias("n"))


@query("amount_roles", f"WITH {SENTENCES}, a AS ({amounts_sql('sentences', 'page_no', 'text')}) SELECT page_no, role, count(*) AS n FROM a GROUP BY page_no, role")
def amount_roles(spark, d):
    return A.amount_counts(_sentences(spark, d), ["page_no"]).groupBy("page_no", "role").agg(F.sum("n").alias("n"))


@query("number_tokens", f"WITH {BLOCKS}, a AS ({amounts_sql('blocks', 'doc_id, block_id', 'text')}) SELECT doc_id, role, value, count(*) AS n FROM a GROUP BY ALL")
def number_tokens(spark, d):
    return A.amount_counts(T.line_blocks(T.read(spark, d, "documents")), ["doc_id"])


@query(
    "numeric_diff",
    f"""WITH {SENTENCES}, s AS ({amounts_sql("sentences", "page_no", "text")}), t AS ({amounts_sql("sentences", "page_no", "target")}),
    sums AS (SELECT page_no, value, sum(a)::BIGINT AS n_source, sum(b)::BIGINT AS n_target FROM (SELECT page_no, value, 1 AS a, 0 AS b FROM s UNION ALL SELECT page_no, value, 0, 1 FROM t) WHERE value IS NOT NULL GROUP BY page_no, value)
    SELECT page_no, value, n_source, n_target, greatest(n_source - n_target, 0) AS missing, greatest(n_target - n_source, 0) AS extra FROM sums WHERE n_source <> n_target""",
)
def numeric_diff(spark, d):
    """Values that an order's sentences and their derived targets don't share, page by page."""
    return N.side_diff(N.amount_rows(_sentences(spark, d), ["page_no"], F.col("text"), F.col("target")), ["page_no"])


@query("numeric_diff_pages", f"SELECT count(*) AS pages, sum(missing)::BIGINT AS missing, sum(extra)::BIGINT AS extra FROM (WITH {SENTENCES}, s AS ({amounts_sql('sentences', 'page_no', 'text')}), t AS ({amounts_sql('sentences', 'page_no', 'target')}), sums AS (SELECT page_no, value, sum(a) AS x, sum(b) AS y FROM (SELECT page_no, value, 1 AS a, 0 AS b FROM s UNION ALL SELECT page_no, value, 0, 1 FROM t) WHERE value IS NOT NULL GROUP BY page_no, value) SELECT page_no, sum(greatest(x - y, 0)) AS missing, sum(greatest(y - x, 0)) AS extra FROM sums WHERE x <> y GROUP BY page_no)")
def numeric_diff_pages(spark, d):
    per = numeric_diff(spark, d).groupBy("page_no").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))
    return per.agg(F.count(F.lit(1)).alias("pages"), F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


_SIGNS = """SELECT {keys}, digits, sg <> '' OR par <> '' AS negative FROM (
  SELECT {keys}, regexp_replace(m, '[^0-9]', '', 'g') AS digits, CASE WHEN regexp_matches(m, '^[-−]') THEN '-' ELSE '' END AS sg, CASE WHEN regexp_matches(m, '[(（]') THEN '(' ELSE '' END AS par
  FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '[-−]?\\s*[(（]?\\s*[0-9][0-9,.]*')) AS m FROM {source})) WHERE length(digits) >= 6"""


@query("figure_signs", f"WITH {SENTENCES}, f AS ({_SIGNS.format(keys='page_no', text='target', source='sentences')}) SELECT page_no, digits, count(*) FILTER (WHERE NOT negative) AS positive, count(*) FILTER (WHERE negative) AS negative FROM f GROUP BY page_no, digits")
def figure_signs(spark, d):
    rows = N.sign_rows(_sentences(spark, d), ["page_no"], F.col("target"))
    return rows.groupBy("page_no", "digits").agg(A.count_if(~F.col("negative")).alias("positive"), A.count_if(F.col("negative")).alias("negative"))


@query(
    "sign_diff",
    f"""WITH {SENTENCES}, s AS ({_SIGNS.format(keys="page_no", text="text", source="sentences")}), t AS ({_SIGNS.format(keys="page_no", text="target", source="sentences")}),
    sums AS (SELECT page_no, digits, sum(a)::BIGINT AS src_neg, sum(b)::BIGINT AS tgt_neg FROM (SELECT page_no, digits, negative::INTEGER AS a, 0 AS b FROM s UNION ALL SELECT page_no, digits, 0, negative::INTEGER FROM t) GROUP BY page_no, digits)
    SELECT *, CASE WHEN src_neg > tgt_neg THEN 'fatal' ELSE 'advisory' END AS severity FROM sums WHERE src_neg <> tgt_neg""",
)
def sign_diff(spark, d):
    return A.sign_diff(_sentences(spark, d), ["page_no"], "text", "target", None)


@query("numeric_cell", "WITH c AS (SELECT l_orderkey, l_linenumber, unnest([l_returnflag, l_quantity::DECIMAL(18,2)::VARCHAR, format('{:,.2f}', l_extendedprice::DECIMAL(18,2)), '(' || l_linenumber || ')', l_linenumber || '%']) AS text FROM lineitem) SELECT l_orderkey, count(*) FILTER (WHERE NOT regexp_matches(text, '^\\s*[（(]?\\s*[一二三四五六七八九十0-9]{1,3}\\s*[)）]\\s*$') AND regexp_matches(text, '^\\s*[（(－\\-−]?\\s*(?:\\d{1,3}(?:\\s*[，,]\\s*\\d{3})+(?:\\s*[.．]\\s*\\d+)?|\\d+(?:\\s*[.．]\\s*\\d+)?)\\s*[%％]?\\s*[）)]?\\s*$')) AS figures, count(*) AS n FROM c GROUP BY l_orderkey")
def numeric_cell(spark, d):
    li = T.read(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("string")
    texts = F.array("l_returnflag", F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.concat(F.lit("("), n, F.lit(")")), F.concat(n, F.lit("%")))
    rows = li.select("l_orderkey", F.explode(texts).alias("text"))
    return rows.groupBy("l_orderkey").agg(A.count_if(N.is_numeric_cell(F.col("text"))).alias("figures"), F.count(F.lit(1)).alias("n"))


@query(
    "number_repair",
    """WITH p AS (SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice::DECIMAL(18,2)) AS good FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN good WHEN 1 THEN good ELSE regexp_replace(good, ',', '', 'g') END AS repaired FROM p""",
)
def number_repair(spark, d):
    """Prices with spaces behind their commas, with dots for commas, or without commas; all come back as printed."""
    li = T.read(spark, d, "lineitem")
    good = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    k = F.col("l_linenumber") % 3
    bad = F.when(k == 0, F.replace(good, F.lit(","), F.lit(", "))).when(k == 1, good).otherwise(F.replace(good, F.lit(","), F.lit("")))
    return li.select("l_orderkey", "l_linenumber", N.repair_number(bad).alias("repaired"))


@query(
    "section_numbers",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey % 90 + 1 AS p FROM lineitem)
    SELECT l_orderkey, n, CASE n % 3 WHEN 0 THEN 'word ' || p WHEN 1 THEN p || '.' || n ELSE p::VARCHAR END AS raw, (CASE n % 3 WHEN 1 THEN p * 100 + n ELSE p END)::BIGINT AS value FROM l""",
)
def section_numbers(spark, d):
    li = T.read(spark, d, "lineitem")
    n, p = F.col("l_linenumber"), (F.col("l_partkey") % 90 + 1).cast("string")
    line = F.when(n % 3 == 0, F.concat(F.lit("Section "), p, F.lit(" Prices"))).when(n % 3 == 1, F.concat(p, F.lit("."), n.cast("string"), F.lit(". Prices"))).otherwise(F.concat(F.lit("("), p, F.lit(") Prices")))
    return li.select("l_orderkey", n.alias("n"), F.explode(N.section_numbers(line)).alias("s")).select("l_orderkey", "n", "s.raw", "s.value")


@query("section_style", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_linenumber % 3) = 1 THEN CASE min(l_linenumber % 3) WHEN 0 THEN 'word' WHEN 1 THEN 'dot' ELSE 'plain' END ELSE 'mixed' END AS style FROM lineitem GROUP BY l_orderkey")
def section_style(spark, d):
    li = T.read(spark, d, "lineitem")
    n, p = F.col("l_linenumber"), (F.col("l_partkey") % 90 + 1).cast("string")
    line = F.when(n % 3 == 0, F.concat(F.lit("Section "), p, F.lit(" Prices"))).when(n % 3 == 1, F.concat(p, F.lit("."), n.cast("string"), F.lit(". Prices"))).otherwise(F.concat(F.lit("("), p, F.lit(") Prices")))
    text = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    return text.select("l_orderkey", N.section_style(N.section_numbers(F.col("t"))).alias("style"))


@query("unit_scale", "SELECT l_orderkey, l_linenumber, (l_quantity::DECIMAL(22,8) * (CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100000 END)::DECIMAL(15,0))::DECIMAL(38,8) AS value FROM lineitem")
def unit_scale(spark, d):
    li = T.read(spark, d, "lineitem")
    unit = F.element_at(F.array(F.lit(" pieces"), F.lit(" thousand"), F.lit(" million"), F.lit(" hundred thousand")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", N.scaled(F.col("l_quantity").cast("decimal(18,2)").cast("string"), N.unit_power(unit)).alias("value"))


@query(
    "entity_inventory",
    """WITH p AS (SELECT c_nationkey AS doc_id, c_custkey AS page_no, replace(c_mktsegment[1:1], ' ', '') || lower(c_mktsegment[2:]) || ' Group' AS a, c_custkey % 5 = 0 AS b FROM customer),
    n AS (SELECT doc_id, page_no, a AS name FROM p UNION ALL SELECT doc_id, page_no, 'Bank of Nation' FROM p WHERE b)
    SELECT doc_id, name, count(*) AS n, min(page_no) AS first_page, max(page_no) AS last_page FROM n GROUP BY doc_id, name""",
)
def entity_inventory(spark, d):
    return A.entity_inventory(_company_pages(spark, d), ["doc_id"]).drop("first_pos")


def _company_pages(spark, d):
    """A page per customer and a document per nation; pages name a group and some a bank."""
    seg = F.concat(F.substring("c_mktsegment", 1, 1), F.lower(F.substring("c_mktsegment", 2, 99)))
    text = F.concat(F.lit("we met "), seg, F.lit(" Group Co., Ltd. and talked, "), F.when(F.col("c_custkey") % 5 == 0, "then the Bank of Nation called.").otherwise("then left."))
    return T.read(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("page_no"), text.alias("text"))


@query(
    "entity_top10",
    """WITH p AS (SELECT c_custkey AS page_no, c_mktsegment[1:1] || lower(c_mktsegment[2:]) || ' Group' AS a, c_custkey % 5 = 0 AS b FROM customer),
    n AS (SELECT page_no, a AS name, 0 AS pos FROM p UNION ALL SELECT page_no, 'Bank of Nation', 1 FROM p WHERE b),
    i AS (SELECT name, count(*) AS n, min(page_no * 10 + pos) AS first FROM n GROUP BY name)
    SELECT name, n, row_number() OVER (ORDER BY n DESC, first, name)::INTEGER AS rank FROM i QUALIFY row_number() OVER (ORDER BY n DESC, first, name) <= 10""",
)
def entity_top10(spark, d):
    return A.top_entities(A.entity_inventory(_company_pages(spark, d), []), []).select("name", "n", "rank")


@query("identity", f"WITH {BLOCKS} SELECT doc_id, count(*) FILTER (WHERE length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 12 OR len(string_split(t, ' ')) >= 3) AS identical FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM blocks) GROUP BY doc_id")
def identity(spark, d):
    b = T.line_blocks(T.read(spark, d, "documents"))
    return b.groupBy("doc_id").agg(A.count_if(X.is_identity(F.col("text"), F.concat(F.lit("  "), F.lower("text")))).alias("identical"))
