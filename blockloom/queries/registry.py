"""The registry, and SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Lines of documents as blocks (doc_id, page_no, local_no, block_id, text).
BLOCKS = """
parts AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
blocks AS (
  SELECT doc_id, (b // 40)::INTEGER AS page_no, (b % 40)::INTEGER AS local_no, b::INTEGER AS block_id, text
  FROM (SELECT doc_id, unnest(range(len(l))) AS b, unnest(l) AS text FROM parts)
)"""

#: Blocks with a derived target (doc_id, page_no, block_id, text, target).
PAIRS = (
    BLOCKS
    + """,
pairs AS (
  SELECT doc_id, page_no, block_id, text,
         CASE WHEN (doc_id + block_id) % 11 = 0 THEN ''
              WHEN (doc_id + block_id) % 7 = 0 THEN 'x ' || lower(regexp_replace(text, '^([^0-9]*)[0-9]', '\\1'))
              WHEN (doc_id + block_id) % 13 = 0 THEN text ELSE 'x ' || lower(text) END AS target
  FROM blocks
)"""
)

#: Sentences of line items (page_no, block_no, text, target).
SENTENCES = """
raw AS (
  SELECT l_orderkey AS page_no, l_linenumber AS block_no, l_orderkey * 7 + l_linenumber AS k,
         'Quantity ' || l_quantity::DECIMAL(18,2)::VARCHAR || ' price ' AS a, format('{:,.2f}', l_extendedprice::DECIMAL(18,2)) AS p,
         (l_extendedprice::DECIMAL(18,2)::DECIMAL(18,5) * 0.001::DECIMAL(4,3))::DECIMAL(18,5)::VARCHAR AS th,
         ' discount ' || l_discount::DECIMAL(18,2)::VARCHAR || '%' AS z
  FROM lineitem
),
sentences AS (
  SELECT page_no, block_no, a || p || z AS text,
         CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN regexp_replace(a || p || z, '^([^0-9]*)[0-9]', '\\1')
              WHEN k % 17 = 0 THEN a || th || ' thousand yuan' || z WHEN k % 19 = 0 THEN a || '-' || p || z ELSE a || p || z END AS target
  FROM raw
)"""

#: Line items with a number from 1 in each order.
ITEMS = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS row_no FROM lineitem)"""

#: Grid cells of line items (page_no, item_no, row_no, col_no, text and box).
GRID = (
    ITEMS
    + """,
cells AS (
  SELECT l_orderkey AS page_no, row_no, unnest(range(5))::INTEGER AS col_no,
         unnest([l_returnflag, l_quantity::DECIMAL(18,2)::VARCHAR, l_extendedprice::DECIMAL(18,2)::VARCHAR, l_discount::DECIMAL(18,2)::VARCHAR, l_tax::DECIMAL(18,2)::VARCHAR]) AS text
  FROM li
),
placed AS (
  SELECT page_no, row_no, col_no, text, length(text) * 6.0::DOUBLE AS w,
         row_no * 20.0::DOUBLE + CASE WHEN col_no % 2 = 1 THEN 2.0 ELSE 0.0 END AS y0 FROM cells
),
grid AS (
  SELECT page_no, (row_no * 10 + col_no)::INTEGER AS item_no, row_no, col_no, text,
         CASE WHEN col_no = 0 THEN 0.0::DOUBLE ELSE col_no * 120.0::DOUBLE + 100.0 - w END AS x0, y0,
         CASE WHEN col_no = 0 THEN 0.0::DOUBLE ELSE col_no * 120.0::DOUBLE + 100.0 - w END + w AS x1, y0 + 10.0 AS y1
  FROM placed
)"""
)


def amounts_sql(source: str, keys: str, text: str) -> str:
    """SQL for rows (keys, role, value) of the amounts in `text` of `source`."""
    token = "[+-]?[0-9][0-9,.]*[0-9%]|[+-]?[0-9]"
    return f"""
    SELECT {keys}, role, CASE WHEN neg THEN -size ELSE size END AS value FROM (
      SELECT {keys}, (CASE WHEN neg THEN 'M' ELSE '' END) || translate(core, '.,', 'DC') AS role, neg,
             (try_cast(regexp_replace(tok, '[,%+-]', '', 'g') AS DECIMAL(22,8)) * (CASE power WHEN 3 THEN 1000 WHEN 6 THEN 1000000 ELSE 1 END)::DECIMAL(15,0))::DECIMAL(38,8) AS size
      FROM (
        SELECT {keys}, tok, regexp_replace(tok, '[^0-9.,]', '', 'g') AS core, (regexp_matches(before, '[(（]$') OR contains(tok, '-')) AS neg,
               CASE WHEN regexp_matches(win, '(?i)^\\s*thousand\\b') THEN 3 WHEN regexp_matches(win, '(?i)^\\s*million\\b') THEN 6 ELSE 0 END AS power, win
        FROM (
          SELECT {keys}, toks[i] AS tok, btw[i] AS before, CASE WHEN i = len(toks) THEN btw[i + 1][1:16] ELSE btw[i + 1] END AS win
          FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM (
            SELECT {keys}, regexp_extract_all({text}, '{token}') AS toks, string_split_regex({text}, '{token}') AS btw FROM {source}))
        ))
      WHERE regexp_matches(tok, '[,.%]') OR power <> 0 OR regexp_matches(win, '(?i)^\\s*(?:元|人民币|RMB|yuan|USD|CNY|dollars?)(?:[^A-Za-z]|$)')
    )"""


MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def signature_sql(source: str, keys: str, text: str) -> str:
    """SQL for rows (keys, figure, value) of the numbers in `text` of `source`, by the rules of blocks."""
    body = f"translate({text}, '０１２３４５６７８９．，−–—', '0123456789.,---')"
    for i, m in enumerate(MONTH_NAMES):
        body = f"regexp_replace({body}, '\\b(?:{m}|{'Sept|Sep' if m == 'September' else m[:3]})\\b', '{i + 1}', 'g')"
    body = f"regexp_replace({body}, '([-+])\\s+([0-9])', '\\1\\2', 'g')"
    for _ in range(2):
        body = f"regexp_replace({body}, '([0-9])-([0-9])', '\\1 - \\2', 'g')"
    token = "[-+]?[0-9][0-9,]*(?:[.][0-9]+)?"
    power = "CASE WHEN regexp_matches(win, '(?i)^\\s*((ten|hundred)\\s+)?(thousand|million|billion|trillion)\\b') THEN CASE lower(regexp_extract(win, '(?i)^\\s*(?:(?:ten|hundred)\\s+)?(thousand|million|billion|trillion)\\b', 1)) WHEN 'thousand' THEN 3 WHEN 'million' THEN 6 WHEN 'billion' THEN 9 ELSE 12 END + CASE lower(regexp_extract(win, '(?i)^\\s*(ten|hundred)\\s', 1)) WHEN 'ten' THEN 1 WHEN 'hundred' THEN 2 ELSE 0 END WHEN regexp_matches(win, '^\\s*万亿') THEN 12 WHEN regexp_matches(win, '^\\s*亿') THEN 8 WHEN regexp_matches(win, '^\\s*万') THEN 4 ELSE 0 END"
    return f"""
    SELECT * FROM (
      SELECT {keys}, regexp_matches(tok, '[0-9][.,][0-9]') OR left(win, 1) = '%' OR power <> 0 OR regexp_matches(win, '^\\s*(?:yuan|rmb|cny|usd|eur|hkd|jpy|dollars?|元|美元|港元|人民币)') AS figure,
             (try_cast(replace(tok, ',', '') AS DECIMAL(22,8)) * (10::HUGEINT ** power)::DECIMAL(15,0))::DECIMAL(38,8) AS value
      FROM (SELECT *, {power} AS power FROM (
        SELECT {keys}, toks[i] AS tok, CASE WHEN i = len(toks) THEN btw[i + 1][1:16] ELSE btw[i + 1] END AS win
        FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT {keys}, regexp_extract_all(b, '{token}') AS toks, string_split_regex(b, '{token}') AS btw FROM (SELECT {keys}, {body} AS b FROM {source}))))))
    WHERE value IS NOT NULL"""
