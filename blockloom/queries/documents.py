"""Queries over the lines of documents: predicates, language, terms, cache, overlay, conversations, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.operators import aggregates as A
from blockloom.operators import joins as J
from blockloom.operators import sequence as S
from blockloom.queries.registry import BLOCKS, ORACLES, query
from blockloom.sources import ingest as I
from blockloom.sources import sinks as K
from blockloom.sources import tables as T
from blockloom.streaming.upserts import newest, op_budget


def _blocks(spark, d):
    return T.line_blocks(T.read(spark, d, "documents"))


@query("line_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")
def line_blocks(spark, d):
    return _blocks(spark, d)


def _test(name: str, test, sql: str) -> None:
    """Counts per document of the blocks that a predicate holds for."""

    @query(name, f"WITH {BLOCKS} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {sql}) AS hits FROM blocks GROUP BY doc_id")
    def run(spark, d):
        return _blocks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), A.count_if(test(F.col("text"))).alias("hits"))


_MARKS = "length(trim(text)) - length(regexp_replace(trim(text), '[=+−×÷±∑∏∫√∞≈≠≤≥≡→←↑↓^_/()|-]', '', 'g'))"
_FORMULA = f"""(trim(text) <> '' AND NOT regexp_matches(text, '[一-鿿]') AND length(trim(text)) <= 70 AND {_MARKS} >= 2 AND ({_MARKS}) / greatest(1, length(trim(text))) >= 0.12
  AND CASE WHEN NOT regexp_matches(text, '[=≈≤≥≡]') THEN regexp_matches(text, '[∑∫√π]|[\\^_]|exp\\(|log\\(|/\\s*[a-zA-Z]') AND {_MARKS} >= 3
           WHEN NOT regexp_matches(text, '[∑∫√π]|[\\^_]|exp\\(|log\\(|/\\s*[a-zA-Z]') AND {_MARKS} < 3 THEN false
           ELSE true END)"""
_test("needs_translation", X.needs_translation, f"regexp_matches(text, '\\p{{L}}') AND NOT {_FORMULA}")
_test("formula_block", X.is_formula, _FORMULA)
_test("pure_symbol", X.is_pure_symbol, "NOT regexp_matches(text, '[A-Za-z0-9一-鿿]')")
_test("entry_start", X.is_entry, "regexp_matches(text, '^[•▪●■◆◇✦✧❖❤➡→←▸▶»‣⁃∙·❚◘○]|^(?:\\*|-|–|—)\\s+|^\\d{1,3}[.)]|^(?:[（(]\\s*[一二三四五六七八九十百零〇0-9]{1,4}\\s*[）)]|[①-⑳]|[一二三四五六七八九十百零〇0-9]{1,3}[、．])|^[A-Za-z一-鿿][^:\\n]{0,40}:(?:\\s|$)|^[A-Za-z一-鿿][^:\\n：]{0,14}：')")
_test("number_atom", X.is_number_atom, "regexp_matches(text, '^[+-]?[0-9][0-9,.\\s/%]*[%％]?$')")
_test("amount_atom", X.is_amount_atom, "regexp_matches(text, '^[^\\d]{0,4}\\d[\\d,./\\-]*[^\\d]{0,4}$')")
_test("latin_prose", X.is_latin_prose, "NOT regexp_matches(text, '[一-鿿]') AND len(regexp_extract_all(text, '[A-Za-z]+(?:[’''-][A-Za-z]+)*')) >= 3")
_test("residual_cjk_blocks", X.has_residual_cjk, "regexp_matches(text, '[一-鿿]{2}') OR regexp_matches(regexp_replace(text, '[元圆角分万亿年月日号个]', '', 'g'), '[一-鿿]')")
_test("scan_like", X.is_scan_like, "NOT regexp_matches(text, '\\p{L}') AND NOT regexp_matches(array_to_string(regexp_extract_all(text, '[+-]?[0-9][0-9,.，．]*[0-9%]|[+-]?[0-9]'), ' '), '[,，.．%]')")
_test("strong_figure", N.is_strong_figure, "regexp_matches(text, '\\d[\\d\\s]*[.,，．%％]|\\d{4,}')")
_test("page_furniture", lambda t: X.is_page_furniture(t, F.lit(False), F.lit(False)), "trim(text) <> '' AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 12 AND NOT regexp_matches(text, '\\p{L}')")


@query("block_text", f"WITH {BLOCKS} SELECT doc_id, block_id, md5(text) AS block_hash, CASE WHEN length(t) <= 30 THEN t ELSE t[1:30] || '…' END AS snippet, t AS cleaned FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM blocks)")
def block_text(spark, d):
    t = F.col("text")
    return _blocks(spark, d).select("doc_id", "block_id", X.block_hash(t).alias("block_hash"), X.snippet(t).alias("snippet"), X.clean_text(t).alias("cleaned"))


_COUNTS = "sum(length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')))::BIGINT AS cjk, sum(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::BIGINT AS latin"
_LANGUAGE = "CASE WHEN cjk = 0 AND latin = 0 THEN 'unknown' WHEN cjk >= latin THEN 'zh' WHEN latin >= cjk * 5 THEN 'en' ELSE 'mixed' END"


@query("detect_language", f"WITH {BLOCKS} SELECT *, {_LANGUAGE} AS language FROM (SELECT doc_id, {_COUNTS} FROM blocks GROUP BY doc_id)")
def detect_language(spark, d):
    return A.document_language(_blocks(spark, d))


@query("lang_counts", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def lang_counts(spark, d):
    return T.read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_STOP = ", ".join(f"'{w}'" for w in A.STOPWORDS)


@query(
    "latin_terms",
    f"""WITH {BLOCKS},
    hits AS (SELECT doc_id, block_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT doc_id, block_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-z]{{2,}}$|^[A-Z]{{3,}}$')) AS w FROM blocks)),
    found AS (SELECT doc_id, term, count(*) AS n, min(block_id::BIGINT * 1000000000 + pos) AS first FROM hits GROUP BY doc_id, term HAVING count(*) >= 2 AND lower(term) NOT IN ({_STOP}))
    SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, term)::INTEGER AS rank FROM found) WHERE rank <= 80""",
)
def latin_terms(spark, d):
    return A.latin_terms(_blocks(spark, d), ["doc_id"])


@query(
    "ngram_terms",
    f"""WITH {BLOCKS},
    runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{{2,}}')) AS run FROM blocks),
    lens AS (SELECT doc_id, run, unnest(range(2, least(20, length(run)) + 1)) AS n FROM runs),
    grams AS (SELECT doc_id, n, unnest(list_transform(range(1, length(run) - n + 2), lambda i: run[i:i + n - 1])) AS gram FROM lens),
    freq AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY doc_id, gram HAVING count(*) >= 2),
    covered AS (SELECT doc_id, gram[1:length(gram) - 1] AS gram FROM freq WHERE length(gram) > 2 UNION SELECT doc_id, gram[2:length(gram)] FROM freq WHERE length(gram) > 2)
    SELECT doc_id, gram, n FROM freq ANTI JOIN covered USING (doc_id, gram) WHERE length(gram) <= 12""",
)
def ngram_terms(spark, d):
    """Character n-grams of lower-case Latin runs: the rule of CJK terms over the letters that the table has."""
    return A.ngram_terms(_blocks(spark, d), ["doc_id"], run="[a-z]{2,}", edge="[0-9]", numerals="^[0-9]+$")


_CACHE = "SELECT md5(text) AS block_hash, any_value(lower(text)) AS text FROM blocks WHERE length(text) % 3 = 0 GROUP BY md5(text)"


def _cache(blocks):
    """Blocks whose length is a multiple of three have been translated before."""
    return blocks.where("length(text) % 3 = 0").groupBy(F.md5("text").alias("block_hash")).agg(F.first(F.lower("text")).alias("text"))


@query("cache_todo", f"WITH {BLOCKS}, cache AS ({_CACHE}) SELECT md5(text) AS block_hash, any_value(text) AS text FROM blocks WHERE md5(text) NOT IN (SELECT block_hash FROM cache) GROUP BY md5(text)")
def cache_todo(spark, d):
    b = _blocks(spark, d)
    return J.cache_todo(b.withColumn("block_hash", F.md5("text")), _cache(b))


@query("cache_fill", f"WITH {BLOCKS}, cache AS ({_CACHE}) SELECT b.doc_id, b.block_id, CASE WHEN c.text IS NOT NULL AND b.block_id % 5 <> 0 THEN c.text ELSE b.text END AS target FROM blocks b LEFT JOIN cache c ON md5(b.text) = c.block_hash")
def cache_fill(spark, d):
    b = _blocks(spark, d)
    return J.cache_fill(b.withColumn("block_hash", F.md5("text")), _cache(b), F.col("block_id") % 5 == 0).select("doc_id", "block_id", "target")


@query("cache_seed", f"WITH {BLOCKS}, cache AS ({_CACHE}), fresh AS (SELECT md5(text) AS block_hash, arg_max('y ' || text, doc_id * 1000000 + block_id) AS text FROM blocks WHERE length(text) % 4 <> 1 GROUP BY md5(text)) SELECT * FROM fresh UNION ALL SELECT * FROM cache ANTI JOIN fresh USING (block_hash)")
def cache_seed(spark, d):
    b = _blocks(spark, d)
    pieces = b.where("length(text) % 4 <> 1").select("text", F.concat(F.lit("y "), "text").alias("target"), (F.col("doc_id") * 1000000 + F.col("block_id")).alias("block_id"))
    return K.seed_cache(_cache(b), pieces)


@query(
    "overlay_apply",
    f"""WITH {BLOCKS},
    overlay AS (SELECT user_id AS doc_id, (event_id % 20)::INTEGER AS block_id, event_id AS version, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'set' END AS action, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE props END AS text FROM events),
    latest AS (SELECT doc_id, block_id, arg_max(action, version) AS action, arg_max(text, version) AS text FROM overlay GROUP BY doc_id, block_id)
    SELECT b.doc_id, b.block_id, CASE WHEN o.action <> 'delete' AND trim(o.text) <> '' THEN o.text ELSE lower(b.text) END AS target FROM blocks b LEFT JOIN latest o ON o.doc_id = b.doc_id AND o.block_id = b.block_id""",
)
def overlay_apply(spark, d):
    e = T.read(spark, d, "events")
    log = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 20).cast("int").alias("block_id"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "purchase", "delete").otherwise("set").alias("action"), F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("props")).alias("text"))
    translated = _blocks(spark, d).withColumn("target", F.lower("text"))
    return J.overlay_wins(translated, J.latest_overlay(log, ["doc_id", "block_id"]), ["doc_id", "block_id"]).select("doc_id", "block_id", "target")


@query("latest_overlay", "SELECT user_id, (event_id % 50)::BIGINT AS slot, arg_max(props, event_id) AS text FROM events GROUP BY ALL")
def latest_overlay(spark, d):
    return newest(T.read(spark, d, "events").select("user_id", (F.col("event_id") % 50).alias("slot"), "event_id", F.col("props").alias("text")), ["user_id", "slot"], "event_id")


@query("op_budget", "SELECT event_id, user_id, row_number() OVER w AS step, row_number() OVER w <= 10 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def budget(spark, d):
    return op_budget(T.read(spark, d, "events"), "user_id", ["ts", "event_id"], 10).select("event_id", "user_id", F.col("step").cast("long").alias("step"), "allowed")


@query("batches", None)
def batches(spark, d):
    """Request batches of every document."""
    return S.request_batches(_blocks(spark, d), budget=600, most=25).select("doc_id", "block_id", "batch_no")


_GREEDY = """WITH RECURSIVE {blocks},
    sized AS (SELECT doc_id, block_id, length(text) + length(block_id::VARCHAR) + 6 AS s FROM blocks),
    walk AS (
      SELECT doc_id, block_id, s AS used, 1 AS held, 0 AS batch_no FROM sized WHERE block_id = 0
      UNION ALL
      SELECT n.doc_id, n.block_id, CASE WHEN w.used + n.s > {budget} OR w.held >= 25 THEN n.s ELSE w.used + n.s END,
             CASE WHEN w.used + n.s > {budget} OR w.held >= 25 THEN 1 ELSE w.held + 1 END, w.batch_no + CASE WHEN w.used + n.s > {budget} OR w.held >= 25 THEN 1 ELSE 0 END
      FROM walk w JOIN sized n ON n.doc_id = w.doc_id AND n.block_id = w.block_id + 1
    ) """


ORACLES["batches"] = _GREEDY.format(blocks=BLOCKS, budget=600) + "SELECT doc_id, block_id, batch_no FROM walk"


@query("batch_sizes", _GREEDY.format(blocks=BLOCKS, budget=4000) + "SELECT doc_id, batch_no, count(*) AS n, sum(s)::BIGINT AS size FROM walk JOIN sized USING (doc_id, block_id) GROUP BY doc_id, batch_no")
def batch_sizes(spark, d):
    rows = S.request_batches(_blocks(spark, d)).withColumn("s", F.length("text") + F.length(F.col("block_id").cast("string")) + 6)
    return rows.groupBy("doc_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("size"))


@query("prose_units", None)
def prose_units(spark, d):
    """Units of at most 400 characters; every 9th block isn't joinable."""
    b = _blocks(spark, d).withColumn("group_id", F.col("page_no")).withColumn("joinable", (F.col("block_id") % 9 != 0) & ~X.is_entry(F.col("text")))
    return S.prose_units(b, most=400).select("doc_id", "block_id", "unit_no")


_ENTRY = "regexp_matches(text, '^[•▪●■◆◇✦✧❖❤➡→←▸▶»‣⁃∙·❚◘○]|^(?:\\*|-|–|—)\\s+|^\\d{1,3}[.)]|^[A-Za-z一-鿿][^:\\n]{0,40}:(?:\\s|$)|^[A-Za-z一-鿿][^:\\n：]{0,14}：')"
ORACLES["prose_units"] = f"""WITH RECURSIVE {BLOCKS},
    rows AS (SELECT doc_id, block_id, page_no AS g, length(text) AS s, block_id % 9 <> 0 AND NOT {_ENTRY} AS j FROM blocks),
    walk AS (
      SELECT doc_id, block_id, g, s AS used, j AS open, 0 AS unit_no FROM rows WHERE block_id = 0
      UNION ALL
      SELECT n.doc_id, n.block_id, n.g, CASE WHEN w.open AND n.j AND w.g = n.g AND w.used + 1 + n.s <= 400 THEN w.used + 1 + n.s ELSE n.s END,
             n.j, w.unit_no + CASE WHEN w.open AND n.j AND w.g = n.g AND w.used + 1 + n.s <= 400 THEN 0 ELSE 1 END
      FROM walk w JOIN rows n ON n.doc_id = w.doc_id AND n.block_id = w.block_id + 1
    ) SELECT doc_id, block_id, unit_no FROM walk"""


@query(
    "ir_groups",
    f"""WITH {BLOCKS},
    styled AS (SELECT *, block_id % 7 = 3 AS verbatim, (block_id // 5) % 3 AS size, block_id % 11 IN (4, 5) AS in_table FROM blocks),
    marked AS (SELECT *, CASE WHEN in_table THEN true ELSE NOT coalesce(lag(page_no) OVER w = page_no AND NOT lag(in_table) OVER w AND NOT verbatim AND NOT lag(verbatim) OVER w AND lag(size) OVER w = size, false) END AS starts FROM styled WINDOW w AS (PARTITION BY doc_id ORDER BY block_id))
    SELECT doc_id, block_id, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY block_id)::BIGINT AS group_id FROM marked""",
)
def ir_groups(spark, d):
    b = _blocks(spark, d).withColumn("verbatim", F.col("block_id") % 7 == 3).withColumn("size", F.floor(F.col("block_id") / 5) % 3).withColumn("in_table", (F.col("block_id") % 11).isin(4, 5))
    b = b.withColumns({"role": F.lit("text"), "table_ref": F.lit(0), "bold": F.lit(False), "align": F.lit("left"), "color": F.lit(0)})
    return S.ir_groups(b).select("doc_id", "block_id", F.col("group_id").cast("long").alias("group_id"))


@query(
    "neighbour_context",
    f"""WITH {BLOCKS},
    rows AS (SELECT *, block_id // 6 AS batch_id, block_id % 6 + 1 AS no FROM blocks),
    near AS (
      SELECT doc_id, batch_id, block_id, page_no, no, 0 AS side, lag(text) OVER w AS t, lag(batch_id) OVER w AS b, lag(page_no) OVER w AS p FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)
      UNION ALL SELECT doc_id, batch_id, block_id, page_no, no, 1, lead(text) OVER w, lead(batch_id) OVER w, lead(page_no) OVER w FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)),
    lines AS (SELECT doc_id, batch_id, block_id, side, '#' || no || CASE side WHEN 0 THEN ' before: ' ELSE ' after: ' END || CASE side WHEN 0 THEN right(f, 80) ELSE left(f, 80) END AS line
              FROM (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS f FROM near WHERE b <> batch_id AND p = page_no AND regexp_matches(t, '\\p{{L}}')))
    SELECT * EXCLUDE used FROM (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id, batch_id ORDER BY block_id, side) AS used FROM lines) WHERE used <= 1200""",
)
def neighbour_context(spark, d):
    return J.neighbour_context(_blocks(spark, d).withColumn("batch_id", F.floor(F.col("block_id") / 6)))


@query(
    "policy_candidates",
    f"""WITH {BLOCKS},
    offered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_id) AS n FROM blocks WHERE regexp_matches(text, '\\p{{L}}') AND length(text) % 3 <> 0 AND NOT (length(text) % 3 = 1 AND length(text) % 5 = 0) AND NOT {_FORMULA}),
    few AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS rank FROM offered WHERE n <= 6)
    SELECT doc_id, page_no, block_id, text, rank FROM few WHERE rank <= 20""",
)
def policy_candidates(spark, d):
    """Blocks on offer to a policy: six of a page, 20 of a document. A block's length says whether it is scanned, a cell or in a figure."""
    n = F.length("text")
    own = _blocks(spark, d).withColumn("ocr", n % 3 == 1).withColumn("in_table", n % 5 == 0).withColumn("role", F.when(n % 3 == 2, "figure").otherwise("text"))
    return J.policy_candidates(own, most=20).select("doc_id", "page_no", "block_id", "text", F.col("rank").cast("long").alias("rank"))


@query("glossary_missing", "WITH g AS (SELECT DISTINCT trim(text) AS term, lower(trim(text)) AS required FROM benchmark WHERE trim(text) <> '') SELECT doc_id, term, required FROM documents JOIN g ON contains(text, term) AND NOT contains(CASE WHEN length(text) % 3 = 0 THEN lower(text) ELSE '' END, required)")
def glossary_missing(spark, d):
    """Benchmark passages as terms; documents whose length is a multiple of three are translated in full, the others lack everything."""
    g = T.read(spark, d, "benchmark").select(F.trim("text").alias("source")).where("source <> ''").distinct().withColumn("target", F.lower("source"))
    target = F.when(F.length("text") % 3 == 0, F.lower("text")).otherwise("")
    return J.glossary_missing(T.read(spark, d, "documents").select("doc_id", "text", target.alias("target")), g)


@query(
    "doc_dup_containment",
    f"""WITH {BLOCKS}, b AS (SELECT doc_id, page_no, block_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM blocks)
    SELECT o.doc_id, o.page_no, o.block_id FROM b o WHERE o.block_id % 2 = 1 AND o.t <> '' AND NOT EXISTS (SELECT 1 FROM b k WHERE k.doc_id = o.doc_id AND k.page_no = o.page_no AND k.block_id % 2 = 0 AND k.t <> '' AND (contains(o.t, k.t) OR contains(k.t, o.t)))""",
)
def doc_dup_containment(spark, d):
    """Odd lines as scanned blocks, even ones as the text layer, all at one place."""
    b = _blocks(spark, d).withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(9.0), "y1": F.lit(9.0)})
    return J.new_ocr_blocks(b.where("block_id % 2 = 1"), b.where("block_id % 2 = 0"), ["doc_id", "page_no"]).select("doc_id", "page_no", "block_id")


@query(
    "message_window",
    """WITH rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, length(coalesce(text, '')) AS s FROM conversations),
    started AS (SELECT *, CASE WHEN n <= 6 THEN 0 ELSE coalesce(max(CASE WHEN role = 'user' AND i >= 1 AND i <= greatest(0, n - 6) + 1 THEN i END) OVER (PARTITION BY conv_id), 1) END AS st FROM rows),
    kept AS (SELECT * FROM started WHERE i = 0 OR i >= st),
    sums AS (SELECT *, sum(s) OVER (PARTITION BY conv_id) AS whole, sum(CASE WHEN i = 0 THEN s ELSE 0 END) OVER (PARTITION BY conv_id) + sum(CASE WHEN i > 0 THEN s ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM kept),
    cuts AS (SELECT *, CASE WHEN whole <= 2000 THEN min(CASE WHEN i >= 1 THEN i END) OVER (PARTITION BY conv_id) ELSE coalesce(min(CASE WHEN i >= 1 AND rest <= 2000 AND role = 'user' THEN i END) OVER (PARTITION BY conv_id), n - 1) END AS cut FROM sums)
    SELECT conv_id, turn, role, text FROM cuts WHERE i = 0 OR i >= cut""",
)
def message_window(spark, d):
    return S.message_window(T.read(spark, d, "conversations").select("conv_id", "turn", "role", "text"), cap=6, budget=2000)


@query(
    "chat_window",
    """WITH rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    f AS (SELECT *, CASE WHEN n <= 4 THEN 1 ELSE coalesce(min(CASE WHEN role = 'user' AND i > n - 4 THEN i END) OVER (PARTITION BY conv_id), max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id)) END AS s FROM rows)
    SELECT conv_id, turn, role, text FROM f WHERE i >= s""",
)
def chat_window(spark, d):
    return S.chat_window(T.read(spark, d, "conversations").select("conv_id", "turn", "role", "text"), cap=4)


@query("plain_text", f"WITH {BLOCKS}, pages AS (SELECT doc_id, page_no, '===== Page ' || (page_no + 1) || ' =====' || chr(10) || string_agg(lower(text), chr(10) ORDER BY block_id) || chr(10) AS t FROM blocks GROUP BY doc_id, page_no) SELECT doc_id, string_agg(t, chr(10) ORDER BY page_no) AS text FROM pages GROUP BY doc_id")
def plain_text(spark, d):
    b = _blocks(spark, d).withColumn("target", F.lower("text"))
    return K.plain_text(K.by_page(b.select("doc_id", "page_no").distinct(), b, ["doc_id"]), ["doc_id"])


@query("interleaved_pages", f"WITH {BLOCKS}, p AS (SELECT DISTINCT doc_id, page_no FROM blocks) SELECT doc_id, page_no, 'source' AS side, page_no * 2 AS output_page FROM p UNION ALL SELECT doc_id, page_no, 'target', page_no * 2 + 1 FROM p")
def interleaved_pages(spark, d):
    return K.interleaved(_blocks(spark, d).select("doc_id", "page_no").distinct(), ["doc_id"])


@query("html_headings", None)
def html_headings(spark, d):
    return I.html_regions(T.read(spark, d, "pages"))
