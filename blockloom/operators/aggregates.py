"""Aggregations over blocks, pages and documents."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.functions.geometry import upper_median
from blockloom.operators.sequence import numbered


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def dominant_kind(pages: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """pages with dominant: the first of formula, figure, table that has more regions than text has; else null."""
    counts = regions.groupBy(*keys).agg(*[count_if(F.col("kind") == k).alias("_" + k) for k in ("formula", "figure", "table", "text")])
    rule = F.when(F.col("_formula") > F.col("_text"), "formula").when(F.col("_figure") > F.col("_text"), "figure").when(F.col("_table") > F.col("_text"), "table")
    return pages.join(counts, keys, "left").select(*pages.columns, rule.alias("dominant"))


def page_kind(pages: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys and kind of every page, pages without blocks included: scan, chart, uncertain, formula, figure or
    normal. blocks: ocr, vertical; pages: dominant (null: none)."""
    seen = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("ocr")).alias("n_ocr"), count_if(F.col("vertical")).alias("n_vertical"))
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 0, "uncertain").when(F.col("n_ocr") == n, "scan").when(F.col("n_vertical") >= 3, "chart").when(F.col("n_ocr") > 0, "uncertain").when(F.col("dominant").isin("formula", "figure"), F.col("dominant")).otherwise("normal")
    return pages.join(seen, keys, "left").select(*keys, kind.alias("kind"))


def document_language(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    cjk, latin = X.letter_counts(F.col("text"))
    sums = blocks.groupBy(doc).agg(F.sum(cjk).alias("cjk"), F.sum(latin).alias("latin"))
    return sums.select(doc, "cjk", "latin", X.language_of(F.col("cjk"), F.col("latin")).alias("language"))


def document_info(kinds: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages by kind, special pages, block count and language per document. scan_pages counts pages read by OCR."""
    pages = kinds.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), *[count_if(F.col("kind") == k).alias(n) for k, n in (("normal", "text_pages"), ("scan", "scan_pages"), ("chart", "chart_pages"), ("table", "table_pages"), ("uncertain", "uncertain_pages"), ("formula", "formula_pages"), ("figure", "figure_pages"))])
    cjk, latin = X.letter_counts(F.col("text"))
    own = blocks.groupBy(doc).agg(F.count(F.lit(1)).alias("block_count"), F.sum(cjk).alias("_c"), F.sum(latin).alias("_l"))
    special = sum((F.col(c) for c in ("table_pages", "uncertain_pages", "scan_pages", "formula_pages", "figure_pages")), F.col("chart_pages"))
    out = pages.join(own, doc, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*pages.columns, special.alias("special_pages"), zero("block_count").cast("long").alias("block_count"), X.language_of(zero("_c"), zero("_l")).alias("language"))


def amount_counts(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, role, value, n: the multiset of a page's amounts in both views."""
    return N.amount_rows(pages, keys, F.col(text)).groupBy(*keys, "role", "value").agg(F.count(F.lit(1)).alias("n"))


def sign_diff(pages: DataFrame, keys: list[str], source: str, target: str, most: int | None = 8) -> DataFrame:
    """keys, digits, negatives on both sides, and severity: fatal where the target lost a negative, advisory where
    it has one more. At most `most` of each per page (null: all)."""
    negatives = lambda side: F.sum(((F.col("side") == side) & F.col("negative")).cast("long"))
    sums = N.sign_rows(pages, keys, F.col(source), F.col(target)).groupBy(*keys, "digits").agg(negatives(0).alias("src_neg"), negatives(1).alias("tgt_neg"))
    found = sums.where("src_neg <> tgt_neg").withColumn("severity", F.when(F.col("src_neg") > F.col("tgt_neg"), "fatal").otherwise("advisory"))
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy(*keys, "severity").orderBy("digits"))
    return found.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


#: Shapes of company names, their legal tails and words without a brand.
NAME_TAILED = r"\b[A-Z][A-Za-z.&'’\-]*(?:\s+(?:[A-Z][A-Za-z.&'’\-]*|of|the|and|&)){0,5}\s+(?:Bank|Company|Corporation|Group|Holdings|Limited|Ltd\.?|Insurance|Securities|Partnership)\b"
NAME_OF = r"\b(?:Bank|Company|Group|Holdings|Insurance|Securities)\s+of\s+[A-Z][A-Za-z.&'’\-]*(?:\s+[A-Z][A-Za-z.&'’\-]*){0,3}\b"
NAME_TAIL = r"(?i)\s*(?:Co\.,?\s*Ltd\.?|Company\s+Limited|Ltd\.?|Limited|Inc\.?|Corporation)\s*$"
CONNECTORS = ["of", "the", "and", "&", "co", "co.", "ltd", "ltd.", "limited", "inc", "inc.", "corporation"]
GENERIC = [*CONNECTORS, "bank", "banking", "company", "group", "holdings", "holding", "insurance", "securities", "partnership", "commercial", "industrial", "parent", "consolidated"]
HEADS = ["bank", "company", "corporation", "group", "insurance", "securities", "partnership", "holdings", "limited"]
SOURCE_NAME = r"[一-鿿]{2,12}(?:银行|公司|集团|保险|证券|信用社)"
SOURCE_GENERIC = r"^(?:股份|有限|责任|集团|商业|村镇|农村|城市|中国|人民|国际|信托|证券|保险|资产|管理|发展|投资|控股)+$"
SOURCE_TABLE_WORD = r"归属|股东|权益|母公司|少数|所有者|每股|收益|附注|合并|期末|期初|减值|拨备|现金|流量|余额|准备金"


def entity_names(text) -> Column:
    """Array of company names in display form: legal tail off, leading connectors off, two words at least."""
    edge = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ ,.;]+|[ ,.;]+$", "")
    both = F.concat(F.regexp_extract_all(text, F.lit(f"({NAME_TAILED})"), F.lit(1)), F.regexp_extract_all(text, F.lit(f"({NAME_OF})"), F.lit(1)))
    lead = r"(?i)^(?:(?:of|the|and|&|co|ltd|limited|inc|corporation)\.* )+(?=\S)"
    names = F.transform(both, lambda n: edge(F.regexp_replace(edge(F.regexp_replace(edge(n), NAME_TAIL, "")), lead, "")))
    return F.filter(names, lambda n: n.contains(" ") & (F.length(n) > 3))


def source_entity_names(text) -> Column:
    """Array of company-shaped Chinese names; generic brands and accounting phrases aren't names."""
    found = F.regexp_extract_all(text, F.lit(f"({SOURCE_NAME})"), F.lit(1))
    brand = lambda n: F.substring(n, F.lit(1), F.length(n) - 2)
    return F.filter(found, lambda n: (F.length(n) >= 4) & ~brand(n).rlike(SOURCE_GENERIC) & ~n.rlike(SOURCE_TABLE_WORD))


def shares_name(text, name) -> Column:
    """A run of at least half the name (four characters or more) occurs in the text."""
    need = F.greatest(F.lit(4), F.floor(F.length(name) / 2).cast("int"))
    starts = F.when(F.length(name) >= need, F.sequence(F.lit(1), F.length(name) - need + 1)).otherwise(F.array().cast("array<int>"))
    return text.contains(name) | F.exists(starts, lambda i: text.contains(F.substring(name, i, need)))


def name_tokens(name) -> Column:
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z&']+)"), F.lit(1))
    return F.array_except(words, F.array(*map(F.lit, CONNECTORS)))


def name_brand(name) -> Column:
    return F.array_except(name_tokens(name), F.array(*map(F.lit, GENERIC)))


def name_head(name) -> Column:
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z&']+)"), F.lit(1))
    heads = F.filter(words, lambda w: w.isin(HEADS))
    return F.when(F.size(heads) > 0, F.element_at(heads, -1))


def entity_inventory(pages: DataFrame, doc: list[str], page: str = "page_no") -> DataFrame:
    """Per document: name, count, first_page, last_page, first_pos (for ties in order of appearance)."""
    names = pages.select(*doc, page, F.posexplode(entity_names(F.col("text"))).alias("pos", "name"))
    return names.groupBy(*doc, "name").agg(F.count(F.lit(1)).alias("n"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.min(F.struct(page, "pos")).alias("first_pos"))


def top_entities(inventory: DataFrame, doc: list[str], most: int = 10) -> DataFrame:
    order = [F.desc("n"), F.asc("first_pos"), F.asc("name")]
    window = Window.partitionBy(*doc).orderBy(*order) if doc else Window.orderBy(*order)
    if not doc:  # the names of all documents don't meet in one task, only the first ones
        inventory = inventory.orderBy(*order).limit(most)
    return inventory.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def entity_anchor(pages: DataFrame, doc: list[str], page: str = "page_no") -> DataFrame:
    """Pages whose source names the document's own company while the target names others of the same kind only.
    pages: source, target. Result: page, own, dominant, foreign (brand words)."""
    named = pages.withColumn("_t", entity_names(F.col("target"))).withColumn("_s", source_entity_names(F.col("source")))
    best = lambda c, n: named.select(*doc, page, F.posexplode(c).alias("pos", "name")).groupBy(*doc, "name").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(page, "pos")).alias("p")).groupBy(*doc).agg(F.min_by("name", F.struct((-F.col("k")).alias("k"), "p")).alias(n))
    out = named.join(best("_t", "dominant"), doc).join(best("_s", "own"), doc)
    dom = name_tokens(F.col("dominant"))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    known = F.exists("_t", lambda n: within(dom, name_tokens(n)) | within(name_tokens(n), dom))
    same_head = F.filter("_t", lambda n: name_head(n).eqNullSafe(name_head(F.col("dominant"))))
    foreign = F.array_sort(F.array_distinct(F.flatten(F.transform(same_head, lambda n: F.array_except(name_brand(n), name_brand(F.col("dominant")))))))
    hit = shares_name(F.col("source"), F.col("own")) & (F.size("_t") > 0) & ~known
    return out.where(hit).select(*doc, page, "own", "dominant", foreign.alias("foreign")).where(F.size("foreign") > 0)


def ngram_terms(blocks: DataFrame, doc: list[str], run: str = r"[一-鿿]{2,}", low: int = 2, high: int = 12, count_to: int = 20, least: int = 2, edge: str = "[的了与及和之等也都就而则且但很更最较又并或若因故即]", numerals: str = "^[零一二三四五六七八九十百千]+$") -> DataFrame:
    """Repeated maximal character n-grams per document: gram, n. A gram goes when a gram longer by one character
    on either side is as frequent as asked; so do numerals and grams with a particle at an edge. Documents are
    moved, not their grams: those of a document are counted in one place."""
    texts = blocks.where(F.col("text").rlike(run)).groupBy(*doc).agg(F.collect_list("text").alias("_texts"))
    runs = F.flatten(F.transform("_texts", lambda t: F.regexp_extract_all(t, F.lit(f"({run})"), F.lit(1))))
    # A null key equals nothing, so that no longer gram is known to be of the same document.
    known = reduce(and_, [F.col(k).isNotNull() for k in doc], F.lit(True))

    def each(runs: pa.Array, known: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
        chars = np.add.reduceat(np.append(pc.utf8_length(runs.flatten()).to_numpy(), 0), np.cumsum(sizes) - sizes) if len(runs) else sizes
        cut = np.flatnonzero(np.diff(np.cumsum(chars) // GRAM_CHARS, prepend=-1))
        bounds = zip(cut, [*cut[1:], len(runs)], strict=True)
        parts = [_repeated_grams(runs.slice(i, j - i), known.slice(i, j - i).to_numpy(zero_copy_only=False), low, high, count_to, least) for i, j in bounds]
        return pa.concat_arrays(parts) if parts else pa.array([], GRAMS)

    found = texts.select(*doc, F.inline(F.arrow_udf(each, "array<struct<gram:string,n:bigint>>")(runs, known)))
    return found.where(~F.col("gram").rlike(numerals) & ~F.col("gram").rlike(f"^{edge}|{edge}$"))


#: Characters of the documents whose grams are numbered together; a longer document is numbered by itself.
GRAM_CHARS = 1 << 20
GRAMS = pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())]))


def _repeated_grams(runs: pa.ListArray, known: np.ndarray, low: int, high: int, count_to: int, least: int) -> pa.ListArray:
    """Per document (a list of runs) the grams of low to high characters that occur `least` times and, where the document is
    known, aren't part of such a gram longer by one. Length by length, grams are numbers for the places where they begin;
    a place stays as long as its gram is frequent, for a frequent gram has frequent parts."""
    flat, sizes = runs.flatten(), pc.list_value_length(runs).to_numpy(zero_copy_only=False)
    text, lengths = "".join(flat.to_pylist()), pc.utf8_length(flat).to_numpy()
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(text))  # characters up to the end of the run
    owner = np.repeat(np.repeat(np.arange(len(runs)), sizes), lengths)
    at, n = np.arange(len(text)), 1
    key = owner << 21 | np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shorter, kept = None, []
    while True:
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
        starts = np.flatnonzero(new)
        counts = np.diff(starts, append=len(key))
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        often = counts >= least
        first, counts = order[starts[often]], counts[often]
        if shorter is not None:  # what begins and what ends in a frequent gram is covered
            places, gram, ways, pairs = shorter
            covered = np.zeros(len(places), bool)
            covered[gram[pairs[first]]] = covered[gram[pairs[first] + 1]] = True
            kept.append((n - 1, *(x[~covered | ~known[owner[places]]] for x in (places, ways))))
        places, stay = at[first], often[number]
        at, gram = at[stay], (np.cumsum(often) - 1)[number[stay]]
        pairs = np.flatnonzero((np.diff(at, append=-1) == 1) & (left[at] > n))
        shorter = (places, gram, counts, pairs) if n >= low else None
        if n == count_to or not len(pairs):
            break
        key = gram[pairs] * len(first) + gram[pairs + 1]
        at, n = at[pairs], n + 1
    if shorter is not None:
        kept.append((n, places, counts))
    kept = [(np.full(len(p), k), p, c) for k, p, c in kept if k <= high]
    size, place, count = (np.concatenate(x) if kept else np.empty(0, np.int64) for x in (zip(*kept, strict=True) if kept else ((),) * 3))
    order = np.argsort(owner[place], kind="stable")
    size, place, count = size[order], place[order], count[order]
    grams = pa.array([text[i : i + k] for i, k in zip(place.tolist(), size.tolist(), strict=True)], pa.string())
    offsets = np.searchsorted(owner[place], np.arange(len(runs) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([grams, pa.array(count, pa.int64())], ["gram", "n"]))


#: Words that are never terms, though headings write them with a capital.
STOPWORDS = """a an the and or but if then than that this these those there here when while whilst as at by for from in into of on onto to with
without within about above after again against all also am among any are because been before being below between both can cannot could did do does
doing done down during each either else few first further had has have having he her his how however is it its just last least less like may me might
more most much must my no nor not now off often once only other our out over own please rather same she should since so some such their them they though
through thus too under until up upon us very was we were what where whether which who whom why will would you your figure figures table tables note notes
data type types full blue red green dashed solid small large late early high low new old next previous left right top bottom""".split()
CJK_STOPWORDS = ["本报告", "本公司", "本公司及", "年度", "单位", "项目", "其中", "合计", "本期", "上年"]


def latin_terms(blocks: DataFrame, doc: list[str], order: str = "block_id", least: int = 2, most: int | None = 80) -> DataFrame:
    """Repeated TitleCase or ALL-CAPS words: term, n, rank in order of first appearance, `most` at most."""
    words = blocks.select(*doc, order, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)(\b[A-Z][a-z]{2,}\b|\b[A-Z]{3,}\b)"), F.lit(1))).alias("pos", "term"))
    found = words.groupBy(*doc, "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos")).alias("first")).where((F.col("n") >= least) & ~F.lower("term").isin(STOPWORDS))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*doc).orderBy("first", "term"))).select(*doc, "term", "n", "rank")
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def page_progress(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Translatable and translated blocks per page. blocks: protected, target."""
    need = ~F.col("protected") & (F.trim("text") != "")
    return blocks.groupBy(*keys).agg(count_if(need).alias("translatable"), count_if(need & (F.trim("target") != "")).alias("translated"))


def numeric_columns(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per column: whether half of its cells are figures and one of them a strong one."""
    n = F.count(F.lit(1))
    numeric = N.is_numeric_cell(F.col("text"))
    return items.groupBy(*keys).agg(n.alias("cells"), count_if(numeric).alias("figures"), F.bool_or(numeric & N.is_strong_figure(F.col("text"))).alias("strong")).withColumn("numeric", (F.col("figures") >= F.greatest(F.lit(1), F.floor(F.col("cells") * 0.5))) & F.col("strong"))


def block_style(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Size (upper median), bold and alignment of a block from its spans. spans also carry the block's box (b_x0,
    b_x1) and the page's text edges (p_x0, p_x1)."""
    per_line = spans.groupBy(*keys, F.bround("y0", 1).alias("_y")).agg(F.min("x0").alias("_l"), F.max("x1").alias("_r"))
    lines = per_line.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max("_r") - F.min("_r")).alias("_dr"), (F.max("_l") - F.min("_l")).alias("_dl"))
    own = spans.groupBy(*keys).agg(upper_median(F.collect_list("size")).alias("size"), F.bool_or("bold").alias("bold"), F.min("x0").alias("_x0"), F.max("x1").alias("_x1"), *[F.first(c).alias("_" + c) for c in ("b_x0", "b_x1", "p_x0", "p_x1")])
    left, right = F.col("_x0") - F.col("_b_x0"), F.col("_b_x1") - F.col("_x1")
    off = F.abs((F.col("_x0") + F.col("_x1")) / 2 - (F.col("_b_x0") + F.col("_b_x1")) / 2)
    centred = (left > 2) & (right > 2) & (off < F.greatest(F.lit(2.0), (F.col("_b_x1") - F.col("_b_x0")) * 0.1))
    single = (F.col("_p_x1") - F.col("_x1") <= 2) & (F.col("_x0") - F.col("_p_x0") > (F.col("_p_x1") - F.col("_p_x0")) / 2)
    align = F.when(centred, "center").when(F.col("_n") >= 2, F.when((F.col("_dr") <= 2) & (F.col("_dl") > 2), "right").otherwise("left")).otherwise(F.when(single, "right").otherwise("left"))
    return own.join(lines, keys).select(*keys, "size", "bold", align.alias("align"), (F.col("_n") <= 1).alias("single_line"))


def rule_coverage(segments: DataFrame, keys: list[str], share: float = 0.8) -> DataFrame:
    """Rules from drawn segments (y, x0, x1; table edges t_x0, t_x1): segments within a point of the first y of
    their group are one rule; their merged length must reach a share of the table, and both ends its edges."""
    # Groups are anchored at their first y.
    def anchors(ys: list[float]) -> list[int]:
        out, at = [], None
        for k, y in enumerate(ys):
            if at is None or y - ys[at] > 1.0:
                at = k
            out.append(at)
        return out

    heights = numbered(segments.select(*keys, "y").distinct(), keys, ["y"], ["y"], "_at", anchors)
    heights = heights.withColumn("anchor", F.min("y").over(Window.partitionBy(*keys, "_at"))).drop("_at")
    anchored = segments.join(heights, [*keys, "y"])
    order = Window.partitionBy(*keys, "anchor").orderBy("x0", "x1")
    far = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = anchored.withColumn("_new", F.coalesce(F.col("x0") > far + 0.5, F.lit(True)).cast("int")).withColumn("_k", F.sum("_new").over(order))
    merged = islands.groupBy(*keys, "anchor", "_k").agg(F.min("x0").alias("a"), F.max("x1").alias("b"), F.first("t_x0").alias("t0"), F.first("t_x1").alias("t1"))
    rules = merged.groupBy(*keys, "anchor").agg(F.sum(F.col("b") - F.col("a")).alias("covered"), F.max_by("a", "_k").alias("lo"), F.max("b").alias("hi"), F.first("t0").alias("t0"), F.first("t1").alias("t1"))
    width = F.col("t1") - F.col("t0")
    full = (F.col("covered") >= share * width) & (F.col("lo") <= F.col("t0") + 0.1 * width) & (F.col("hi") >= F.col("t1") - 0.1 * width)
    return rules.where(full).select(*keys, F.col("anchor").alias("y"), "covered")


def grouping_statistics(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: blocks, text blocks, units, merged units and request estimates for two batch caps. blocks:
    role, unit_no."""
    units = blocks.groupBy(doc, "unit_no").agg(F.count(F.lit(1)).alias("k"), count_if(F.col("role") == "text").alias("t"))
    return units.groupBy(doc).agg(F.sum("k").alias("blocks"), F.sum("t").alias("text_blocks"), F.count(F.lit(1)).alias("units"), count_if(F.col("k") > 1).alias("merged_units"), F.ceil(F.count(F.lit(1)) / 25).alias("requests_25"), F.ceil(F.count(F.lit(1)) / 40).alias("requests_40"))


def judge_mean(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean page score, each within 0 to 100 and a failed one (null) 0."""
    return scores.groupBy(*keys).agg(F.avg(F.when(F.col("score").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score"))))).alias("score"))


def plan_summary(pages: DataFrame, blocks: DataFrame, doc: list[str], each: int = 3, width: int = 60, budget: int = 6000) -> DataFrame:
    """What a model sees of a document when it plans: a line for its size and kinds of pages, then one per page with its kind, blocks
    and the first texts; pages that aren't normal come first. The text is cut at the budget. pages: page_no, kind."""
    clean = X.clean_space(F.col("text"))
    first = blocks.select(*doc, "page_no", "block_id", clean.alias("t"))
    rank = F.row_number().over(Window.partitionBy(*doc, "page_no", F.col("t") == "").orderBy("block_id"))
    own = first.withColumn("_n", rank).groupBy(*doc, "page_no").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when((F.col("t") != "") & (F.col("_n") <= each), F.struct("block_id", F.substring("t", 1, width).alias("t"))))).alias("x"))
    rows = pages.select(*doc, "page_no", "kind").join(own, [*doc, "page_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    texts = F.array_join(F.transform("x", lambda r: r["t"]), " / ")
    line = F.concat(F.lit("page "), (F.col("page_no") + 1).cast("string"), F.lit(" ["), "kind", F.lit("] "), F.col("n").cast("string"), F.lit(" blocks"), F.when(F.size("x") > 0, F.concat(F.lit(": "), texts)).otherwise(""))
    kinds = [F.concat(F.lit(f" {k}="), count_if(F.col("kind") == k).cast("string")) for k in ("normal", "scan", "chart", "uncertain")]
    head = F.concat(F.lit("pages="), F.count(F.lit(1)).cast("string"), F.lit(" blocks="), F.sum("n").cast("string"), *kinds)
    lines = F.array_sort(F.collect_list(F.struct((F.col("kind") == "normal").alias("normal"), "page_no", line.alias("t"))))
    out = rows.groupBy(*doc).agg(F.concat(head, F.lit("\n"), F.array_join(F.transform(lines, lambda r: r["t"]), "\n")).alias("text"))
    return out.select(*doc, F.when(F.length("text") > budget, F.concat(F.substring("text", 1, budget), F.lit("\n…"))).otherwise(F.col("text")).alias("text"))
