"""Joins of the data model. Every spatial join has its page as equi key, so that it is a hash or sort-merge
join with a residual condition and never a nested loop over the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import geometry as G
from blockloom.functions.numbers import is_numeric_cell
from blockloom.functions.text import clean_space, needs_translation


def with_translation(blocks: DataFrame, translations: DataFrame, keys: list[str], name: str = "target") -> DataFrame:
    """Every block with its translation, "" where there is none."""
    return blocks.join(translations.select(*keys, F.col("text").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit("")))


def latest_overlay(overlay: DataFrame, keys: list[str]) -> DataFrame:
    """The last version per key of an append-only log; deleted ones are gone."""
    last = overlay.groupBy(*keys).agg(F.max_by(F.struct("action", "text"), F.col("version")).alias("last"))
    return last.where("last.action <> 'delete'").select(*keys, F.col("last.text").alias("text"))


def overlay_wins(translated: DataFrame, overlay: DataFrame, keys: list[str], name: str = "target") -> DataFrame:
    """Overlay texts replace translations; blank ones don't."""
    over = overlay.select(*keys, F.col("text").alias("_over"))
    return translated.join(over, keys, "left").withColumn(name, F.when(F.trim("_over") != "", F.col("_over")).otherwise(F.col(name))).drop("_over")


def cache_todo(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts (block_hash, text) that the cache lacks: one request per text."""
    return blocks.select("block_hash", "text").join(cache.select("block_hash"), "block_hash", "left_anti").dropDuplicates(["block_hash"])


def cache_fill(blocks: DataFrame, cache: DataFrame, keep: Column | None = None) -> DataFrame:
    """Blocks with `target` from the cache, else their own text; kept blocks keep their text."""
    hit = cache.select("block_hash", F.col("text").alias("_hit"))
    use = F.col("_hit").isNotNull() if keep is None else F.col("_hit").isNotNull() & ~keep
    return blocks.join(hit, "block_hash", "left").withColumn("target", F.when(use, F.col("_hit")).otherwise(F.col("text"))).drop("_hit")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def claim_regions(blocks: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Each block with the first region (by region_no) that takes it: named in the region's block_ids where
    it has any, else by the block's centre. Figure and formula regions leave blocks with in_image."""
    r = regions.select(*keys, "region_no", "kind", "level", F.col("block_ids").alias("_ids"), *[F.col(c).alias("r_" + c) for c in ("x0", "y0", "x1", "y1")])
    named = F.size(F.coalesce("_ids", F.array().cast("array<int>"))) > 0
    inside = F.when(named, F.array_contains("_ids", F.col("block_id"))).otherwise(G.centre_in(G.box(), G.box("r_")))
    kept_out = F.col("kind").isin("figure", "formula") & F.col("in_image") if "in_image" in blocks.columns else F.lit(False)
    found = blocks.join(r, keys).where(inside & ~kept_out)
    return first_of(found, [*keys, "block_id"], ["region_no"]).select(*keys, "block_id", "region_no", "kind", "level")


def block_roles(blocks: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with role and level; text without a region."""
    got = claimed.select(*keys, "block_id", F.col("kind").alias("role"), "level")
    return blocks.join(got, [*keys, "block_id"], "left").withColumn("role", F.coalesce("role", F.lit("text"))).withColumn("level", F.coalesce("level", F.lit(0)))


def assign_cells(items: DataFrame, cells: DataFrame, keys: list[str], least_width: float = 6.0) -> DataFrame:
    """Each item with the first cell (by cell_no) that holds its centre; cells below least_width don't."""
    c = cells.where(F.col("x1") - F.col("x0") >= least_width).select(*keys, "cell_no", "row", "col", *[F.col(x).alias("c_" + x) for x in ("x0", "y0", "x1", "y1")])
    found = items.join(c, keys).where(G.centre_in(G.box(), G.box("c_")))
    return first_of(found, [*keys, "item_no"], ["cell_no"]).select(*keys, "item_no", "cell_no", "row", "col")


def assign_cells_or_rows(items: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The exact cell, or else the first row band that holds the item's vertical centre (column null)."""
    exact = assign_cells(items, cells, keys).select(*keys, "item_no", F.col("row").alias("e_row"), F.col("col").alias("e_col"))
    bands = cells.groupBy(*keys, "row").agg(F.min("y0").alias("b0"), F.max("y1").alias("b1"))
    loose = items.join(bands, keys).where(G.centre(G.box())[1].between(F.col("b0"), F.col("b1"))).groupBy(*keys, "item_no").agg(F.min("row").alias("l_row"))
    out = items.join(exact, [*keys, "item_no"], "left").join(loose, [*keys, "item_no"], "left")
    return out.select(*keys, "item_no", F.coalesce("e_row", "l_row").alias("row"), F.col("e_col").alias("col"))


def new_ocr_blocks(ocr: DataFrame, text: DataFrame, keys: list[str]) -> DataFrame:
    """OCR blocks that aren't the text layer read again: the same (or contained) text with half of the box
    covered, or equal text that covers the text block."""
    t = text.select(*[F.col(k).alias("t_" + k) for k in keys], F.lower(clean_space(F.col("text"))).alias("t_text"), *[F.col(x).alias("t_" + x) for x in ("x0", "y0", "x1", "y1")])
    o = ocr.withColumn("_norm", F.lower(clean_space(F.col("text")))).where("_norm <> ''")
    same = F.col("_norm").contains(F.col("t_text")) | F.col("t_text").contains(F.col("_norm"))
    covered = G.covered_ratio(G.box(), G.box("t_")) >= 0.5
    fills = (F.col("_norm") == F.col("t_text")) & (G.covered_ratio(G.box("t_"), G.box()) >= 0.9)
    on = [F.col(k) == F.col("t_" + k) for k in keys]
    return o.join(t, [*on, F.col("t_text") != "", same, covered | fills], "left_anti").drop("_norm")


def merged_blocks(text: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of the text layer and the OCR blocks that aren't a second reading of them, numbered anew in reading order (read_no). Both:
    item_no, text, box."""
    from blockloom.operators.sequence import with_reading_order

    both = text.withColumn("ocr", F.lit(False)).unionByName(new_ocr_blocks(ocr, text, keys).withColumn("ocr", F.lit(True)))
    order = Window.partitionBy(*keys).orderBy("ocr", "item_no")
    return with_reading_order(both.withColumn("line_no", F.row_number().over(order)), keys).drop("line_no")


def colliding_spans(spans: DataFrame, keys: list[str], share: float = 0.25) -> DataFrame:
    """Pairs of spans (a before b) that overlap by at least a share of the smaller one."""
    side = lambda p: spans.select(*keys, F.col("span_no").alias(p + "no"), *[F.col(x).alias(p + x) for x in ("x0", "y0", "x1", "y1")])
    a, b = G.box("a_"), G.box("b_")
    both = side("a_").join(side("b_"), keys).where("a_no < b_no").where(collide(a, b, share))
    return both.select(*keys, "a_no", "b_no", shared_part(a, b).alias("share"))


def shared_part(a, b) -> Column:
    """The overlap of two boxes as a share of the smaller one."""
    w, h = G.overlap_size(a, b)
    small = F.least(G.area(a), G.area(b))
    return F.when(small > 0, w * h / small)


def collide(a, b, share: float = 0.25) -> Column:
    w, h = G.overlap_size(a, b)
    return (w > 0) & (h > 0) & (shared_part(a, b) >= share)


def credited_blocks(spans: DataFrame, blocks: DataFrame, keys: list[str], cover: float = 0.30, slack: float = 12.0) -> DataFrame:
    """Each span with the one block it answers for: a block that holds 30 % of the span, or that the span
    is near to in the same column; of those the one around its centre, else the nearest, else the first."""
    b = blocks.where(F.trim("text") != "").select(*keys, "block_id", *[F.col(x).alias("k_" + x) for x in ("x0", "y0", "x1", "y1")])
    s, k = G.box(), G.box("k_")
    found = spans.join(b, keys).where(answers(s, k, cover, slack))
    rank = F.struct(*[c.alias(n) for c, n in zip(answer_rank(s, k, F.col("block_id")), "abc", strict=True)])
    return found.groupBy(*keys, "span_no").agg(F.min_by("block_id", rank).alias("block_id"))


def answers(s, k, cover: float = 0.30, slack: float = 12.0) -> Column:
    """Whether a span may answer for a block."""
    w, h = G.overlap_size(s, k)
    reach = (k[3] - k[1]) / 2 + slack
    nw, nh = G.overlap_size(s, (k[0] - 2, k[1] - reach, k[2] + 2, k[3] + reach))
    covers = ((w > 0) & (h > 0) & (w * h >= cover * G.area(s))) | ((nw >= 0.5 * (s[2] - s[0])) & (nh >= 0.5 * (s[3] - s[1])))
    # Told from the columns alone, before anything is computed: an upright span meets the widened block.
    near = (s[2] < s[0]) | ((s[0] < k[2] + 2) & (s[2] > k[0] - 2))
    return near & (k[2] > k[0]) & (k[3] > k[1]) & (G.area(s) > 0) & covers


def answer_rank(s, k, block_id: Column) -> list[Column]:
    return [F.when(G.centre_in(s, k), 0).otherwise(1), G.band_distance(k, s), block_id]


def missing_blocks(blocks: DataFrame, credited: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with text that no span answers for."""
    return blocks.where(F.trim("text") != "").join(credited.select(*keys, "block_id").distinct(), [*keys, "block_id"], "left_anti")


def gap_below(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Each block with the gap to the nearest block below it in its column (null: none)."""
    n = blocks.select(*keys, F.col("block_id").alias("n_id"), *[F.col(x).alias("n_" + x) for x in ("x0", "y0", "x1")])
    below = (F.col("n_id") != F.col("block_id")) & (F.col("n_y0") >= F.col("y1") - 0.5) & (F.col("n_x0") < F.col("x1")) & (F.col("n_x1") > F.col("x0"))
    nearest = blocks.join(n, keys).where(below).groupBy(*keys, "block_id").agg(F.min_by("n_id", F.struct("n_y0", "n_id")).alias("below_id"), F.min("n_y0").alias("_y"))
    return blocks.join(nearest, [*keys, "block_id"], "left").select(*blocks.columns, "below_id", (F.col("_y") - F.col("y1")).alias("gap"))


def nearest_block(points: DataFrame, blocks: DataFrame, keys: list[str], tolerance: float = 6.0) -> DataFrame:
    """Each annotation box (point_no) with its nearest block within a tolerance."""
    b = blocks.select(*keys, "block_id", *[F.col(x).alias("k_" + x) for x in ("x0", "y0", "x1", "y1")])
    found = points.join(b, keys).withColumn("_d", G.gap_distance(G.box("k_"), G.box())).where(F.col("_d") <= tolerance)
    return found.groupBy(*keys, "point_no").agg(F.min_by("block_id", F.struct("_d", "block_id")).alias("block_id"))


def free_bands(figures: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each figure line (line_no) with the distance to the next line below in its column and to the next
    one on its right in its row."""
    n = lines.select(*keys, F.col("line_no").alias("n_no"), *[F.col(x).alias("n_" + x) for x in ("x0", "y0", "x1", "y1")])
    pairs = figures.join(n, keys).where("n_no <> line_no")
    under = (F.col("n_y0") >= F.col("y1")) & (F.col("n_x0") < F.col("x1")) & (F.col("n_x1") > F.col("x0"))
    right = (F.col("n_x0") >= F.col("x1")) & (F.col("n_y0") < F.col("y1")) & (F.col("n_y1") > F.col("y0"))
    gaps = pairs.groupBy(*keys, "line_no").agg(F.min(F.when(under, F.col("n_y0") - F.col("y1"))).alias("below"), F.min(F.when(right, F.col("n_x0") - F.col("x1"))).alias("beside"))
    return figures.join(gaps, [*keys, "line_no"], "left")


def page_ranges(page_map: DataFrame, doc: list[str], total: str = "target_pages") -> DataFrame:
    """(source_page, target_page) from each source page's first output page: up to the next one's first
    page, or to the last page of the document."""
    until = F.lead("first_page").over(Window.partitionBy(*doc).orderBy("source_page"))
    spans = page_map.withColumn("_until", F.coalesce(until, F.col(total))).where(F.col("_until") > F.col("first_page"))
    rows = spans.select(*doc, "source_page", F.explode(F.sequence(F.col("first_page"), F.col("_until") - 1)).alias("target_page"), total)
    return rows.where((F.col("target_page") >= 0) & (F.col("target_page") < F.col(total))).drop(total)


def pair_pages(source: DataFrame, target: DataFrame, ranges: DataFrame | None, doc: list[str]) -> DataFrame:
    """Source pages with their target pages: by the page map of documents that have one; else target page
    2i+1 where there are exactly twice as many pages; else the same number."""
    counts = source.groupBy(*doc).agg(F.count(F.lit(1)).alias("ns")).join(target.groupBy(*doc).agg(F.count(F.lit(1)).alias("nt")), doc)
    s = source.select(*doc, "page_no").join(counts, doc)
    plain = s.withColumn("target_page", F.when(F.col("nt") == 2 * F.col("ns"), F.col("page_no") * 2 + 1).otherwise(F.col("page_no"))).where("target_page < nt")
    if ranges is None:
        return plain.select(*doc, "page_no", "target_page")
    mapped = s.join(ranges.withColumnRenamed("source_page", "page_no"), [*doc, "page_no"]).where("target_page < nt")
    rest = plain.join(ranges.select(*doc).distinct(), doc, "left_anti")
    return mapped.select(*doc, "page_no", "target_page").unionByName(rest.select(*doc, "page_no", "target_page"))


#: Characters of a glossary (terms and targets) up to which it goes to every task; length of the grams it is joined by beyond.
GLOSSARY, GRAM = 8_000_000, 12


def glossary_missing(documents: DataFrame, glossary: DataFrame, doc: str = "doc_id", most: int = GLOSSARY) -> DataFrame:
    """Glossary entries whose source occurs in a document while the required target doesn't. A glossary of up to
    `most` characters is searched for in one pass over each text; a larger one meets the texts in a join on the first GRAM
    characters of its terms (or on all of a shorter term)."""
    g = glossary.where("source <> '' and target <> ''").select(F.col("source").alias("term"), F.col("target").alias("required")).distinct()
    lacks = ~F.col("target").contains(F.col("required"))
    if (g.agg(F.sum(F.length("term") + F.length("required"))).first()[0] or 0) <= most:
        found = _found_terms(documents.select(doc, "text", "target"), doc, sorted({r.term for r in g.select("term").distinct().collect()}))
        return found.join(g, "term").where(lacks).select(doc, "term", "required")
    g = g.withColumn("gram", F.substring("term", 1, GRAM))
    sizes = [r.n for r in g.select(F.length("gram").alias("n")).distinct().collect()]  # at most GRAM
    grams = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring("text", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    cut = documents.select(doc, "text", "target", F.explode(F.array_distinct(F.concat(*[grams(n) for n in sizes]))).alias("gram"))
    return cut.join(g, "gram").where(F.col("text").contains(F.col("term")) & lacks).select(doc, "term", "required")


def _found_terms(documents: DataFrame, doc: str, terms: list[str]) -> DataFrame:
    """(doc, target, term) for the terms that occur in text, by one automaton of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            found.add_word(t, k)
        found.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = sorted({k for _, k in found.iter(text)}) if text and terms else []
                rows += [i] * len(own)
                hits += [terms[k] for k in own]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(hits, pa.string())], [doc, "target", "term"])

    kind = documents.schema[doc].dataType.simpleString()
    return documents.mapInArrow(run, f"`{doc}` {kind}, target string, term string")


def neighbour_context(blocks: DataFrame, doc: str = "doc_id", width: int = 80, budget: int = 1200) -> DataFrame:
    """Lines of context for blocks (block_id, batch_id, page_no, text) whose neighbour lies outside of
    their batch on the same page and has letters; per batch, the lines up to the first that exceeds the
    budget."""
    order = Window.partitionBy(doc).orderBy("block_id")
    local = F.row_number().over(Window.partitionBy(doc, "batch_id").orderBy("block_id"))
    rows = blocks.withColumn("_no", local)
    sides = []
    for side, name, step in ((0, "before", F.lag), (1, "after", F.lead)):
        near = step(F.struct("text", "batch_id", "page_no"), 1).over(order)
        sides.append(F.struct(F.lit(side).alias("side"), F.lit(name).alias("name"), near.alias("near")))
    each = rows.withColumn("_sides", F.array(*sides)).select(doc, "batch_id", "block_id", "page_no", "_no", F.explode("_sides").alias("s"))
    each = each.where((F.col("s.near.batch_id") != F.col("batch_id")) & (F.col("s.near.page_no") == F.col("page_no")) & F.col("s.near.text").rlike(r"\p{L}"))
    flat = clean_space(F.col("s.near.text"))
    snip = F.when(F.col("s.side") == 0, F.substring(flat, F.greatest(F.length(flat) - width + 1, F.lit(1)), F.lit(width))).otherwise(F.substring(flat, 1, width))
    line = F.concat(F.lit("#"), F.col("_no").cast("string"), F.lit(" "), F.col("s.name"), F.lit(": "), snip)
    lines = each.select(doc, "batch_id", "block_id", F.col("s.side").alias("side"), line.alias("line"))
    used = F.sum(F.length("line")).over(Window.partitionBy(doc, "batch_id").orderBy("block_id", "side").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")


def apply_decisions(blocks: DataFrame, decisions: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(blocks with keep_original and released, decisions that name no block)."""
    d = decisions.select(doc, "block_id", F.col("action").alias("_action"))
    out = blocks.join(d, [doc, "block_id"], "left")
    out = out.withColumn("keep_original", F.col("keep_original") | F.coalesce(F.col("_action") == "keep", F.lit(False))).withColumn("released", F.coalesce(F.col("_action") == "translate", F.lit(False))).drop("_action")
    return out, decisions.join(blocks.select(doc, "block_id"), [doc, "block_id"], "left_anti")


def pick_translatable(asked: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks asked for (doc, pos, block_id) that may be translated again: each once, in the order first asked; they exist, have something to
    translate and are no figure. Result: doc, block_id, rank from 0."""
    first = asked.groupBy(doc, "block_id").agg(F.min("pos").alias("pos"))
    real = blocks.where(needs_translation(F.col("text")) & ~is_numeric_cell(F.col("text"))).select(doc, "block_id")
    kept = first.join(real, [doc, "block_id"], "left_semi")
    return kept.select(doc, "block_id", (F.row_number().over(Window.partitionBy(doc).orderBy("pos", "block_id")) - 1).alias("rank"))


def policy_candidates(blocks: DataFrame, doc: str = "doc_id", per_page: int = 6, most: int = 120) -> DataFrame:
    """Blocks on offer to a policy, in document order: the first `per_page` of a page and `most` of a document. blocks: page_no,
    block_id, text, role, ocr, in_table. Figures' texts and scanned blocks outside of tables are in doubt; formulas and figures (numbers) never are."""
    doubt = ((F.col("role") == "figure") | (F.col("ocr") & ~F.col("in_table"))) & (F.col("role") != "formula")
    open_ = blocks.where(doubt & needs_translation(F.col("text")) & ~is_numeric_cell(F.col("text")))
    page = F.row_number().over(Window.partitionBy(doc, "page_no").orderBy("block_id"))
    few = open_.withColumn("page_rank", page).where(F.col("page_rank") <= per_page)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("block_id"))).where(F.col("rank") <= most).drop("page_rank")


def in_scope(blocks: DataFrame, scope: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(blocks, those outside of the scope with keep_original and not released; scope rows (doc, page_no) that name no page of
    their document, which are a mismatch and no success)."""
    own = scope.select(doc, "page_no").distinct().withColumn("_in", F.lit(True))
    out = blocks.join(own, [doc, "page_no"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    kept = out.withColumn("keep_original", F.col("keep_original") | ~F.col("_in")).withColumn("released", F.col("released") & F.col("_in")).drop("_in")
    return kept, own.drop("_in").join(blocks.select(doc, "page_no").distinct(), [doc, "page_no"], "left_anti")


def on_page(asked: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows asked for (doc, page_no, block_id) whose block is on that page; the others, with the page that the block is on, or null)."""
    at = blocks.select(doc, "block_id", F.col("page_no").alias("actual_page"))
    both = asked.join(at, [doc, "block_id"], "left").withColumn("_ok", F.coalesce(F.col("page_no") == F.col("actual_page"), F.lit(False)))
    return both.where("_ok").drop("_ok", "actual_page"), both.where(~F.col("_ok")).drop("_ok")
