"""The checks. A page table of blocks carries the source `text`, the `target` and the block's flags; every check
gives rows (keys, block_id, check, kind, detail), so that checks are united and counted like any rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.operators.aggregates import count_if, entity_anchor, sign_diff
from blockloom.operators.joins import answer_rank, answers, collide, gap_below, glossary_missing, pair_pages

CHECKS = ["layout", "residual", "missing", "numbers", "table"]
FINDING = ["check", "kind", "detail"]
BOX = ["x0", "y0", "x1", "y1"]


def protected(text: Column, keep_original: Column) -> Column:
    """The block must stay as it is: nothing to translate, a figure, or kept on purpose."""
    return ~X.needs_translation(text) | N.is_numeric_cell(text) | keep_original


def measurable(text: Column, is_chart: Column, vertical: Column) -> Column:
    return ~is_chart & ~vertical & X.needs_translation(text) & ~N.is_numeric_cell(text)


def keeps_source(verbatim: Column, role: Column, in_image: Column, released: Column, keep_original: Column) -> Column:
    """Tiers in order: verbatim, formula, released, kept, structural role; text of images isn't structural."""
    return F.when(verbatim, True).when((role == "formula") & ~in_image, True).when(released, False).when(keep_original, True).otherwise(role.isin("formula", "figure") & ~in_image)


def default_keep(on_chart_page: Column, ocr: Column, has_overlay: Column) -> Column:
    """Scanned text on a chart page is kept until a translation is written for it."""
    return on_chart_page & ocr & ~has_overlay


def findings(rows: DataFrame, keys: list[str], check: str, kind: Column, detail: Column) -> DataFrame:
    return rows.select(*keys, "block_id", F.lit(check).alias("check"), kind.alias("kind"), detail.alias("detail"))


def residual(blocks: DataFrame, keys: list[str], cjk_target: bool = False) -> DataFrame:
    """Untranslated content: an empty target, or text left in the source's script."""
    open_ = blocks.where(~F.col("is_chart") & ~protected(F.col("text"), F.col("keep_original")))
    left = F.when(X.is_latin_prose(F.col("target")), "residual_latin") if cjk_target else F.when(X.has_residual_cjk(F.col("target")), "residual_cjk")
    kind = F.when(X.stripped(F.col("target")) == "", "empty").otherwise(left)
    return findings(open_.withColumn("_kind", kind).where("_kind is not null"), keys, "residual", F.col("_kind"), F.col("text"))


def missing(blocks: DataFrame, keys: list[str]) -> DataFrame:
    found = blocks.where(~F.col("is_chart") & ~protected(F.col("text"), F.col("keep_original")) & (X.stripped(F.col("text")) != "") & (X.stripped(F.col("target")) == ""))
    return findings(found, keys, "missing", F.lit("missing"), F.col("text"))


def number_findings(blocks: DataFrame, keys: list[str], extra_figures_only: bool = True, skip_protected: bool = True) -> DataFrame:
    """Values that the target lost (all numbers) or made up (figures only, or all). One row per block and value:
    missing and extra counts."""
    open_ = blocks.where(X.stripped(F.col("target")) != "")
    if skip_protected:
        open_ = open_.where(~protected(F.col("text"), F.col("keep_original")))
    found = N.signature_rows(open_, [*keys, "block_id"], F.col("text"), F.col("target"))
    figure = F.col("figure") if extra_figures_only else F.lit(True)
    less = lambda kept: F.sum(F.when(kept, F.when(F.col("side") == 0, 1).otherwise(-1)).otherwise(0))
    sums = found.groupBy(*keys, "block_id", "value").agg(less(F.lit(True)).alias("all"), less(figure).alias("figures"))
    zero = F.lit(0).cast("long")
    out = sums.select(*keys, "block_id", "value", F.greatest(F.col("all"), zero).alias("missing"), F.greatest(-F.col("figures"), zero).alias("extra"))
    return out.where("missing > 0 or extra > 0")


def numbers(blocks: DataFrame, keys: list[str]) -> DataFrame:
    per = number_findings(blocks, keys).groupBy(*keys, "block_id").agg(F.sum("missing").alias("m"), F.sum("extra").alias("e"))
    return findings(per, keys, "numbers", F.lit("numbers"), F.concat(F.lit("missing "), F.col("m").cast("string"), F.lit(", extra "), F.col("e").cast("string")))


def table_completeness(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and texts per page, how many lack a target, and whether none does."""
    open_ = blocks.where(~F.col("is_chart") & ~protected(F.col("text"), F.col("keep_original")))
    empty, cell = X.stripped(F.col("target")) == "", F.col("in_table")
    sums = open_.groupBy(*keys).agg(count_if(cell).alias("source_cells"), count_if(cell & ~empty).alias("translated_cells"), count_if(cell & empty).alias("empty_cells"), count_if(~cell & empty).alias("empty_text"))
    return sums.withColumn("complete", (F.col("empty_cells") == 0) & (F.col("empty_text") == 0))


def layout_findings(fitted: DataFrame, keys: list[str], rule: str = "audit") -> DataFrame:
    """too_small, overflow and crowding of fitted blocks (fs, floor, height, box and gap to the block below).
    rule "audit": overflow counts only with nothing below; "score": whenever the box is exceeded."""
    box = F.greatest(F.lit(0.5), F.col("y1") - F.col("y0"))
    over = F.col("height") > box + 2
    crowd = F.coalesce(F.col("height") > box + F.col("gap") + 2, F.lit(False))
    spill = over & F.col("gap").isNull() if rule == "audit" else over
    kinds = F.array(F.when(F.col("fs") + 1e-9 < F.col("floor"), "too_small"), F.when(spill, "overflow"), F.when(crowd & over if rule == "audit" else crowd, "crowding"))
    rows = fitted.withColumn("_kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    return findings(rows, keys, "layout", F.col("_kind"), F.format_string("%.2f pt, height %.1f of %.1f", F.col("fs"), F.col("height"), box))


def with_gap(fitted: DataFrame, keys: list[str]) -> DataFrame:
    return gap_below(fitted, keys)


def audit(blocks: DataFrame, keys: list[str], checks: list[str] | str | None = None, cjk_target: bool = False, fitted: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(findings of the asked checks, unknown names). No name means all of them; a bare string is one name; an
    unknown name is a finding itself, so that the audit isn't clean."""
    asked = CHECKS if not checks else [checks] if isinstance(checks, str) else [str(c) for c in checks]
    names = [c.strip().lower() for c in asked]
    unknown = sorted({raw for raw, name in zip(asked, names, strict=True) if name not in CHECKS})
    parts = []
    for name in dict.fromkeys(names):
        if name == "residual":
            parts.append(residual(blocks, keys, cjk_target))
        elif name == "missing":
            parts.append(missing(blocks, keys))
        elif name == "numbers":
            parts.append(numbers(blocks, keys))
        elif name == "table":
            bad = table_completeness(blocks, keys).where("not complete").withColumn("block_id", F.lit(None).cast("int"))
            parts.append(findings(bad, keys, "table", F.lit("incomplete"), F.concat(F.col("empty_cells").cast("string"), F.lit(" cells, "), F.col("empty_text").cast("string"), F.lit(" texts"))))
        elif name == "layout" and fitted is not None:
            parts.append(layout_findings(fitted, keys))
    if unknown:
        row = blocks.sparkSession.range(1).select(*[F.lit(None).cast(blocks.schema[k].dataType).alias(k) for k in keys], F.lit(None).cast("int").alias("block_id"), F.lit("unknown_checks").alias("check"), F.lit("unknown").alias("kind"), F.lit(", ".join(unknown)).alias("detail"))
        parts.append(row)
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, unknown


def audit_summary(found: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per page and check, and clean per page; pages without findings are clean."""
    counts = found.groupBy(*keys).agg(*[count_if(F.col("check") == c).alias(c) for c in CHECKS], F.count(F.lit(1)).alias("issues"))
    out = pages.select(*keys).join(counts, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*CHECKS, "issues"]], (F.coalesce("issues", F.lit(0)) == 0).alias("clean"))


def audit_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per page before and after a fix."""
    side = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    out = side(before, "before").join(side(after, "after"), keys, "full")
    return out.select(*keys, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


# -- document checks -----------------------------------------------------------------------------------------


def numeric_findings(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Amount values that source and target page don't share. Pages without real text in the source, which figures
    can't be held against, are left out; ordinals are made alike before."""
    real = pages.where(~X.is_scan_like(F.col("text")))
    return N.side_diff(N.amount_rows(real, keys, *[N.normalize_ordinals(F.col(c)) for c in ("text", "target")]), keys)


def scanned_signs(pages: DataFrame, keys: list[str], ocr: str = "ocr_text") -> DataFrame:
    """Sign differences of pages that only OCR can read."""
    return sign_diff(pages.where(X.is_scan_like(F.col("text"))), keys, ocr, "target")


def page_residual(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Ideographs left on a page of a Western target, statement codes aside."""
    return pages.withColumn("residual", X.cjk_residual(F.col("target"))).where("residual > 0").select(*keys, "residual")


def section_findings(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages whose heading numbers differ from the source's."""
    s, t = N.section_numbers(F.col("text")), N.section_numbers(F.col("target"))
    rows = pages.where(~X.is_scan_like(F.col("text"))).select(*keys, s.alias("s"), t.alias("t"))
    differs = (F.size("s") > 0) & ~F.col("s.value").eqNullSafe(F.col("t.value"))
    return rows.where(differs).select(*keys, F.col("s.raw").alias("source"), F.col("t.raw").alias("target"))


def style_findings(pages: DataFrame, doc: list[str]) -> DataFrame:
    """Documents whose pages number their headings in more than one style."""
    styled = pages.select(*doc, N.section_style(N.section_numbers(F.col("target"))).alias("style")).where("style <> 'mixed'")
    return styled.groupBy(*doc).agg(F.array_sort(F.collect_set("style")).alias("styles")).where(F.size("styles") > 1)


def page_count_findings(source: DataFrame, target: DataFrame, doc: list[str]) -> DataFrame:
    n = lambda d, c: d.groupBy(*doc).agg(F.count(F.lit(1)).alias(c))
    both = n(source, "source_pages").join(n(target, "target_pages"), doc, "left").withColumn("target_pages", F.coalesce("target_pages", F.lit(0)))
    kind = F.when(F.col("target_pages") < F.col("source_pages"), "fewer").when((F.col("target_pages") > F.col("source_pages")) & (F.col("target_pages") != 2 * F.col("source_pages")), "more")
    return both.withColumn("kind", kind).where("kind is not null")


def paired_texts(source: DataFrame, target: DataFrame, doc: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """Source pages (text) with the texts of their target pages, continuation pages included, as `target`."""
    pairs = pair_pages(source, target, ranges, doc)
    t = target.select(*doc, F.col("page_no").alias("target_page"), F.col("text").alias("_t"))
    texts = pairs.join(t, [*doc, "target_page"]).groupBy(*doc, "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_page", "_t"))), lambda x: x["_t"]), "\n").alias("target"))
    return source.join(texts, [*doc, "page_no"])


DOCUMENT_CHECKS = ["page_count", "numeric", "residual", "sections", "style", "entity", "glossary", "signs"]


def document_check(source: DataFrame, target: DataFrame, doc: list[str], ranges: DataFrame | None = None, glossary: DataFrame | None = None, cjk_target: bool = False) -> DataFrame:
    """All checks of translated documents in one table: doc, page_no (null: of the whole document), check, n. source and
    target: doc, page_no, text; source may have ocr_text, which stands for pages without a text layer. ranges: the page map.
    n counts what is wrong: values, ideographs, headings that differ, styles, foreign words, terms, fatal signs."""
    pages = paired_texts(source, target, doc, ranges)
    keys = [*doc, "page_no"]
    none = F.lit(None).cast(source.schema["page_no"].dataType)
    row = lambda d, check, n: d.select(*doc, (F.col("page_no") if "page_no" in d.columns else none).alias("page_no"), F.lit(check).alias("check"), n.cast("long").alias("n"))
    numeric = numeric_findings(pages, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # What needs a page alone is read in one pass.
    s, t = N.section_numbers(F.col("text")), N.section_numbers(F.col("target"))
    left = F.lit(0) if cjk_target else X.cjk_residual(F.col("target"))
    alone = pages.select(*keys, X.is_scan_like(F.col("text")).alias("scan"), s.alias("s"), t.alias("t"), left.alias("left"))
    differs = ~F.col("scan") & (F.size("s") > 0) & ~F.col("s.value").eqNullSafe(F.col("t.value"))
    made = lambda when, check, n: F.when(when, F.struct(F.lit(check).alias("check"), n.cast("long").alias("n")))
    found = F.filter(F.array(made(F.col("left") > 0, "residual", F.col("left")), made(differs, "sections", F.greatest(F.size("s"), F.size("t")))), lambda x: x.isNotNull())
    single = alone.select(*keys, F.explode(found).alias("f")).select(*keys, "f.check", "f.n")
    parts = [row(page_count_findings(source, target, doc), "page_count", F.abs(F.col("target_pages") - F.col("source_pages"))), row(numeric, "numeric", F.col("n")), single, row(style_findings(pages.where(~X.is_scan_like(F.col("text"))), doc), "style", F.size("styles"))]
    whole = pages.withColumn("source", F.concat_ws("\n", "text", "ocr_text")) if "ocr_text" in source.columns else pages.withColumn("source", F.col("text"))
    parts.append(row(entity_anchor(whole, doc), "entity", F.size("foreign")))
    if "ocr_text" in source.columns:
        signs = scanned_signs(pages, keys).where("severity = 'fatal'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        parts.append(row(signs, "signs", F.col("n")))
    if glossary is not None:
        joined = pages.groupBy(*doc).agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.col(c).alias("t")))), lambda x: x["t"]), "\n").alias(c) for c in ("text", "target")])
        terms = glossary_missing(joined, glossary, doc[0]).groupBy(doc[0]).agg(F.count(F.lit(1)).alias("n"))
        parts.append(row(terms, "glossary", F.col("n")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def extra_pages(target: DataFrame, pairs: DataFrame, doc: list[str]) -> DataFrame:
    """Target pages that no source page is paired with."""
    visited = pairs.select(*doc, F.col("target_page").alias("page_no")).distinct()
    return target.select(*doc, "page_no").distinct().join(visited, [*doc, "page_no"], "left_anti")


def page_size_findings(source: DataFrame, target: DataFrame, pairs: DataFrame, doc: list[str], most: float = 1.0) -> DataFrame:
    """Pairs of pages whose width or height differ by more than a point."""
    s = source.select(*doc, "page_no", F.col("width").alias("_w"), F.col("height").alias("_h"))
    t = target.select(*doc, F.col("page_no").alias("target_page"), "width", "height")
    both = pairs.join(s, [*doc, "page_no"]).join(t, [*doc, "target_page"])
    return both.where(resizes({"width": F.col("_w"), "height": F.col("_h")}, {c: F.col(c) for c in ("width", "height")}, most)).select(*doc, "page_no", "target_page")


def resizes(s, t, most: float = 1.0) -> Column:
    return (F.abs(t["width"] - s["width"]) > most) | (F.abs(t["height"] - s["height"]) > most)


def layout_check(source: DataFrame, target: DataFrame, spans: DataFrame, blocks: DataFrame, rules: DataFrame, doc: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """All layout checks of translated documents in one table: doc, page_no (of the target), check, item (span, block or
    target page). source, target: pages with width and height; spans: drawn spans of target pages (span_no, box,
    size, page_x0, page_x1, page_y1, source_ink); blocks: source blocks (block_id, text, box, floor); rules: printed rules of
    target pages. Blocks of pages that continue on further ones aren't looked for."""
    # All that a target page needs comes to it once and is checked there: a join for each check would read the pages anew.
    keys = [*doc, "page_no"]
    pairs = pair_pages(source, target, ranges, doc).withColumn("single", F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1)
    texts = blocks.where(F.trim("text") != "").groupBy(*keys).agg(F.collect_list(F.struct("block_id", *BOX, "floor")).alias("blocks"))
    paired = pairs.join(source.select(*keys, "width", "height"), keys).join(texts, keys, "left").select(*doc, F.col("target_page").alias("page_no"), F.struct("single", "width", "height").alias("pair"), "blocks")
    parts = [spans.select(*keys, F.struct("span_no", *BOX, "size", "page_x0", "page_x1", "page_y1", "source_ink").alias("span")), rules.select(*keys, F.struct("y", "x0", "x1").alias("rule")), target.select(*keys, F.struct("width", "height").alias("size"))]
    rows = paired
    for more in parts:
        rows = rows.unionByName(more, allowMissingColumns=True)
    lists = [F.collect_list(c).alias(c) for c in ("span", "rule", "size", "pair")]
    pages = rows.groupBy(*keys).agg(*lists, F.flatten(F.collect_list("blocks")).alias("block"))
    box = lambda r: tuple(r[c] for c in BOX)

    def credit(s: Column) -> Column:
        rank = lambda b: F.struct(*[c.alias(n) for c, n in zip(answer_rank(box(s), box(b), b["block_id"]), "abc", strict=True)], b["floor"].alias("floor"))
        best = F.array_min(F.transform(F.filter("block", lambda b: answers(box(s), box(b))), rank))
        return F.struct(s["span_no"].alias("span_no"), s["size"].alias("size"), best["c"].alias("block_id"), best["floor"].alias("floor"))

    pages = pages.withColumn("credited", F.transform("span", credit))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])  # a null key equals none
    numbers = lambda rows: F.transform(rows, lambda r: r["span_no"])
    overlap = F.flatten(F.transform("span", lambda a: F.transform(F.filter("span", lambda b: (a["span_no"] < b["span_no"]) & collide(box(a), box(b)) & known), lambda b: a["span_no"])))
    crossed = F.filter("span", lambda s: F.exists("rule", lambda r: crosses(s, r)) & known)
    answered = F.transform("credited", lambda c: c["block_id"])
    open_ = F.filter("block", lambda b: ~F.coalesce(F.array_contains(answered, b["block_id"]), F.lit(False)) & F.exists("pair", lambda p: p["single"]))
    resized = F.flatten(F.transform("size", lambda t: F.filter("pair", lambda p: resizes(p, t))))
    found = {
        "overlap": overlap, "off_page": numbers(F.filter("span", lambda s: leaves_page(s))), "rule": F.array_distinct(numbers(crossed)), "small": numbers(F.filter("credited", lambda c: is_small(c["size"], c["floor"]))),
        "missing": F.transform(open_, lambda b: b["block_id"]), "page_size": F.transform(resized, lambda p: F.col("page_no")), "extra_page": F.when((F.size("size") > 0) & (F.size("pair") == 0), F.array("page_no")).otherwise(F.array().cast("array<int>")),
    }
    named = lambda check, rows: F.transform(rows, lambda i: F.struct(F.lit(check).alias("check"), i.cast("long").alias("item")))
    return pages.select(*keys, F.inline(F.concat(*[named(check, rows) for check, rows in found.items()])))


def leaves_page(s, margin: float = 1.0) -> Column:
    return (s["x0"] < s["page_x0"] - margin) | (s["x1"] > s["page_x1"] + margin) | (s["y1"] > s["page_y1"] + margin)


def off_page(spans: DataFrame, keys: list[str], margin: float = 1.0) -> DataFrame:
    """Spans beyond the left, right or bottom edge of their page (page_x0, page_x1, page_y1)."""
    return spans.where(leaves_page({c: F.col(c) for c in (*BOX, "page_x0", "page_x1", "page_y1")}, margin)).select(*keys, "span_no")


def crosses(s, r, inset: float = 0.2) -> Column:
    pad = (s["y1"] - s["y0"]) * inset
    hit = (s["y1"] - s["y0"] - 2 * pad >= 1) & r["y"].between(s["y0"] + pad, s["y1"] - pad) & (r["x0"] < s["x1"]) & (r["x1"] > s["x0"])
    return hit & ((r["x0"] < s["x0"]) | (r["x1"] > s["x1"])) & ~F.coalesce(s["source_ink"], F.lit(False))


def rule_crossings(spans: DataFrame, rules: DataFrame, keys: list[str], inset: float = 0.2) -> DataFrame:
    """Spans with a printed rule (y, x0, x1) through the inner part of their band that reaches beyond the span on
    either side, where the source had no text of its own under the rule (source_ink)."""
    r = rules.select(*keys, F.struct("y", "x0", "x1").alias("_rule"))
    both = spans.join(r, keys)
    return both.where(crosses({c: F.col(c) for c in (*BOX, "source_ink")}, F.col("_rule"), inset)).select(*keys, "span_no").distinct()


def is_small(size: Column, floor: Column, universal: float = 3.0) -> Column:
    return size < F.coalesce(floor, F.lit(universal)) - 0.01


def too_small_spans(spans: DataFrame, credited: DataFrame, floors: DataFrame, keys: list[str], universal: float = 3.0) -> DataFrame:
    """Spans below the floor of the block that they belong to; without a block, below the universal floor."""
    out = spans.join(credited.select(*keys, "span_no", "block_id"), [*keys, "span_no"], "left").join(floors.select(*keys, "block_id", "floor"), [*keys, "block_id"], "left")
    return out.where(is_small(F.col("size"), F.col("floor"), universal)).select(*keys, "span_no", "block_id", "size")


def verdict(n_fatal: int, n_advisory: int, strict: bool = False, usable: bool = True) -> int:
    """Exit code: 2 where nothing could be checked, 1 with findings that count, else 0."""
    return 2 if not usable else int(n_fatal > 0 or (strict and n_advisory > 0))


def capped(found: DataFrame, keys: list[str], most: int, order: list[str]) -> DataFrame:
    """The first `most` findings per key, as reports show them."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
