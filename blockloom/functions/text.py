"""Predicates and scalar functions over block text, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values from here to ENTRY_STARTS: character ranges and patterns that decide what a text is.
CJK = "一-鿿"
#: Marks of a math expression, and marks that may follow a figure as its unit.
MATH_MARKS = "=+−×÷±∑∏∫√∞≈≠≤≥≡→←↑↓^_/()|-"
UNIT_MARKS = "元圆角分万亿年月日号个"
FULLWIDTH, ASCII = "０１２３４５６７８９，．％－＋", "0123456789,.%-+"
BULLETS = "•▪●■◆◇✦✧❖❤➡→←▸▶»‣⁃∙·❚◘○"
#: Names and codes of languages written in CJK script.
CJK_LANGUAGE_NAMES = ["simplified chinese", "traditional chinese", "chinese", "japanese", "korean", "zh", "ja", "ko", "中文", "简体中文", "繁体中文", "日本語", "한국어", "漢語"]
CJK_TARGET_NAMES = ["chinese", "中文", "汉语", "普通话", "简体", "繁体", "japanese", "日语", "korean", "韩语", "한국어", "日本語"]
CJK_TARGET_CODES = ["zh", "cn", "zho", "chi", "zhcn", "zhhans", "zhtw", "zhhant", "ja", "jp", "jpn", "ko", "kor"]

NOTE_MARK = r"^\s*[（(]?\s*[一二三四五六七八九十0-9]{1,3}\s*[)）]\s*$"
NUMERIC_CELL = r"^\s*[（(－\-−]?\s*(?:\d{1,3}(?:\s*[，,]\s*\d{3})+(?:\s*[.．]\s*\d+)?|\d+(?:\s*[.．]\s*\d+)?)\s*[%％]?\s*[）)]?\s*$"
STRONG_FIGURE = r"\d[\d\s]*[.,，．%％]|\d{4,}"
NUMBER_ATOM = r"^[+-]?[0-9][0-9,.\s/%]*[%％]?$"
AMOUNT_ATOM = r"^[^\d]{0,4}\d[\d,./\-]*[^\d]{0,4}$"
ENTRY_STARTS = [
    r"^[" + BULLETS + r"]",
    r"^(?:\*|-|–|—)\s+",
    r"^\d{1,3}[.)]",
    r"^(?:[（(]\s*[一二三四五六七八九十百零〇0-9]{1,4}\s*[）)]|[①-⑳]|[一二三四五六七八九十百零〇0-9]{1,3}[、．])",
    r"^[A-Za-z一-鿿][^:\n]{0,40}:(?:\s|$)",
    r"^[A-Za-z一-鿿][^:\n：]{0,14}：",
]


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def fold_width(c: Column) -> Column:
    """Full-width digits and separators, and typographic minus signs, as ASCII."""
    return F.translate(c, FULLWIDTH + "−–—", ASCII + "---")


def count_of(c: Column, char_class: str) -> Column:
    """How many characters of a regex class c holds."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{char_class}]", ""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Control characters become spaces, runs of white space one space."""
    return stripped(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", " "), r"(?U)\s+", " "))


def is_formula(c: Column) -> Column:
    """A short, mark-dense math expression with a relation, function, root or power, without CJK."""
    t = stripped(c)
    marks = count_of(t, r"=+−×÷±∑∏∫√∞≈≠≤≥≡→←↑↓\^_/()|\-")
    relation, power = t.rlike("[=≈≤≥≡]"), t.rlike(r"[∑∫√π]|[\^_]|exp\(|log\(|/\s*[a-zA-Z]")
    expression = t.rlike(r"[=≈≤≥≡]|[∑∫√π]|[\^_]|exp\(|log\(|\bln\b|\bsin\b|\bcos\b|\btan\b")
    dense = marks / F.greatest(F.lit(1), F.length(t)) >= 0.12
    body = F.when(~relation, power & (marks >= 3) & dense).when(~power & (marks < 3), False).otherwise(expression & dense)
    return F.coalesce((t != "") & ~t.rlike(f"[{CJK}]") & (F.length(t) <= 70) & (marks >= 2) & body, F.lit(False))


def needs_translation(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False)) & ~is_formula(c)


def is_pure_symbol(c: Column) -> Column:
    return ~F.coalesce(c.rlike(f"[A-Za-z0-9{CJK}]"), F.lit(False))


def is_entry(c: Column) -> Column:
    """The text begins a list or table entry: a bullet, dash, number, ordinal or label."""
    t = stripped(c)
    return F.coalesce((t != "") & any_of(*[t.rlike(p) for p in ENTRY_STARTS]), F.lit(False))


def is_number_atom(c: Column) -> Column:
    return c.rlike(NUMBER_ATOM)


def is_amount_atom(c: Column) -> Column:
    return c.rlike(AMOUNT_ATOM)


def is_page_furniture(text: Column, ocr: Column, is_chart: Column) -> Column:
    t = clean_text(text)
    return ~ocr & ~is_chart & (t != "") & (F.length(t) <= 12) & ~t.rlike(r"\p{L}")


def is_vertical_label(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, single_line: Column, in_table: Column) -> Column:
    w, h = x1 - x0, y1 - y0
    return ~in_table & single_line & ~text.contains("\n") & (h >= 2 * w) & (w <= 30) & (h >= 22)


def language_of(cjk: Column, latin: Column) -> Column:
    """From the number of CJK and of ASCII letters of a document."""
    return F.when((cjk == 0) & (latin == 0), "unknown").when(cjk >= latin, "zh").when(latin >= cjk * 5, "en").otherwise("mixed")


def letter_counts(c: Column) -> tuple[Column, Column]:
    return count_of(c, CJK), count_of(c, "A-Za-z")


def is_cjk_language(name: Column) -> Column:
    t = F.lower(stripped(name))
    return any_of(*[t.contains(n) for n in CJK_LANGUAGE_NAMES])


def is_cjk_target(name: Column) -> Column:
    """Name or code of a language in CJK script; codes match as a whole."""
    t = F.lower(stripped(name))
    return t.rlike(f"[{CJK}]") | F.regexp_replace(t, "[^a-z]", "").isin(CJK_TARGET_CODES) | any_of(*[t.contains(n) for n in CJK_TARGET_NAMES])


def has_residual_cjk(c: Column) -> Column:
    """Two ideographs in a row, or one that isn't a unit mark."""
    return c.rlike(f"[{CJK}]{{2}}|[{CJK}&&[^{UNIT_MARKS}]]")


def is_latin_prose(c: Column) -> Column:
    return ~c.rlike(f"[{CJK}]") & (F.size(F.regexp_extract_all(c, F.lit(r"([A-Za-z]+(?:[’'-][A-Za-z]+)*)"), F.lit(1))) >= 3)


def is_statement_code(c: Column) -> Column:
    """A short identifier of a form or account: digits, few ideographs, separators."""
    t = stripped(c)
    ideographs = count_of(t, CJK)
    return F.length(t).between(1, 16) & t.rlike(r"\d") & ideographs.between(1, 4) & t.rlike(f"^[{CJK}A-Za-z0-9][{CJK}A-Za-z0-9\\-－（）()、\\s]{{0,15}}$")


def cjk_residual(c: Column) -> Column:
    """Number of ideographs outside of statement codes."""
    runs = F.regexp_extract_all(c, F.lit(f"([{CJK}0-9A-Za-z\\-－（）()、]+)"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda acc, r: acc + F.when(is_statement_code(r), 0).otherwise(count_of(r, CJK)))


def is_scan_like(c: Column) -> Column:
    """No text worth checking: no letter and no amount-shaped number."""
    toks = F.regexp_extract_all(c, F.lit(r"([+-]?[0-9][0-9,.，．]*[0-9%]|[+-]?[0-9])"), F.lit(1))
    return F.coalesce((c == "") | (~c.rlike(r"\p{L}") & ~F.exists(toks, lambda t: t.rlike("[,，.．%]"))), F.lit(True))


def is_identity(source: Column, target: Column) -> Column:
    """The translation is its own prose-like source, but for case and white space."""
    s, t = F.lower(clean_space(source)), F.lower(clean_space(target))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (s != "") & (s == t) & ((letters >= 12) | (F.size(F.split(s, " ")) >= 3))


def clean_space(c: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def join_separator(left: Column, right: Column) -> Column:
    """What stands between two fragments of a paragraph: nothing between ideographs, else a space."""
    return F.when(F.substring(left, -1, 1).rlike(f"[{CJK}]") & F.substring(right, 1, 1).rlike(f"[{CJK}]"), "").otherwise(" ")


def join_texts(texts: Column) -> Column:
    """Fragments joined to one natural text; empty ones are skipped."""
    return F.aggregate(texts, F.lit(""), lambda acc, t: F.when(acc == "", t).when(t == "", acc).otherwise(F.concat(acc, join_separator(acc, t), t)))


def join_fragments(a: Column, b: Column) -> Column:
    ascii_edge = F.substring(a, -1, 1).rlike(r"^[\x00-\x7f]$") & F.substring(b, 1, 1).rlike(r"^[\x00-\x7f]$")
    return F.concat(a, F.when(ascii_edge, " ").otherwise(""), b)


def dehyphenate(lines: Column) -> Column:
    """Lines joined by spaces; an end-of-line hyphen goes where a lower-case letter follows."""
    return F.aggregate(lines, F.lit(None).cast("string"), lambda acc, t: F.when(acc.isNull(), t).when(acc.endswith("-") & t.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(acc, "-$", ""), t)).otherwise(F.concat(acc, F.lit(" "), t)))


def block_hash(c: Column) -> Column:
    return F.md5(c)


def snippet(c: Column, width: int = 30) -> Column:
    t = clean_space(c)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.substring(t, 1, width), F.lit("…")))


def page_label(low: Column, high: Column) -> Column:
    """1-based page range of 0-based page numbers."""
    return F.when(low == high, F.concat(F.lit("第 "), (low + 1).cast("string"), F.lit(" 页"))).otherwise(F.concat(F.lit("第 "), (low + 1).cast("string"), F.lit("-"), (high + 1).cast("string"), F.lit(" 页")))


def format_duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0.0), seconds)
    total = F.bround(s, 0).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    rest = F.concat(pad(F.floor(total % 3600 / 60)), F.lit(" 分 "), pad(total % 60), F.lit(" 秒"))
    return F.when(s < 60, F.format_string("%.1f 秒", s)).when(total >= 3600, F.concat(F.floor(total / 3600).cast("string"), F.lit(" 小时 "), rest)).otherwise(F.concat(F.floor(total / 60).cast("string"), F.lit(" 分 "), pad(total % 60), F.lit(" 秒")))


def interpret_decision(answer: Column) -> Column:
    """translate, keep or skip from a free answer; rules in order, keep where nothing is clear."""
    v = F.lower(stripped(F.coalesce(answer, F.lit(""))))
    has = lambda *words: any_of(*[v.contains(w) for w in words])
    return (
        F.when(has("跳过", "略过", "停") | v.startswith("skip") | v.isin("skipped", "none"), "skip")
        .when(v.contains("保留") & has("翻译", "译", "说明", "图注", "表注", "文字", "标题"), "translate")
        .when(has("保留", "原样", "不动", "不翻", "别译", "不用", "维持"), "keep")
        .when(has("翻译", "ocr", "转成", "译成", "换成") | v.startswith("translate"), "translate")
        .otherwise("keep")
    )


#: How a requirement names a range of pages, and a page.
SCOPE_RANGE, SCOPE_PAGE = r"第?\s*(\d+)\s*页?\s*(?:-|到|~|至)\s*第?\s*(\d+)\s*页", r"第\s*(\d+)\s*页"


def scope_pages(c: Column) -> Column:
    """(low, high), 0-based, of the first range of pages that a text names, else of the first page; null without one."""
    number = lambda pattern, group: F.regexp_extract(c, pattern, group).try_cast("int") - 1
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    return F.when(c.rlike(SCOPE_RANGE), pair(number(SCOPE_RANGE, 1), number(SCOPE_RANGE, 2))).when(c.rlike(SCOPE_PAGE), pair(number(SCOPE_PAGE, 1), number(SCOPE_PAGE, 1)))


def rgb(color: Column) -> Column:
    part = lambda bits: F.shiftright(color, bits).bitwiseAND(255) / F.lit(255.0)
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def glossary_key(*parts: Column) -> Column:
    """Cache key: 16 hex digits over the parts and the format version."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)
