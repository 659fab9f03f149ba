"""Numbers in text: repair, tokens, values, signs and section numbers, as Column expressions.

Two value extractors exist side by side, as their rules differ on purpose: `amounts` (page level; a
percent sign is part of the token and accounting parentheses negate) and `signature` (block level;
months in dates count as numbers and parentheses don't negate).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import NOTE_MARK, NUMERIC_CELL, STRONG_FIGURE, fold_width, stripped

VALUE = "decimal(38,8)"
#: Fixed values from here to CN_DIGITS: patterns of number tokens, units and currencies.
PAGE_TOKEN = r"[+-]?[0-9][0-9,.]*[0-9%]|[+-]?[0-9]"
BLOCK_TOKEN = r"[-+]?\d[\d,]*(?:\.\d+)?"
WELL_FORMED = r"^[0-9]{1,3}(,[0-9]{3})*(\.[0-9]{1,3})?$"
EN_UNIT = r"(?i)^\s*((?:ten|hundred)\s+)?(thousand|million|billion|trillion)\b"
CN_UNIT = r"^\s*(万亿|亿|万)"
UNIT_START = r"(?i)^\s*(?:ten|hundred|thousand|million|billion|trillion|万|亿)"
PAGE_CURRENCY = r"(?i)^\s*(?:元|人民币|RMB|yuan|USD|CNY|dollars?)(?:[^A-Za-z]|$)"
BLOCK_CURRENCY = r"^\s*(?:yuan|rmb|cny|usd|eur|hkd|jpy|dollars?|元|美元|港元|人民币)"
#: Powers of ten of unit words, months by name.
EN_POWERS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
CN_POWERS = {"万亿": 12, "亿": 8, "万": 4}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
CN_DIGITS = "零一二三四五六七八九"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: it is bound as a lambda variable, so that an expression that uses
    it many times doesn't grow by copies of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repair_separators(s: Column) -> Column:
    """Restores the grouping of a number whose separators were misread; digits stay as they are."""
    joined = F.regexp_replace(F.replace(s, F.lit("/"), F.lit("")), r",\s*,", ",")
    last_dot = F.regexp_extract(joined, r"^(.*)\.([^.]*)$", 2)
    head = F.regexp_extract(joined, r"^(.*)\.([^.]*)$", 1)
    dots_as_commas = F.replace(joined, F.lit("."), F.lit(","))
    with_dot = F.when(last_dot.rlike(r"^\d{1,3}$"), F.concat(F.replace(head, F.lit("."), F.lit(",")), F.lit("."), last_dot)).otherwise(dots_as_commas)
    without = F.when(joined.rlike(r",\d{1,2}$"), F.regexp_replace(joined, r",(\d{1,2})$", ".$1")).otherwise(dots_as_commas)
    return F.regexp_replace(F.when(joined.contains("."), with_dot).otherwise(without), r",{2,}", ",")


def repair_number(c: Column) -> Column:
    """A number as printed, from its misread form; anything that can't be settled stays unchanged."""

    def parts(s: Column) -> Column:
        opened = s.startswith("(")
        return let(F.when(opened, stripped(F.substring(s, 2, 1 << 20))).otherwise(s), lambda a: peel(opened, a))

    def peel(opened: Column, a: Column) -> Column:
        closed = a.endswith(")")
        return let(F.when(closed, stripped(F.regexp_replace(a, r"\)$", ""))).otherwise(a), lambda b: core(opened, closed, b))

    def core(opened: Column, closed: Column, b: Column) -> Column:
        percent = b.endswith("%")
        d = F.when(percent, stripped(F.regexp_replace(b, "%$", ""))).otherwise(b)
        fields = F.struct(opened.alias("open"), closed.alias("close"), percent.alias("percent"), F.regexp_extract(d, r"^([+-])", 1).alias("sign"), stripped(F.regexp_replace(d, r"^[+-]", "")).alias("e"))
        return let(fields, settle)

    def settle(x: Column) -> Column:
        wrap = lambda digits: F.concat(F.when(x["open"], "(").otherwise(""), x["sign"], digits, F.when(x["percent"], "%").otherwise(""), F.when(x["close"], ")").otherwise(""))
        e = x["e"]
        tight = F.regexp_replace(e, r"(?U)\s+", "")
        plain = let(tight, lambda t: F.when(t.contains(".") & t.contains("/"), F.replace(t, F.lit("/"), F.lit(""))).otherwise(t))
        grouped = let(F.replace(e, F.lit(" "), F.lit("")), lambda q: F.when(q.rlike(WELL_FORMED), wrap(q)).otherwise(let(repair_separators(q), lambda r: F.when(r.rlike(WELL_FORMED), wrap(r)))))
        fits = (e != "") & e.rlike(r"^[0-9,.\s/]+[%％]?$")
        return F.when(fits, F.when(e.contains(","), grouped).otherwise(wrap(plain)))

    return F.coalesce(let(stripped(F.translate(c, "，．（）　\u00a0％−－", ",.()  %--")), parts), c)


def is_numeric_cell(c: Column) -> Column:
    """A figure and nothing else, well formed or to be repaired; note marks aren't figures. Only texts made of
    digits and marks are tried."""
    shaped = ~c.rlike(r"\p{L}") & c.rlike(r"\d")
    return F.coalesce(F.when(shaped, let(stripped(c), lambda t: (t != "") & ~t.rlike(NOTE_MARK) & (t.rlike(NUMERIC_CELL) | repair_number(t).rlike(NUMERIC_CELL)))), F.lit(False))


def is_strong_figure(c: Column) -> Column:
    return c.rlike(STRONG_FIGURE)


def unit_power(window: Column) -> Column:
    """Power of ten of a unit word at the start of the text after a number; 0 without one."""
    words = F.create_map(*[F.lit(x) for pair in {**EN_POWERS, **CN_POWERS, "": 0}.items() for x in pair])
    word = F.lower(F.regexp_extract(window, EN_UNIT, 2))
    prefix = F.lower(F.trim(F.regexp_extract(window, EN_UNIT, 1)))
    more = F.when(prefix == "hundred", 2).when(prefix == "ten", 1).otherwise(0)
    unit = F.when(window.rlike(EN_UNIT), F.element_at(words, word) + more).otherwise(F.element_at(words, F.regexp_extract(window, CN_UNIT, 1)))
    return F.when(window.rlike(UNIT_START), unit).otherwise(0)


def scaled(number: Column, power: Column) -> Column:
    """number (text without separators) times ten to the power, exactly; null where it isn't one."""
    tens = F.array(*[F.lit("1" + "0" * p).cast("decimal(15,0)") for p in range(15)])
    return (number.try_cast("decimal(22,8)") * F.element_at(tens, power + 1)).cast(VALUE)


def _each(text: Column, token: str, build) -> Column:
    """build(token, text before, text after) for each token; after the last one it is cut at 16 characters."""

    def zipped(t: Column) -> Column:
        toks, between = F.regexp_extract_all(t, F.lit(f"({token})"), F.lit(1)), F.split(t, token, -1)
        return let(F.struct(toks.alias("toks"), between.alias("btw")), walk)

    def walk(p: Column) -> Column:
        n = F.size(p["toks"])
        after = F.concat(F.slice(p["btw"], F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.substring(F.element_at(p["btw"], -1), 1, 16)))
        rows = F.arrays_zip(p["toks"].alias("tok"), p["btw"].alias("before"), after.alias("after"))
        return F.transform(F.slice(rows, F.lit(1), n), lambda r: build(r["tok"], r["before"], r["after"]))

    return let(text, zipped)


def _amount(tok: Column, before: Column, window: Column, power: Column) -> dict[str, Column]:
    """figure (whether it is amount-shaped), role and value of a token of a page."""
    negative = before.rlike("[(（]$") | tok.contains("-")
    role = F.concat(F.when(negative, "M").otherwise(""), F.translate(F.regexp_replace(tok, "[^0-9.,]", ""), ".,", "DC"))
    size = scaled(F.translate(tok, ",%+-", ""), power)
    return {"figure": tok.rlike("[,.%]") | (power != 0) | window.rlike(PAGE_CURRENCY), "role": role, "value": F.when(negative, -size).otherwise(size)}


def _number(tok: Column, before: Column, window: Column, power: Column) -> dict[str, Column]:
    """figure and value of a token of a block."""
    return {"figure": tok.rlike(r"\d[.,]\d") | window.startswith("%") | (power != 0) | window.rlike(BLOCK_CURRENCY), "value": scaled(F.translate(tok, ",", ""), power)}


def _built(fields) -> Callable[[Column, Column, Column], Column]:
    return lambda tok, before, window: let(unit_power(window), lambda power: F.struct(*[c.alias(n) for n, c in fields(tok, before, window, power).items()]))


def amounts(text: Column) -> Column:
    """Amount-shaped numbers of a page: array of (role, value). The role keeps digits and separator
    places (C and D, M for a negative); the value is null where separators don't make a number."""
    return F.filter(_each(fold_width(text), PAGE_TOKEN, _built(_amount)), lambda x: x["figure"])


def _months(t: Column) -> Column:
    """Month names as numbers. Texts without the start of one aren't searched for each."""
    out = t
    for i, name in enumerate(MONTHS):
        short = {"May": "May", "September": "September|Sept|Sep"}.get(name, f"{name}|{name[:3]}")
        out = F.regexp_replace(out, rf"\b(?:{short})\b", str(i + 1))
    return F.when(t.rlike(rf"\b(?:{'|'.join(m[:3] for m in MONTHS)})"), out).otherwise(t)


def _block_text(text: Column) -> Column:
    t = _months(F.translate(text, "０１２３４５６７８９．，−–—", "0123456789.,---"))
    spaced = F.regexp_replace(F.regexp_replace(t, r"(?<=[-+])\s+(?=\d)", ""), r"(?<=\d)-(?=\d)", " - ")
    return F.when(t.rlike("[-+]"), spaced).otherwise(t)


def signature(text: Column, figures_only: bool = False) -> Column:
    """Values of a block as an array (a multiset). figures_only: without bare integers."""
    found = F.filter(_each(_block_text(text), BLOCK_TOKEN, _built(_number)), lambda x: x["value"].isNotNull() & (x["figure"] if figures_only else F.lit(True)))
    return F.transform(found, lambda x: x["value"])


def token_rows(rows: DataFrame, keys: list[str], texts: list[Column], token: str) -> DataFrame:
    """(keys, side, tok, before, after): a row for each token of each of the texts of a row, side being the number of the
    text. One scan and one explode, so that what is made of tokens is compiled like any expression; as in the
    array forms, `after` is cut at 16 characters behind the last token."""
    sides = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), t.alias("t")) for i, t in enumerate(texts)])).alias("s")).select(*keys, "s.side", "s.t").where(F.col("t").rlike("[0-9]"))
    cut = sides.select(*keys, "side", F.regexp_extract_all("t", F.lit(f"({token})"), F.lit(1)).alias("toks"), F.split("t", token, -1).alias("btw"))
    each = F.arrays_zip(F.col("toks").alias("tok"), F.slice("btw", F.lit(1), F.size("toks")).alias("before"), F.slice("btw", F.lit(2), F.size("toks")).alias("after"))
    flat = cut.select(*keys, "side", F.size("toks").alias("n"), F.posexplode(each))
    return flat.select(*keys, "side", "col.tok", "col.before", F.when(F.col("pos") + 1 == F.col("n"), F.substring("col.after", 1, 16)).otherwise(F.col("col.after")).alias("after"))


def _value_rows(tokens: DataFrame, keys: list[str], fields) -> DataFrame:
    powered = tokens.withColumn("power", unit_power(F.col("after")))
    return powered.select(*keys, "side", *[c.alias(n) for n, c in fields(F.col("tok"), F.col("before"), F.col("after"), F.col("power")).items()])


def amount_rows(rows: DataFrame, keys: list[str], *texts: Column) -> DataFrame:
    """amounts() of several texts a row, as rows (keys, side, role, value)."""
    return _value_rows(token_rows(rows, keys, [fold_width(t) for t in texts], PAGE_TOKEN), keys, _amount).where("figure").drop("figure")


def signature_rows(rows: DataFrame, keys: list[str], *texts: Column) -> DataFrame:
    """signature() of several texts a row, as rows (keys, side, figure, value)."""
    return _value_rows(token_rows(rows, keys, [_block_text(t) for t in texts], BLOCK_TOKEN), keys, _number).where("value is not null")


SIGN_SHAPE = r"[-−]?\s*[（(]?\s*[0-9][0-9,.]*"


def sign_rows(rows: DataFrame, keys: list[str], *texts: Column, least_digits: int = 6) -> DataFrame:
    """figure_signs() of several texts a row, as rows (keys, side, digits, negative)."""
    sides = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), t.alias("t")) for i, t in enumerate(texts)])).alias("s"))
    found = sides.where(F.col("s.t").rlike("[0-9]")).select(*keys, "s.side", F.explode(F.regexp_extract_all("s.t", F.lit(f"({SIGN_SHAPE})"), F.lit(1))).alias("m"))
    return found.select(*keys, "side", F.translate("m", "-−（( \t\n\r\f\u000b,.", "").alias("digits"), F.col("m").rlike("^[-−]|[（(]").alias("negative")).where(F.length("digits") >= least_digits)


def figure_signs(text: Column, least_digits: int = 6) -> Column:
    """Array of (digits, negative) of long figures, whatever their separators."""
    t = F.coalesce(text, F.lit(""))
    shape = r"([-−]?)\s*([（(]?)\s*([0-9][0-9,.]*)"
    parts = [F.regexp_extract_all(t, F.lit(shape), F.lit(i)) for i in (1, 2, 3)]
    rows = F.zip_with(F.arrays_zip(parts[0].alias("a"), parts[1].alias("b")), parts[2], lambda p, d: F.struct(F.regexp_replace(d, r"\D", "").alias("digits"), ((p["a"] != "") | (p["b"] != "")).alias("negative")))
    return F.filter(rows, lambda x: F.length(x["digits"]) >= least_digits)


def cn_to_int(c: Column) -> Column:
    """Chinese numeral to int (up to 99; hundreds and thousands give null); Arabic digits as they are."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(True).alias("ok"))

    def step(acc, ch):
        digit = F.when(ch.rlike("^[0-9]$"), ch.try_cast("int")).otherwise(F.instr(F.lit(CN_DIGITS), ch) - 1)
        ten = ch == "十"
        return F.struct(
            F.when(ten, acc["total"] + F.when(acc["now"] != 0, acc["now"] * 10).otherwise(10)).otherwise(acc["total"]).alias("total"),
            F.when(ten, 0).otherwise(acc["now"] * 10 + digit).alias("now"),
            (acc["ok"] & (ten | (digit >= 0))).alias("ok"),
        )

    return F.when(c.rlike("^[0-9]{1,9}$"), c.try_cast("int")).otherwise(F.aggregate(chars, state, step, lambda s: F.when(s["ok"], s["total"] + s["now"])))


def normalize_ordinals(text: Column) -> Column:
    """Chinese ordinal marks (一、 （四） 第二节) with Arabic digits from 1 to 99; their delimiters stay, so that the
    digits can't run into a figure beside them."""
    n = "[一二三四五六七八九十]{1,3}"
    mark = rf"第\s*{n}\s*[章节条篇]|{n}\s*[、．]|[（(]\s*{n}\s*[)）]"

    def converted(tok: Column) -> Column:
        number = cn_to_int(F.regexp_extract(tok, f"({n})", 1))
        tail = F.regexp_extract(tok, "([章节条篇、．])$", 1)
        return let(number, lambda v: F.when(v.isNull() | (v < 1) | (v > 99), tok).when(tail != "", F.concat(v.cast("string"), tail)).otherwise(F.concat(F.lit("("), v.cast("string"), F.lit(")"))))

    toks, between = F.regexp_extract_all(text, F.lit(f"({mark})"), F.lit(1)), F.split(text, mark, -1)
    rest = F.zip_with(toks, F.slice(between, 2, 1 << 30), lambda t, after: F.concat(converted(t), after))
    return F.when(text.rlike("[一二三四五六七八九十]"), F.concat(between[0], F.array_join(rest, ""))).otherwise(text)


def section_numbers(text: Column) -> Column:
    """Heading numbers of a page in order: array of (raw, value); the first rule that fits a line wins."""
    lines = F.split(text, "\r\n|\n|\r")

    def line(t):
        dotted = F.regexp_extract(t, r"^\s*(\d{1,2}(?:\.\d{1,2})*)[\.、．]\s*\D", 1)
        cn = F.regexp_extract(t, r"第\s*([0-9]+|[一二三四五六七八九十百\d]+)\s*[章节条篇节]", 1)
        word = F.regexp_extract(t, r"(?i)^\s*(?:Section|Chapter|Part|Article|Item|Clause)\s+([0-9]{1,9})\b", 1)
        mark = r"^\s*(?:[（(]\s*([一二三四五六七八九十]{1,3})\s*[)）]|([一二三四五六七八九十]{1,3})\s*[、．])"
        ordinal = F.concat(F.regexp_extract(t, mark, 1), F.regexp_extract(t, mark, 2))
        paren = F.regexp_extract(t, r"^\s*[（(]\s*([0-9]{1,4})\s*[)）]\s*\S", 1)
        pair = lambda raw, value: F.struct(raw.alias("raw"), value.cast("long").alias("value"))
        folded = F.aggregate(F.split(dotted, r"\."), F.lit(0).cast("long"), lambda acc, p: acc * 100 + F.coalesce(p.try_cast("long"), F.lit(0)))
        return (
            F.when(dotted != "", pair(dotted, folded))
            .when((cn != "") & cn_to_int(cn).isNotNull(), pair(cn, cn_to_int(cn)))
            .when(word != "", pair(F.concat(F.lit("word "), word), word.try_cast("long")))
            .when((ordinal != "") & cn_to_int(ordinal).isNotNull(), pair(ordinal, cn_to_int(ordinal)))
            .when(paren != "", pair(paren, paren.try_cast("long")))
        )

    return F.filter(F.transform(lines, line), lambda x: x.isNotNull())


def section_style(sections: Column) -> Column:
    """dot, plain, cn, word or paren where all heading numbers agree; else mixed."""
    style = lambda r: F.when(r.startswith("word"), "word").when(r.contains("."), "dot").when(r.rlike(r"^\d+$"), "plain").when(r.rlike("[一-鿿]"), "cn").otherwise("paren")
    styles = F.array_distinct(F.transform(sections, lambda s: style(s["raw"])))
    return F.when(F.size(styles) == 1, styles[0]).otherwise("mixed")


def multiset_diff(rows: DataFrame, keys: list[str], source: str, target: str, value: str = "value") -> DataFrame:
    """Values that one array column holds more often than the other, per key: keys, value, n_source,
    n_target, missing, extra. One aggregation over both sides; no join."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("values")) for i, c in enumerate((source, target))])
    both = rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", F.explode("s.values").alias(value))
    return side_diff(both, keys, value)


def side_diff(both: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """multiset_diff() of rows (keys, side, value): side 0 is the source, side 1 the target."""
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    sums = both.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count(0).alias("n_source"), count(1).alias("n_target")).where("n_source <> n_target")
    zero = F.lit(0).cast("long")
    return sums.select(*keys, value, "n_source", "n_target", F.greatest(F.col("n_source") - F.col("n_target"), zero).alias("missing"), F.greatest(F.col("n_target") - F.col("n_source"), zero).alias("extra"))
