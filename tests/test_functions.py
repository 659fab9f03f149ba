import pytest
from pyspark.sql import functions as F

from blockloom.functions import geometry as G
from blockloom.functions import numbers as N
from blockloom.functions import text as X


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ["i", *"abcdef"[: len(rows[0]) if isinstance(rows[0], tuple) else 1]])
    got = df.select("i", *[c.alias(f"r{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r)[1:] for r in got]


A, B = F.col("a"), F.col("b")


def test_number_repair(spark):
    cases = {
        "3,702.726,474.45": "3,702,726,474.45", "65, 334, 085.99": "65,334,085.99", "11,530,351,55": "11,530,351.55", "231. / 81": "231.81", "(3,702.726,474.45)": "(3,702,726,474.45)",
        "1960.08": "1960.08", "92.5%": "92.5%", "10/20": "10/20", "12,34,56,789": "12,34,56,789", "2025年12月31日": "2025年12月31日", "": "", "abc": "abc", "1,234.56": "1,234.56", "-1, 234": "-1,234", "192, / 003,164.72": "192,003,164.72",
    }
    assert values(spark, list(cases), N.repair_number(A)) == list(cases.values())


def test_numeric_cells(spark):
    cases = {"(1,234.56)": True, "1000": True, "1234.56": True, "1960.08": True, "-60,327,958.12": True, "—": False, "营业收入": False, "1,234.56万元": False, "(1)": False, "(二)": False, "八)": False, "(3,702.726,474.45)": True, "": False}
    assert values(spark, list(cases), N.is_numeric_cell(A)) == list(cases.values())


@pytest.mark.parametrize(
    ("source", "target", "equal"),
    [
        ("3.14 亿元 和 1,234.56 万元", "314 million yuan and 12,345,600 yuan", True),
        ("3.14 亿元", "314 thousand yuan", False),
        ("１，２３４．５６ 万元", "1,234.56 ten thousand yuan", True),
        ("1,234.56", "1234.56", True),
        ("1,234.56 万元", "1,234.56 yuan", False),
        ("92.5%", "9.25%", False),
        ("（1,234.56）", "1,234.56", False),
        ("一、1,234.56", "1. 1,234.56", True),
    ],
)
def test_value_difference(spark, source, target, equal):
    df = spark.createDataFrame([(1, source, target)], ["k", "s", "t"])
    value = lambda c: F.transform(N.amounts(N.normalize_ordinals(F.col(c))), lambda a: a["value"])
    assert (N.multiset_diff(df.select("k", value("s").alias("s"), value("t").alias("t")), ["k"], "s", "t").count() == 0) == equal


@pytest.mark.parametrize(("source", "target", "equal"), [("2023年12月31日", "December 31, 2023", True), ("3,702,726,474.45", "3,702,726,474.4", False), ("2025年1月1日", "Jan 1, 2025", True), ("3.14 亿元", "314 million yuan", True), ("− 7,326.50", "-7,326.50", True), ("2023-12-31", "December 31, 2023", True)])
def test_block_signature(spark, source, target, equal):
    a, b = values(spark, [(source, target)], F.array_sort(N.signature(A)), F.array_sort(N.signature(B)))[0]
    assert (a == b) == equal


def test_figures_only(spark):
    assert [len(v) for v in values(spark, ["Tier 1 capital 5 yuan", "(4) item", "1,000 and 7%"], N.signature(A, True))] == [1, 0, 2]


def test_roles(spark):
    assert [[r["role"] for r in v] for v in values(spark, ["3,702,726,474.45", "（1,234.56）", "22"], N.amounts(A))] == [["3C702C726C474D45"], ["M1C234D56"], []]


def test_signs(spark):
    got = values(spark, ["-5,138,116,000.00 x 5,138.116,000.00", "（5,138,116,000.00）", "-3"], N.figure_signs(A))
    assert [[(r["digits"], r["negative"]) for r in v] for v in got] == [[("513811600000", True), ("513811600000", False)], [("513811600000", True)], []]


def test_numerals_and_ordinals(spark):
    assert values(spark, ["四", "十", "十二", "二十", "九十九", "三百", "12", "x"], N.cn_to_int(A)) == [4, 10, 12, 20, 99, None, 12, None]
    cases = {"一、总则": "1、总则", "（四）其他": "(4)其他", "第二节": "2节", "十二、": "12、", "二十一、": "21、", "一、1,234.56": "1、1,234.56", "三百、": "三百、", "plain": "plain"}
    assert values(spark, list(cases), N.normalize_ordinals(A)) == list(cases.values())


def test_section_numbers(spark):
    text = "1.2. Scope\nChapter 4\n第四十七条 x\n（四）其他\n(7) note\n0.21 0.22\nplain"
    got = values(spark, [text], N.section_numbers(A))[0]
    assert [(r["raw"], r["value"]) for r in got] == [("1.2", 102), ("word 4", 4), ("四十七", 47), ("四", 4), ("7", 7)]
    styles = values(spark, ["Chapter 4\nPart 5", "1.2. a", "一、a\n1. b", ""], N.section_style(N.section_numbers(A)))
    assert styles == ["word", "dot", "mixed", "mixed"]


def test_text_predicates(spark):
    formulas = {"P(y|x;T)=exp(z_i/T)": True, "exp(z_i/T)": True, "The value (T = 0.59) is cited in this sentence here.": False, "a=b+c": False, "a=b+c-d": True, "收入=成本": False, "": False, "x" * 80 + "=+^": False}
    assert values(spark, list(formulas), X.is_formula(A)) == list(formulas.values())
    entries = {"• a": True, "- a": True, "-a": False, "27) b": True, "（一）c": True, "①d": True, "Label: value": True, "联系地址：某处": True, "word word": False, "  3. x": True}
    assert values(spark, list(entries), X.is_entry(A)) == list(entries.values())
    residue = {"1,234 元": False, "总资产": True, "5 万元": True, "ok": False, "a 资 b": True}
    assert values(spark, list(residue), X.has_residual_cjk(A)) == list(residue.values())
    prose = {"three latin words": True, "GB/T 33436-2016": False, "USD 100 million": False, "混 three latin words": False}
    assert values(spark, list(prose), X.is_latin_prose(A)) == list(prose.values())
    scans = {"22": True, "": True, "1,234.56": False, "page": False, "页": False}
    assert values(spark, list(scans), X.is_scan_like(A)) == list(scans.values())
    codes = {"会商银02表": True, "2025年年度报告": False, "会企01表-1": True, "abc1": False}
    assert values(spark, list(codes), X.is_statement_code(A)) == list(codes.values())
    assert values(spark, ["Simplified Chinese", "English", "ja", "中文"], X.is_cjk_language(A)) == [True, False, True, True]
    assert values(spark, ["zh", "Western", "cn", "日本語"], X.is_cjk_target(A)) == [True, False, True, True]
    decisions = {"跳过": "skip", "保留公式并翻译说明": "translate", "不翻译": "keep", "翻译": "translate", "skip it": "skip", "": "keep", "OCR 一下": "translate"}
    assert values(spark, list(decisions), X.interpret_decision(A)) == list(decisions.values())
    assert values(spark, ["•", "。", "a", "中"], X.is_pure_symbol(A)) == [True, True, False, False]
    assert values(spark, [("PDF", "PDF"), ("a whole sentence here", "A  Whole sentence HERE"), ("abc", "abd")], X.is_identity(A, B)) == [False, True, False]


def test_joining(spark):
    df = spark.createDataFrame([(["资本", "充足率", "", "is high", "now"], ["genera-", "tion of Late-", "Stage"])], "a array<string>, b array<string>")
    row = df.select(X.join_texts(A).alias("x"), X.dehyphenate(B).alias("y")).first()
    assert (row.x, row.y) == ("资本充足率 is high now", "generation of Late- Stage")
    assert values(spark, [12.34, 65.2, 3725.0, -1.0], X.format_duration(A)) == ["12.3 秒", "1 分 05 秒", "1 小时 02 分 05 秒", "0.0 秒"]
    assert values(spark, [(0, 0), (1, 4)], X.page_label(A, B)) == ["第 1 页", "第 2-5 页"]
    assert tuple(values(spark, [0xFF0080], X.rgb(A.cast("int")))[0]) == pytest.approx((1.0, 0.0, 128 / 255))


def test_geometry(spark):
    r = lambda *v: tuple(F.lit(float(x)) for x in v)
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(G.covered_ratio(r(0, 0, 10, 10), r(5, 0, 20, 10))) == 0.5
    assert one(G.centre_in(r(0, 0, 10, 10), r(5, 5, 9, 9)))
    assert one(G.overlaps(r(10, 10, 100, 20), r(10, 20, 100, 30))) is False
    assert one(G.folded_angle(F.lit(91.0))) == 1.0 and one(G.folded_angle(F.lit(-46.0))) == 44.0
    assert one(G.upper_median(F.array(*[F.lit(x) for x in (1, 2, 3, 4)]))) == 3
    assert tuple(one(G.rotated(r(10, 20, 30, 40), F.lit(180), F.lit(100.0), F.lit(200.0)))) == (70.0, 160.0, 90.0, 180.0)
    band = one(G.glyph_band(F.lit(0.0), F.lit(1.0), F.lit(10.0), F.lit(10.0), F.lit(0.8), F.lit(-0.2)))
    assert (band.y0, band.y1) == (2.0, 12.0)
