import json
from collections import Counter
from random import Random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.audit import checks as C
from blockloom.audit import scores as E
from blockloom.operators import aggregates as A
from blockloom.operators import joins as J
from blockloom.operators import layout as L
from blockloom.operators import replies as R
from blockloom.operators import sequence as S
from blockloom.operators import translate
from blockloom.plans import flows as P
from blockloom.schema import BLOCK, with_defaults
from blockloom.sources import ingest as I
from blockloom.sources import sinks as K
from blockloom.streaming.upserts import append_batches, newest, op_budget, op_budget_stream


def reply(spark, raw, n):
    texts, reason = R.strict_reply(F.col("raw"), F.col("n"))
    r = spark.createDataFrame([(raw, n)], "raw string, n int").select(texts.alias("t"), reason.alias("r")).first()
    return r.t, r.r


@pytest.mark.parametrize(
    ("raw", "n", "texts"),
    [
        ("[[1]] a\n[[2]] b", 3, None), ("[[1]]a\n[[4]]d", 2, None), ("[[1]]a\n[[1]]b\n[[2]]c", 2, None), ("[[1]]\n[[2]]b", 2, None), ("  ", 1, None), ("x\ny", 2, ["x", "y"]), ("x\ny", 3, None),
        ("long\nreply", 1, ["long reply"]), ("[[2]] b\nmore\n[[1]] a", 2, ["a", "b more"]),
    ],
)
def test_strict_replies(spark, raw, n, texts):
    got, reason = reply(spark, raw, n)
    assert got == texts and (reason is None) == (texts is not None)


def test_lenient_replies(spark):
    rows = [("[[2]] B\n[[2]] C\n[[9]] z", ["a", "b", "c"]), ("x\ny\nz", ["a", "b", "c"]), ("sorry", ["a", "b"]), ("[[1]]", ["a"])]
    got = spark.createDataFrame(rows, "raw string, s array<string>").select(R.lenient_reply(F.col("raw"), F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [["a", "B", "c"], ["x", "y", "z"], ["a", "b"], ["a"]]


def test_grids_and_merges(spark):
    rows = [('x {"rows": [["a"], ["b", "c"]]} y',), ("no",), ('{"rows": []}',), (json.dumps({"rows": [["x"] * 41]}),)]
    got = spark.createDataFrame(rows, "raw string").select(R.table_grid(F.col("raw")).alias("g")).collect()
    assert [r.g for r in got] == [[["a", ""], ["b", "c"]], None, None, None]
    calls = spark.createDataFrame([([("detect_table_merge", '{"row":0,"col":1,"rowspan":1,"colspan":2}'), ("other", "{}"), ("detect_table_merge", "bad")],)], "c array<struct<name:string,arguments:string>>")
    assert [tuple(m) for m in calls.select(R.merge_calls(F.col("c")).alias("m")).first().m] == [(0, 1, 1, 2)]


def test_glossaries(spark):
    entries = spark.createDataFrame([(1, "bank", "Bank", 0), (1, "ghost", "Ghost", 1), (1, " ", "x", 2), (1, "term", "Term", 3)], "doc_id int, source string, target string, priority int")
    docs = spark.createDataFrame([(1, "the bank has a term")], "doc_id int, text string")
    good, bad = R.validate_glossary(entries, docs, most=1)
    assert [r.source for r in good.collect()] == ["bank"]
    assert {r.source.strip(): r.reason for r in bad.collect()} == {"ghost": "not in the source", "": "blank", "term": "above the cap"}
    maps = spark.createDataFrame([({"a": "1"}, {"a": "0", "b": "2"})], "i map<string,string>, d map<string,string>")
    assert maps.select(R.merged_glossary(F.col("i"), F.col("d")).alias("m")).first().m == {"a": "1", "b": "2"}


def boxes(rows):
    return [{"x0": float(a), "y0": float(b), "x1": float(c), "y1": float(d)} for a, b, c, d in rows]


def test_reading_order_of_two_columns():
    left = [(60, 100 + 20 * i, 260, 110 + 20 * i) for i in range(4)]
    right = [(315, 100 + 20 * i, 515, 110 + 20 * i) for i in range(4)]
    head, foot = (60, 50, 515, 60), (60, 300, 515, 310)
    items = boxes([*[x for pair in zip(left, right, strict=True) for x in pair], head, foot])
    assert S.reading_order(items) == [8, 0, 2, 4, 6, 1, 3, 5, 7, 9]
    running_head = boxes([(150, 80, 400, 90), *left, *right])
    order = S.reading_order(running_head)
    assert [i for i in order if i] == [1, 2, 3, 4, 5, 6, 7, 8]


@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 700), st.integers(1, 300), st.integers(1, 30)), max_size=25))
@settings(max_examples=80, deadline=None)
def test_reading_order_is_a_permutation(rows):
    items = boxes([(a, b, a + c, b + d) for a, b, c, d in rows])
    assert sorted(S.reading_order(items)) == list(range(len(items)))
    assert len(S.cluster_columns(items)) == len(items)


def test_paragraphs(spark):
    rows = [("Title", 10, 10, 100, 26, 16.0), ("A line of", 10, 30, 200, 40, 10.0), ("prose that goes-", 10, 42, 200, 52, 10.0), ("on.", 10, 54, 60, 64, 10.0), ("• entry", 10, 66, 100, 76, 10.0), ("far", 10, 120, 90, 130, 10.0)]
    df = spark.createDataFrame([("d", 0, i, t, float(a), float(b), float(c), float(d), s, False, 0) for i, (t, a, b, c, d, s) in enumerate(rows)], "doc_id string, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, color int")
    keys = ["doc_id", "page_no"]
    got = S.paragraph_blocks(S.with_paragraphs(S.with_reading_order(df, keys), keys), keys).orderBy("block_no").collect()
    assert [r.text for r in got] == ["Title", "A line of prose that goeson.", "• entry", "far"]
    assert [r.single_line for r in got] == [True, False, True, True]


@given(st.lists(st.integers(1, 60), min_size=1, max_size=30), st.integers(5, 80), st.integers(1, 6))
@settings(max_examples=10, deadline=None)
def test_batches_keep_order_and_budget(spark, sizes, budget, most):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "doc_id int, block_id int, s int")
    got = S.greedy_batches(df, ["doc_id"], "block_id", F.col("s"), budget, most).orderBy("block_id").collect()
    numbers = [r.batch_no for r in got]
    assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1))
    for b in set(numbers):
        own = [r.s for r in got if r.batch_no == b]
        assert len(own) <= most and (sum(own) <= budget or len(own) == 1)


def test_terms(spark):
    text = "本公司资本充足率较高。资本充足率为十。资本充足率与本公司。"
    df = spark.createDataFrame([(1, 0, text), (1, 1, "Revenue and The Group. While Revenue The Group Figure Figure")], "doc_id int, block_id int, text string")
    grams = {r.gram for r in A.ngram_terms(df, ["doc_id"]).collect()}
    assert "资本充足率" in grams and "充足率" not in grams
    assert [r.term for r in A.latin_terms(df, ["doc_id"]).orderBy("rank").collect()] == ["Revenue", "Group"]


def test_repeated_grams_move_by_document(spark):
    """Whole texts are exchanged, not their grams, and what is counted is what counting all grams gives."""
    rows = [(1, 0, "abcabc 资abc"), (1, 1, "xabcabcd a\U0001f600b\U0001f600"), (2, 0, "abcd abce zz zz zz"), (2, 1, None), (3, 0, "q"), (None, 0, "abab abab"), (4, 0, "w" * 60)]
    df = spark.createDataFrame(rows, "doc_id int, block_id int, text string")
    out = A.ngram_terms(df, ["doc_id"], run=r"[^\s]{2,}", edge="[0-9]", numerals="^[0-9]+$")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "gram" not in plan.split("Exchange hashpartitioning")[1]
    got = {(r.doc_id, r.gram): r.n for r in out.collect()}
    every = Counter((d, r[i : i + n]) for d, _, t in rows for r in (t or "").split() for n in range(2, min(20, len(r)) + 1) for i in range(len(r) - n + 1))
    often = {g: k for g, k in every.items() if k >= 2}
    covered = {(d, p) for d, g in often if len(g) > 2 and d is not None for p in (g[1:], g[:-1])}
    assert got == {(d, g): k for (d, g), k in often.items() if len(g) <= 12 and (d, g) not in covered}


def test_entities(spark):
    text = "Zhejiang Mintai Commercial Bank Co., Ltd. and Huishang Bank met. The Company implemented the plan; the Bank is described. Bank of China too."
    names = spark.range(1).select(A.entity_names(F.lit(text)).alias("n")).first().n
    assert "Huishang Bank" in names and "Bank of China" in names and "Zhejiang Mintai Commercial Bank" in names
    pages = spark.createDataFrame([(1, i, "浙江民泰商业银行股份有限公司年报", t) for i, t in enumerate(["Mintai Commercial Bank", "Mintai Commercial Bank", "the Company", "Tailong Commercial Bank"])], "doc_id int, page_no int, source string, target string")
    assert [(r.page_no, r.foreign) for r in A.entity_anchor(pages, ["doc_id"]).collect()] == [(3, ["tailong"])]


def test_layout_check_is_one_pass_with_what_its_checks_find(spark):
    """The checks one by one, each with joins of its own, find the same; the plan has a join or two a table, not dozens."""
    keys, r = ["doc_id", "page_no"], Random(3)
    make = lambda rows, names: spark.createDataFrame(rows, f"doc_id int, page_no int, {names}")
    at = lambda: (x := r.uniform(0, 90), y := r.uniform(0, 90), x + r.choice([0.0, 5.0, 30.0, -4.0]), y + r.choice([10.0, 12.0, -3.0]))
    gone = lambda box: tuple(None if r.random() < 0.03 else float(v) for v in box)
    places = [(d, p) for d in (1, 2, 3, 4) for p in range(4)]
    source = make([(*k, 100.0, 100.0) for k in places], "width double, height double")
    pages = [k for k in places if k != (2, 3)] + [(3, p) for p in range(4, 8)] + [(4, 4), (None, 2), (1, None)]
    target = make([(*k, r.choice([100.0, 102.0, None]), 100.0) for k in pages], "width double, height double")
    some = lambda k, n, row: [(*k, i, *row(i)) for i in range(n)]
    spans = make([x for k in [*pages, (9, 0)] for x in some(k, 12, lambda i: (*gone(at()), r.choice([2.5, 5.0, 9.0, None]), 1.0, 95.0, 90.0, r.choice([True, False, None])))], "span_no int, x0 double, y0 double, x1 double, y1 double, size double, page_x0 double, page_x1 double, page_y1 double, source_ink boolean")
    blocks = make([x for k in [*places, (None, 1)] for x in some(k, 12, lambda i: (r.choice(["a", " ", "b", None]), *gone(at()), r.choice([6.0, 3.0, None])))], "block_id int, text string, x0 double, y0 double, x1 double, y1 double, floor double")
    rules = make([(*k, y, 0.0, 60.0) for k in pages for y in (20.0, 50.0, 51.0)], "y double, x0 double, x1 double")
    ranges = spark.createDataFrame([(4, 0, 0), (4, 0, 1), (4, 1, 1), (4, 2, 3)], "doc_id int, source_page int, target_page int")
    for mapped in (None, ranges):
        pairs = J.pair_pages(source, target, mapped, ["doc_id"])
        own = blocks.withColumnRenamed("page_no", "source_page").join(pairs.select("doc_id", F.col("page_no").alias("source_page"), F.col("target_page").alias("page_no")), ["doc_id", "source_page"]).drop("source_page")
        single = pairs.groupBy(*keys).agg(F.count("*").alias("k"), F.min("target_page").alias("t")).where("k = 1").select("doc_id", F.col("t").alias("page_no"))
        credited = J.credited_blocks(spans, own, keys)
        each = {
            "overlap": J.colliding_spans(spans, keys).select(*keys, "a_no"), "off_page": C.off_page(spans, keys), "rule": C.rule_crossings(spans, rules, keys), "missing": J.missing_blocks(own.join(single, keys, "left_semi"), credited, keys).select(*keys, "block_id"),
            "page_size": C.page_size_findings(source, target, pairs, ["doc_id"]).select("doc_id", "target_page", "target_page"), "extra_page": C.extra_pages(target, pairs, ["doc_id"]).select(*keys, "page_no"),
        }
        if mapped is None:  # else pages are mapped twice, where blocks of two pages have one number
            each["small"] = C.too_small_spans(spans, credited, own, keys).select(*keys, "span_no")
        want = Counter((d, p, name, i) for name, rows in each.items() for d, p, i in map(tuple, rows.collect()))
        out = C.layout_check(source, target, spans, blocks, rules, ["doc_id"], mapped)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") <= 12 and plan.count("Exchange hashpartitioning") <= 40
        got = Counter(tuple(x) for x in out.collect() if x.check in each)
        assert got == want and {name for _, _, name, _ in want} == set(each)


def test_spans_collide_and_are_credited(spark):
    schema = "page_no int, span_no int, x0 double, y0 double, x1 double, y1 double"
    pair = lambda a, b: spark.createDataFrame([(1, 0, *map(float, a)), (1, 1, *map(float, b))], schema)
    assert J.colliding_spans(pair((10, 10, 110, 24), (60, 18, 110, 32)), ["page_no"]).count() == 1
    assert J.colliding_spans(pair((10, 10, 100, 20), (10, 20, 100, 30)), ["page_no"]).count() == 0
    blocks = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 100.0, 100.0), (1, 1, "b", 0.0, 105.0, 100.0, 120.0)], "page_no int, block_id int, text string, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 0, 0.0, 106.0, 90.0, 118.0)], schema)
    credited = J.credited_blocks(spans, blocks, ["page_no"])
    assert [r.block_id for r in credited.collect()] == [1]
    assert [r.block_id for r in J.missing_blocks(blocks, credited, ["page_no"]).collect()] == [0]


def test_split_translation():
    assert L.split_translation(["a", "b", "c"], "xy") == ["xy", "b", "c"]
    assert L.split_translation(["12345", "123456789"], "abcdefgh WXYZQ") == ["abcdefgh", " WXYZQ"] or L.split_translation(["12345", "123456789"], "abcdefgh WXYZQ")[0].strip() == "abcdefgh"
    assert L.split_translation(["ab", "cd"], "ab cd") == ["ab", "cd"]
    assert "1,234.56" in "|".join(L.split_translation(["xx", "yyy", "zz"], "a 1,234.56 b"))


@given(st.lists(st.text("ab ", min_size=1, max_size=12), min_size=2, max_size=5), st.text("xyz 1.,", min_size=8, max_size=60))
@settings(max_examples=100, deadline=None)
def test_split_translation_loses_nothing(sources, text):
    squeeze = lambda s: "".join(s.split())
    parts = L.split_translation(sources, text)
    assert len(parts) == len(sources)
    if squeeze(text) and all(p.strip() not in [x.strip() for x in sources] for p in parts):
        assert squeeze("".join(parts)) == squeeze(text)


def test_wrapping_and_fitting(spark):
    f = L.FixedAdvance()
    assert L.wrap(f, "aaa bbb ccc", 40, 10) == ["aaa bbb", "ccc"]
    assert L.wrap(f, "Non-Performing", 40, 10) == ["Non-", "Performi-", "ng"]
    assert L.wrap(f, "US$1,234,567.89", 20, 10) == ["US$1,234,567.89"]
    assert all(f.width(x, 10) <= 50 for x in L.wrap(f, "汉字" * 10, 50, 10))
    lines, size = L.fit(f, "word " * 40, source="x", x0=0, y0=0, x1=100, y1=20, size=12)
    assert size == pytest.approx(L.READABLE)
    lines, size = L.fit(f, "two line cell text", source="a\nb", x0=0, y0=0, x1=60, y1=30, in_table=True)
    assert len(lines) == 2
    assert L.in_band(f, "a b c d e f", 20, 20.0)[1] <= L.TABLE_READABLE
    widths = L.rebalanced([50, 50, 50], [100, 10, 40], [False, False, True])
    assert sum(widths) == pytest.approx(150) and widths[2] == 50 and widths[0] > 50


def test_audit_and_scores(spark):
    rows = [(1, 0, 0, "总资产增加", "total assets grew"), (1, 0, 1, "收入 5 万元", ""), (1, 0, 2, "负债合计", "负债 total"), (1, 1, 3, "1,234.56 亿元 the sum", "999 the sum"), (1, 1, 4, "123", "")]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, block_id int, text string, target string").withColumns({n: F.lit(False) for n in ("is_chart", "keep_original", "in_table")})
    keys = ["doc_id", "page_no"]
    found, unknown = C.audit(df, keys, ["residual", "missing", "numbers", "table", "typo"])
    kinds = {(r.block_id, r.check, r.kind) for r in found.collect()}
    assert {(1, "residual", "empty"), (1, "missing", "missing"), (2, "residual", "residual_cjk"), (3, "numbers", "numbers")} <= kinds and unknown == ["typo"]
    assert {r.check for r in found.collect()} >= {"unknown_checks", "table"}
    totals = spark.createDataFrame([(1, 10, 3.0, 1, 0, 0, 0), (2, 0, 0.0, 0, 0, 0, 0)], "doc_id int, total int, weighted double, missing int, residual int, identity int, numbers int")
    got = {r.doc_id: (r.score, r.no_data) for r in E.final_score(totals).collect()}
    assert got == {1: (54.55, False), 2: (0.0, True)}
    assert [C.verdict(0, 0), C.verdict(0, 2), C.verdict(0, 2, strict=True), C.verdict(1, 0), C.verdict(0, 0, usable=False)] == [0, 0, 1, 1, 2]


def test_ingest(spark):
    spec = spark.createDataFrame([("24-27,30",), ("3-1",), ("x",)], "s string").select(I.page_spec(F.col("s")).alias("p")).collect()
    assert [r.p for r in spec] == [[24, 25, 26, 27, 30], None, None]
    docs = spark.createDataFrame([(1, '{"0": {"text": "a"}, "x": {"text": "b"}, "2": {"text": "c"}}')], "doc_id int, raw string")
    assert {(r.block_id, r.text) for r in I.out_document(docs).collect()} == {(0, "a"), (2, "c")}
    maps = spark.createDataFrame([("0,2,2",), ("2,1",), ("a",), ("-1",), ("",)], "t string").select(K.decode_page_map(F.col("t")).alias("m")).collect()
    assert [r.m for r in maps] == [[0, 2, 2], None, None, None, None]
    assert with_defaults(spark.createDataFrame([("d", 1, "x")], "doc_id string, block_id int, text string")).dtypes == [(f.name, f.dataType.simpleString()) for f in BLOCK.fields]


def test_glossary_file(spark, tmp_path):
    (tmp_path / "glossary.json").write_text('{"银行": "bank", " ": "x"}', encoding="utf-8")
    (tmp_path / "broken.json").write_text("{nope", encoding="utf-8")
    assert [tuple(r) for r in I.read_glossary(spark, str(tmp_path / "glossary.json")).collect()] == [("银行", "bank")]
    assert I.read_glossary(spark, str(tmp_path / "broken.json")).collect() == []


def test_flows():
    calls = []
    tools = {"audit_page": lambda page, checks: calls.append(page) or {"clean": len(calls) > 2, "issues": []}}
    run = P.execute(P.build(P.compile_spec("自检只查数字，第3到第5页")), tools)
    assert calls == [2, 3, 4] and not run.error
    assert P.compile_spec("自检只查数字和表格，帮我改").checks == ["numbers", "table"] and P.compile_spec("只查数字").auto_fix is False
    assert P.explicit_scope("帮我翻译整篇年报，第5页的图表保留原文") is None and P.explicit_scope("只翻译第3页") == [2] and P.explicit_scope("只要第5页的数字没错") is None
    assert P.usable_scope([2, 1, -1]) == [1, 2] and P.usable_scope([True]) is None and P.usable_scope([1.5]) is None
    assert P.resolve({"page": "{{page}}", "t": "p{{page}}"}, {"page": 3}) == {"page": 3, "t": "p3"}
    missing = P.execute(P.Flow("f", "", [P.Tool("nope"), P.Tool("audit_page", {"page": 0, "checks": None})]), tools)
    assert "nope" in missing.error and len(calls) == 3
    assert P.execute(P.Flow("f", "", [P.Loop([P.Tool("audit_page", {"page": 9, "checks": None})], max_iter=9)]), tools, max_steps=2).error
    with pytest.raises(P.Cancelled):
        P.execute(P.FLOWS["export"], {}, cancel=lambda: True)
    assert P.unbound_tools(P.FLOWS["translate_doc"], {"get_doc_info"}) == ["audit_pages", "translate_pages"]
    plan = P.validate_tasks({"tasks": [{"name": "export"}, {"name": "ghost"}, {"name": "read_page", "params": {"page": 99}}]}, {"read_page"})
    assert plan.dropped == ["ghost"]
    out = P.run_tasks(plan, lambda t: {"error": "no such page"} if t.name == "read_page" else {"ok": True})
    assert not out["ok"] and out["executed"] == 2
    with pytest.raises(ValueError, match="range"):
        P.parse_pages("5-3")
    state = {1: 0, 2: 0}
    clean = P.review(lambda ps: {p: {"clean": state.get(p, 0) > 1} for p in ps}, lambda p, r: state.__setitem__(p, state[p] + (p == 1)), [1, 2, 7], excluded={7})
    assert clean == {1: True, 2: False}
    dp = P.document_plan({"glossary": {"bank": "B", "ghost": "G"}, "keep": [1, 99, True], "page_strategy": {"0": "batch", "1": "batch"}}, 5, "a bank", ["normal", "scan"])
    assert dp.glossary == {"bank": "B"} and dp.keep == {1} and dp.page_strategy == {0: "batch"} and len(dp.dropped) == 4


def test_streaming_twins(spark, tmp_path):
    rows = [(i, i % 3, f"t{i}") for i in range(30)]
    src = tmp_path / "src"
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "seq long, k long, text string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("seq long, k long, text string").option("maxFilesPerTrigger", 1).parquet(str(src))
    append_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = newest(spark.read.parquet(str(tmp_path / "out")), ["k"], "seq").collect()
    assert {r.k: r.text for r in got} == {0: "t27", 1: "t28", 2: "t29"}
    q = op_budget_stream(stream, "k", 4).writeStream.format("memory").queryName("budget").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.k: r.steps for r in spark.sql("select k, max(steps) as steps from budget group by k").collect()}
    assert last == {0: 10, 1: 10, 2: 10}
    assert op_budget(spark.createDataFrame(rows, "seq long, k long, text string"), "k", ["seq"], 4).where("allowed").count() == 12


def test_large_groups_take_linear_time(spark):
    """One document of 60,000 lines, and one page of as many boxes."""
    import time

    rows = spark.range(60_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("block_id"), F.col("id").cast("int").alias("item_no"), F.lit("some text of a line").alias("text"), F.lit(1).alias("group_id"), F.lit(True).alias("joinable"), (F.col("id") * 10.0).alias("y0"), (F.col("id") * 10.0 + 8).alias("y1"))
    began = time.time()
    assert S.request_batches(rows).agg(F.max("batch_no")).first()[0] == 60_000 // 25 - 1
    assert S.prose_units(rows).agg(F.max("unit_no")).first()[0] == -(-60_000 // 120) - 1
    assert S.cluster_rows(rows, ["doc_id"]).agg(F.max("row_id")).first()[0] == 59_999
    assert time.time() - began < 60


def test_glossary_by_automaton_and_by_join(spark):
    docs = spark.createDataFrame([(1, "the net interest margin rose in the quarter", "a margin"), (2, "net", "x"), (3, None, "y"), (4, "", "z"), (5, "interest margin, the net interest margin", "die Zinsspanne")], "doc_id int, text string, target string")
    terms = spark.createDataFrame([("net interest margin", "Zinsspanne"), ("net", "netto"), ("interest margin, the net interest", "q"), ("", "q"), ("quarter", ""), ("absent", "q"), ("net", "netto")], "source string, target string")
    want = {(1, "net interest margin", "Zinsspanne"), (1, "net", "netto"), (2, "net", "netto"), (5, "net", "netto"), (5, "interest margin, the net interest", "q")}
    for most in (1 << 20, 0):
        got = J.glossary_missing(docs, terms, most=most).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_translation_groups_follow_the_rows(spark):
    todo = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("block_hash"), F.concat(F.lit("text "), "id").alias("text"))
    seen = translate.translate_todo(todo, translate.echo, "en", groups=2, group_rows=50)
    assert seen.count() == 500 and seen.where("error is not null").count() == 0


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 90), st.booleans()), min_size=1, max_size=6))
@settings(max_examples=5, deadline=None)
def test_column_widths_as_aggregates(spark, columns):
    """The aggregates give what the list form gives."""
    want = L.rebalanced([float(w) for w, _, _ in columns], [float(x) for _, x, _ in columns], [f for _, _, f in columns])
    df = spark.createDataFrame([("t", i, float(w), float(x), f) for i, (w, x, f) in enumerate(columns)], "t string, col int, width double, demand double, numeric boolean")
    got = [r.new_width for r in L.rebalanced_columns(df, ["t"]).orderBy("col").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
