import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.api import Session
from blockloom.operators import raster as R
from blockloom.operators import translate as T


def test_translation_seam(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["hello there", "bad one", "hello there", "12", "keep me"])], "doc_id string, block_id int, text string")
    cache = spark.createDataFrame([], "block_hash string, text string")

    def fn(texts, *, lang, glossary):
        if "bad one" in texts:
            raise ValueError("no")
        return T.echo(texts, lang=lang, glossary=glossary)

    done, made = T.translate_blocks(df, cache, fn, "English", F.col("block_id") == 4, {"there": "THERE"})
    assert {r.block_id: r.target for r in done.collect()} == {0: "MOCK:hello THERE", 1: "bad one", 2: "MOCK:hello THERE", 3: "MOCK:12", 4: "keep me"}
    assert made.count() == 3 and [r.error for r in made.where("error is not null").collect()] == ["ValueError: no"]
    assert T.retranslate(["a", "bad one"], fn, "x") == ["MOCK:a", "bad one"]
    assert T.call(lambda t, **k: t[:1], ["a", "b"], "", {}) == [("a", None), ("b", None)]
    with pytest.raises(T.Fatal):
        T.call(lambda t, **k: (_ for _ in ()).throw(T.Fatal("key")), ["a"], "", {})
    units = spark.createDataFrame([("d", 0, [4, 5], ["12345", "123456789"], "abcdefgh WXYZQ")], "doc_id string, unit int, block_ids array<int>, sources array<string>, target string")
    got = {r.block_id: r.target.strip() for r in T.distribute_units(units, ["doc_id", "unit"]).collect()}
    assert got == {4: "abcdefgh", 5: "WXYZQ"} or " ".join(got[k] for k in (4, 5)).split() == ["abcdefgh", "WXYZQ"]


def test_session(spark):
    rows = [("d", p, i, p * 3 + i, t, 10.0, 20.0 * i, 200.0, 20.0 * i + 12) for p in range(2) for i, t in enumerate(["A heading line", "Revenue was 1,234.56", "1,234.56"])]
    s = Session(spark.createDataFrame(rows, "doc_id string, page_no int, local_no int, block_id int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert s.doc_info().first().text_pages == 2 and s.layout_grid().count() == 6
    assert not s.audit()["clean"]
    run = s.run_flow("translate_normal", pages=[0, 1])
    assert not run.error and run.results["audit_pages"]["clean"]
    assert s.set_text("d", 1, "Revenue was 9,999.99") and not s.set_text("d", 2, "0") and not s.set_text("d", 99, "x")
    report = s.audit([0])
    assert not report["clean"] and {r.check for r in report["findings"].collect()} == {"numbers"}
    assert s.set_text("d", 1, "Revenue was 1,234.56 now") and s.audit([0])["clean"]
    assert not s.audit([7])["clean"] and not s.audit([0], "numbres")["clean"]
    assert "now" in s.export("text").first().text and s.export("markdown").count() == 1
    assert s.delete_block("d", 1) and "now" not in s.export("text").first().text
    assert s.page_blocks(1).count() == 3


def test_raster(spark):
    page = np.full((60, 120), 230, np.uint8)
    page[10:13, 10:90] = 20
    page[30:38, 20:60:2] = 30
    mask = R.ink(page.astype(float))
    assert R.bands(mask) == [(10, 13), (30, 38)]
    assert [(y, a, b) for y, a, b in R.rules(mask, 60)] == [(10, 10, 90)]
    assert R.runs(np.array([0, 1, 1, 0, 1], bool)) == [(1, 3), (4, 5)] and R.skew(mask) == 0.0
    tilted = np.zeros((80, 200), bool)
    for x in range(200):
        tilted[40 + round(x * np.tan(np.radians(2)))] [x] = True
    assert abs(R.skew(tilted) - 2) <= 0.5
    df = spark.createDataFrame([(1, 120, 60, page.tobytes())], "page_no int, width int, height int, pixels binary")
    assert [list(b) for b in R.page_marks(df, ["page_no"]).first().bands] == [[10, 13], [30, 38]]
