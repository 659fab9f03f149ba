import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from common import DOCS, odd_rows, table, with_clashes
from pyspark.sql import functions as F

from blockloom.llm import html_extract as H
from blockloom.llm import language_id as L
from blockloom.llm import media_columns as M
from blockloom.llm import quality as Q

ROWS = odd_rows(3)
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [64, 128, 192, 16384, 16384 + 64, 16384 * 8, 16384 * 9 + 64])
def test_transport_stream_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = M.mux(payload)
    got = M.demux(media)
    assert got.payload == payload and got.continuity_errors == 0 and got.pid == M.ES_PID
    assert got.timestamps == [k * M.TICKS for k in range(-(-n // M.UNIT))]
    assert len(got.random_access) == -(-n // (M.UNIT * M.GROUP))
    assert len(media) % M.PACKET == 0


def test_every_short_length_and_stuffing():
    for n in range(1, 700):
        assert M.demux(M.mux(b"\xff" * n)).payload == b"\xff" * n


def test_broken_streams():
    media = M.mux(bytes(range(256)) * 200)
    lost = media[: 188 * 10] + media[188 * 11 :]
    assert M.demux(lost).continuity_errors == 1
    for bad in (b"", b"x" * 188, media[:-1], media[376:], media[:10] + b"\0\0" + media[12:]):
        with pytest.raises((ValueError, StopIteration)):
            M.demux(bad)


def test_repeated_packets_and_announced_breaks():
    payload = bytes(range(256)) * 200
    media = M.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    own = [k for k, x in enumerate(packets) if (x[1] & 0x1F) << 8 | x[2] == M.ES_PID]
    twice = M.demux(b"".join([*packets[: own[5] + 1], packets[own[5]], *packets[own[5] + 1 :]]))
    assert twice.payload == payload and twice.continuity_errors == 0
    assert M.demux(b"".join([*packets[: own[5] + 1], packets[own[5]], packets[own[5]], *packets[own[5] + 1 :]])).continuity_errors == 1
    head = next(k for k in own if k > own[0] and packets[k][3] & 0x20 and packets[k][4])
    marked = bytearray(packets[head])
    marked[5] |= 0x80
    broken = [*packets[: head - 1], *packets[head:]] if head - 1 in own else [*packets[:head], *packets[head:]]
    broken[broken.index(packets[head])] = bytes(marked)
    assert M.demux(b"".join(broken)).continuity_errors == 0


def test_media_columns(spark):
    got = M.read_media(M.store_media(with_clashes(table(spark, ROWS)))).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.error is None and r.continuity_errors == 0 for r in got)
    broken = M.read_media(spark.createDataFrame([(1, 2, b"zz"), (2, 0, None)], "doc_id long, n_bytes long, media binary")).collect()
    assert all(r.error for r in broken)
    assert M.read_media(M.store_media(spark.createDataFrame([], DOCS))).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site">Site header text, long enough to look like prose. It goes on and on.</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies, dear reader. Please agree, it is good for you, and for us, too.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>text, with&nbsp;commas, and a<br>break. Long enough to count as content, surely.<p>Un&eacute;nclosed paragraph, also long. It has &lt;marks&gt;.
<p>Short.</p><!-- no <p>comment</p> --><ul><li>Item one, in the article</ul><div class="comments"><p>A reader says: this is long, and it has commas, too. Really.</p></div><form><p>Name, please, and address.</p></form></article>
<aside>Side, text, with, many, commas, and, words. More of it. And more.</aside><footer>&copy; Foot, text. All rights, none left.</footer></body></html>"""


def test_main_text():
    want = "Head & line First boldtext, with commas, and a break. Long enough to count as content, surely. Unénclosed paragraph, also long. It has <marks>. Short. Item one, in the article"
    assert H.main_text(PAGE) == want
    assert H.main_text(PAGE.replace("article>", "div>")) == want
    for empty in (None, "", "<p>", "<html><body><nav>x</nav></body></html>", "<!-- open"):
        assert H.main_text(empty) == ""
    assert H.main_text("just text & more < 5") == "just text & more < 5"
    assert H.main_text("<p>a<p>b") == "a b"


PROSE = "<p>A long paragraph of an article, with commas, and a full stop. It says a lot, and then, some more.</p>"


def test_names_remove_no_main_text():
    want = H.main_text(f"<article><h1>Title</h1>{PROSE * 4}</article>")
    assert want.startswith("Title A long") and want.count("full stop") == 4
    for around in ('<div class="layout has-sidebar">', '<div id="search-result-page">', "<form>"):
        assert H.main_text(f"{around}<article><h1>Title</h1>{PROSE * 4}</article>") == want
    assert H.main_text(f'<article><div class="article-header"><h1>Title</h1><p>By me</p></div>{PROSE * 4}</article>') == want
    assert H.main_text(f'<div class="x"><h1>Title</h1>{PROSE * 4}</div><div class="comments">{PROSE}</div>') == want


def test_paths_decide_node_by_node():
    whole = H.main_text(f"<article>{PROSE * 12}</article>")
    offers = '<div class="k9">' + "<div>Buy now</div>" * 12 + "</div>"
    assert H.main_text(f"<article>{PROSE * 6}{offers}{PROSE * 6}</article>") == whole
    assert H.main_text(f'<div id="one">{PROSE * 11}</div><div id="two">{PROSE}</div>') == whole


def test_pages_against_their_articles(spark):
    """Brute force on the given pages: what stands between the article's tags, tags taken out."""
    import html
    import re

    def brute(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)
        body = re.sub(r"<!--.*?-->", "", inner[1], flags=re.S) if inner else ""
        body = re.sub(r"</?(b|i|a|em|strong|span)\b[^>]*>", "", body)
        return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: brute(r.html or "") for r in pages.collect()}
    assert {r.page_id: r.text for r in H.extract(pages.withColumn("TEXT", F.lit(1))).collect()} == want
    assert H.extract(pages.limit(0)).collect() == []


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.op3_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_of_odd_rows(spark):
    model = L.fit(with_clashes(table(spark, ROWS)), ~L.held_out(F.col("doc_id")))
    got = L.predict(with_clashes(table(spark, ROWS)), model, ("source", "text")).collect()
    assert len(got) == len(ROWS)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    none = L.fit(spark.createDataFrame([], DOCS), F.lit(True))
    assert {r.lang_pred for r in L.predict(table(spark, ROWS), none).collect()} == {"und"}
    assert L.predict(spark.createDataFrame([], DOCS), model).collect() == []


def test_hierarchy_and_votes():
    rng = random.Random(4)
    alphabets = {"en": "abcde", "de": "abcdx", "fr": "klmno", "es": "klmnz", "xx": "uvwyt"}
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30))
    model = L.train([(k, L.features(make(a))) for k, a in alphabets.items() for _ in range(30)])
    assert set(model.families) == {"germanic", "romance", "=xx"} and set(model.pair_weights) == {("de", "en"), ("es", "fr")}
    texts = [(k, make(a)) for k, a in alphabets.items() for _ in range(20)]
    assert np.mean([p == k for p, (k, _) in zip(model.predict([t for _, t in texts])[0], texts, strict=True)]) > 0.95


def test_quality_against_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.op1_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.98
    assert np.mean([not r.kept for r in bad]) > 0.9


def test_quality_of_odd_rows(spark):
    docs = with_clashes(table(spark, ROWS))
    got = Q.score(docs, Q.fit(docs)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    empty = Q.fit(spark.createDataFrame([], DOCS))
    assert {r.score for r in Q.score(table(spark, [(1, None, None, None, 0), (2, " ", None, None, 0)], 1), empty).collect()} == {0.0}


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(5)
    m, counts = len(Q.LABELLERS), Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        code = 0
        for k in range(m):
            rate = 0.002 if good else 0.3 + 0.05 * k
            code = code * 3 + (1 if rng.random() < 0.2 else 0 if rng.random() < rate else 2)
        counts[code] += 1
    model = Q.expectation_maximisation(dict(counts))
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(model.rate[k, 0, 0] - (0.3 + 0.05 * k)) < 0.05 for k in range(m))


def test_votes_round_trip():
    assert all(Q.votes_of(c) == [int(x) - 1 for x in np.base_repr(c, 3).zfill(len(Q.LABELLERS))] for c in range(0, 3 ** len(Q.LABELLERS), 97))
    assert json.dumps(list(Q.LABELLERS))


def test_every_language_is_learned(spark):
    """A bound on the sample lowers the rows of each language, never the number of languages."""
    rng = random.Random(8)
    rows = [(k * 10 + i, " ".join("".join(rng.choice("abcdefghij"[k % 8 :] + chr(0x400 + k)) for _ in range(6)) for _ in range(30)), f"x{k}", "a", 0) for k in range(12) for i in range(8)]
    model = L.fit(table(spark, rows), F.lit(True), sample=8, most=24)
    assert sorted(x for langs in model.families.values() for x in langs) == sorted(f"x{k}" for k in range(12))
    nulls = [(None, r[1], r[2], "a", 0) for r in rows]
    assert len(L.fit(table(spark, nulls), F.lit(True), sample=8, most=24).families) == 12


@pytest.mark.parametrize("name", ["search-engine-history", "menu-item-article", "header-image story", "tags-explained", "notice-period-law", "comment-is-free", "post-header", "share-price-report"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_in_an_article_remove_nothing(name, tag):
    inner = f"<h1>Title</h1>{PROSE * 3}"
    page = f'<nav><a href=x>Home</a></nav><{tag}><div class="{name}">{inner}</div><p>Tail, of the article, and some more of it.</p></{tag}>'
    assert H.main_text(page) == H.main_text(f"<{tag}>{inner}<p>Tail, of the article, and some more of it.</p></{tag}>")


def test_junk_of_low_ratio_goes_from_within():
    want = H.main_text(f"<article>{PROSE * 3}</article>")
    assert H.main_text(f'<article>{PROSE * 3}<div class="k">4 Read more</div><div class="q">Click x</div></article>') == want
    assert H.main_text(f"<main><ul><li><a>Buy shoes now</a><li><a>Win cash</a></ul>{PROSE * 3}</main>") == want


def test_deep_and_unclosed_markup_takes_linear_time():
    import time

    pages = {"<a " * 100_000: "<a " * 100_000, "<div>" * 30_000 + "x": "x", "<!--" * 100_000: "", "<div>" * 30_000 + "</section>" * 30_000: "", "<header>" * 20_000 + "x": "", "<" * 300_000: "<" * 300_000}
    for page, want in pages.items():
        began = time.process_time()
        assert H.main_text(page) == " ".join(want.split())
        assert time.process_time() - began < 3
    for page in ("<a x='>' y=\"" * 20_000, "<p>" + "<span>" * 30_000 + "<div>a" * 2000, "<b>x" * 30_000, "<p>" + "word <b>bold</b> " * 20_000, '<a "' * 50_000 + ">", "<div>x " * 30_000):
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 5
