import hashlib
from collections import Counter

import corpus_pipeline as P
from common import DOCS, odd_rows, table, with_clashes
from test_dedup import brute_near

from blockloom.llm import packing
from blockloom.llm.shared import stored


def test_stages_against_plain_versions(spark, tmp_path):
    rows = odd_rows(6)
    docs = with_clashes(table(spark, rows))
    outs = []
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        if name != "packing":
            assert tuple(docs.columns) == P.COLUMNS
        outs.append(docs.collect())
    lang, exact, near, mixed, packed = outs
    assert Counter((r.doc_id, r.text) for r in lang) == Counter((r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    best = {}
    for r in lang:
        best[r.text] = min((x for x in (best.get(r.text), r.doc_id) if x is not None), default=None)
    assert Counter((r.doc_id, r.text) for r in exact) == Counter((i, t) for t, i in best.items())
    kept = {i for (i, _, c), n in brute_near([tuple(r) for r in exact], 5, 80).items() if i == c}
    assert {r.doc_id for r in near} == kept
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, near))
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_language_stage_rejects_languages_that_were_not_learned(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*P.COLUMNS)
    foreign = [
        "To jest tekst po polsku, który opowiada o historii miasta i jego mieszkańcach, a także o rzece.",
        "Tämä on suomenkielinen teksti, joka kertoo kaupungin historiasta ja sen asukkaista sekä joesta.",
        "Это русский текст о городе, его истории и людях, которые в нём живут.",
        "xqzj wvkq zzxq jjkw qxzv kkjw vvqx zjjq wxkq qqzv jxkw zvqq kxjz",
    ]
    docs = clean.unionByName(spark.createDataFrame([(-1 - i, t, None, "a", 0) for i, t in enumerate(foreign)], DOCS))
    kept = {r.doc_id for r in P.language_stage(spark, docs, "").collect()}
    assert kept == {r.doc_id for r in clean.collect()}


def test_sequences_follow_the_mix(spark, monkeypatch):
    """Of 1,500 documents, 1,000 are from a, 400 from b and 100 from c; by their square roots, the shares are 0.513, 0.325 and 0.162
    until c ends. Two rows in five of a and one in four of b have no id, so that of the rows with one, which are told
    apart here, the shares are 0.432, 0.342 and 0.227."""
    monkeypatch.setattr(packing, "EACH", 100)
    rows = [(i if i % 3 else None, f"text {i} " + "word " * (300 + i * 7919 % 1700), "en", "aaaaaaaaaabbbbc"[i % 15], 0) for i in range(1500)]
    mixed = stored(P.mixing_stage(spark, table(spark, rows), ""), "test-mixed")
    assert Counter(map(tuple, mixed.collect())) == Counter(rows)
    packed = P.packing_stage(spark, mixed, "").collect()
    place = {r.text: r.position for r in P._positions(mixed).collect()}
    assert sorted(place.values()) == list(range(1500))
    source, position = {r[0]: r[3] for r in rows}, {r[0]: place[r[1]] for r in rows}
    got = sorted((r for r in packed if r.doc_id is not None), key=lambda r: (r.sequence_id, r.offset))
    assert len(packed) == 1500 and [position[r.doc_id] // 100 for r in got] == sorted(position[r.doc_id] // 100 for r in got)
    first = Counter(source[r.doc_id] for r in got[:360])
    assert abs(first["c"] / 360 - 0.227) < 0.04 and abs(first["b"] / 360 - 0.342) < 0.06
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.ROOM and sorted(used) == list(range(len(used)))


def test_run_is_whole(spark, tmp_path):
    rows = [(i, f"document number {hashlib.sha256(bytes([i])).hexdigest()} about things {i}", "en", "a", 0) for i in range(40)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == set(range(40))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).collect() == []
