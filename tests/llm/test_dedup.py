import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from common import DOCS, odd_rows, table, with_clashes
from pyspark.sql import functions as F

from blockloom.llm.components import components
from blockloom.llm.exact_dedup import DigestIndex, exact_dedup, may_be_in, sha256_of
from blockloom.llm.minhash import MinMax, judged, near_duplicates, shingles, text_key
from blockloom.llm.substring_dedup import FingerprintIndex, WordHashes, substring_dedup

ROWS = odd_rows()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [sha256_of, lambda t: F.substring(sha256_of(t), 1, 1)])
def test_exact_dedup(spark, keep, digest):
    """A digest of one byte collides all the time: results must be the same."""
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(i)
    pick = min if keep == "smallest" else max
    want = Counter()
    for ids in groups.values():
        stays = pick((i for i in ids if i is not None), default=None)
        want.update((i, stays, len(ids), i == stays) for i in ids)
    got = exact_dedup(with_clashes(table(spark, ROWS)), keep, digest, memtable_rows=7)
    assert Counter(tuple(r)[:4] for r in got.collect()) == want


def test_exact_dedup_by_a_join_with_the_hits(spark, monkeypatch):
    """Where filters would be too large, the result is the same."""
    import blockloom.llm.exact_dedup as m

    one = exact_dedup(table(spark, ROWS)).collect()
    monkeypatch.setattr(m.may_be_in, "__defaults__", (0,))
    assert Counter(map(tuple, exact_dedup(table(spark, ROWS)).collect())) == Counter(map(tuple, one))


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_digest_index(spark):
    index = DigestIndex(spark, memtable_rows=4)
    first = spark.createDataFrame([(hashlib.sha256(bytes([i % 10])).digest(), i) for i in range(25)], "digest binary, doc_id long")
    runs = index.append(first).collect()
    by_run = defaultdict(list)
    for r in runs:
        by_run[r.run].append(bytes(r.digest))
    assert all(d == sorted(d) and len(d) <= 4 for d in by_run.values())
    index.append(spark.createDataFrame([(hashlib.sha256(bytes([3])).digest(), 99)], "digest binary, doc_id long"))
    merged = index.compact().collect()
    assert len(merged) == 10 and sum(r.n for r in merged) == 26
    seen = index.seen(spark.createDataFrame([(hashlib.sha256(bytes([3])).digest(),), (b"x",)], "digest binary")).collect()
    assert [(r.low, r.high, r.n) for r in seen] == [(3, 99, 4)]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filters_pass_what_is_there_and_little_else(spark, n):
    held = spark.range(n).select(F.unhex(F.sha2(F.concat(F.lit("a"), "id"), 256)).alias("digest"))
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.concat(F.lit("a"), "id"), 256)).alias("digest"), "id")
    passed = {r.id for r in may_be_in(rows, held).select("id").collect()}
    assert passed >= set(range(n)) and len(passed) <= n + 200
    assert {r.id for r in may_be_in(rows, held, most=0).select("id").collect()} == set(range(n))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (7, 1)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1} | {100 + i: 100 for i in range(41)} | {500 + i: 500 for i in range(30)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_near(rows, k, percent):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    best = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            best[find(n)] = min(best.get(find(n), i), i)
    return Counter((i, len(s), best.get(find(n))) for n, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    got = near_duplicates(with_clashes(table(spark, ROWS)), k, percent, bands=48).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(ROWS, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """The residual rounds cut groups into blocks; links across blocks must be found."""
    import blockloom.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK", 400)
    got = near_duplicates(table(spark, ROWS), 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(ROWS, 3, 85)


def test_near_duplicates_of_texts_without_an_id_of_their_own(spark):
    """Distinct texts under a null or repeated id are judged one by one."""
    text = lambda k, edit="": " ".join(f"{k}word{i}" for i in range(60)) + edit
    texts = [(5, text("a")), (None, text("a", " x")), (None, text("b")), (None, text("b", " x")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("e", " x")), (8, text("d", " x")), (9, text("f"))]
    docs = table(spark, [(i, t, None, None, 0) for i, t in texts])
    got = judged(docs, 5, 80, bands=48).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(texts, 5, 80)
    by_text = {k: t for k, t in docs.select(text_key("text"), "text").collect()}
    kept = Counter((r.doc_id, by_text[r.text_key][0]) for r in got if r.kept)
    assert kept == Counter([(5, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e"), (9, "f")])
    stays = P.near_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in stays) == Counter((r.doc_id, by_text[r.text_key]) for r in got if r.kept)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()] == [(1, 0, 1, True)]


def test_min_and_max_agree_as_often_as_the_sets():
    """Both halves of a signature are equal with the probability of the similarity."""
    h, mm = WordHashes(), MinMax(64, 6)
    words = [f"t{i}" for i in range(400)]
    a = shingles(" ".join(words).encode(), 1, h)
    b = shingles(" ".join(words[:300] + [f"u{i}" for i in range(100)]).encode(), 1, h)
    same = mm.signature(a) == mm.signature(b)
    assert abs(same.mean() - 300 / 500) < 0.1
    assert abs(same[:, ::2].mean() - same[:, 1::2].mean()) < 0.15


def brute_windows(rows, span):
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[j : j + span]) for _, w in texts for j in range(len(w) - span + 1))
    out = Counter()
    for i, w in texts:
        keep = [True] * len(w)
        for j in range(len(w) - span + 1):
            if seen[tuple(w[j : j + span])] > 1:
                keep[j : j + span] = [False] * span
        kept = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out[i, len(w), keep.count(False), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substring_dedup(spark):
    rows = [*ROWS, (900, "a a " * 60, None, None, None), (901, " ".join(["b"] * 35), None, None, None), (902, " ".join(["c"] * 36), None, None, None)]
    got = substring_dedup(with_clashes(table(spark, rows)))
    assert Counter(tuple(r) for r in got.collect()) == brute_windows(rows, 35)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_fingerprint_index_takes_batches(spark):
    """Each batch is judged against itself and all earlier ones."""
    index, past = FingerprintIndex(spark, total=64 << 20), []
    for part in (ROWS[:40], ROWS[40:75], ROWS[75:]):
        seen = brute_windows([*past, *part], 35)
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in index.add(table(spark, part)).collect())
        own = Counter({k: min(v, got[k]) for k, v in seen.items()})
        assert got == +own
        assert sum(got.values()) == len(part)
        past += part


def test_word_hashes_that_collide_remove_nothing(spark, monkeypatch):
    """The second half of a fingerprint is made of the words' bytes: if all words have one hash, the result is the same."""
    import numpy as np

    from blockloom.llm.substring_dedup import Batch

    class One(dict):
        def of(self, words):
            return np.full(len(words), 7, np.uint64)

    texts = [" ".join(f"{k}{i % 7}" for i in range(50)).encode() for k in "aab"]
    b = Batch(texts, One(), 35)
    first, second = b.fingerprints(b.windows)
    assert len(set(first.tolist())) == 1
    want = [tuple(t.split()[j : j + 35]) for t in texts for j in range(16)]
    assert len(set(second.tolist())) == len(set(want))
    assert [second[0] == x for x in second] == [want[0] == w for w in want]


def test_substring_dedup_of_many_rows_without_an_id(spark):
    """Rows with a null id, and rows under one id, are texts of their own."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, f"n{i} {passage if i % 2 else ''} m{i}", None, None, None) for i in range(30)] + [(4, f"q{i} {passage}", None, None, None) for i in range(5)] + [(4, "same " * 40, None, None, None)] * 9
    got = substring_dedup(table(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_windows(rows, 35)


@pytest.mark.parametrize("name", ["op2_minmax_near_duplicates", "op5_exact_dedup", "op10_substring_dedup"])
def test_query_against_sql(spark, name):
    import duckdb

    from blockloom.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(cursor.fetchall())
