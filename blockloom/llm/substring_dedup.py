"""Substring dedup by a log-structured index of window fingerprints.

A window is `span` consecutive words. Every batch of texts is turned into immutable runs: per hash
range, the sorted distinct 128-bit fingerprints of its windows, each with a flag for "more than once
in the batch". FingerprintIndex.judge() merge-joins the runs of a range, the new ones with each other and with
the compacted ones of earlier tables; a fingerprint that two runs hold, or that one run flags, is
repeated, and the answer goes back to each batch as one bit per fingerprint. take() compacts the runs of a
range and those before them into one, so that the index can judge further tables. A fingerprint's first half is made of the
hashes of words: it sorts and finds. Its second half verifies: it is a hash of the words' bytes
themselves, joined by one space, and doesn't depend on the first. Both must agree.

Within a table not every window has to travel. The least hash among the `anchor`-word grams of a
window (its anchor, about one word in ten is one) is the same wherever the window stands, so a first,
ten times smaller merge join of anchors finds the windows that can be repeated at all, and only texts
and windows with a repeated anchor go on.

Defined results: null text has no words; texts shorter than a window keep all; a window that repeats
within its own text counts; windows are judged on the input, so all copies go; repeated rows are
copies of each other; rows that share an id are still separate texts; an empty table gives an empty
table; columns other than doc_id and text don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import bounded_batches, discard, pick, stored

SPAN, ANCHOR = 35, 16
#: Bytes of text in a batch, and bytes of text for each hash range of anchors and of windows: the
#: number of ranges follows the input, so that a range's runs fit into a worker.
BATCH_BYTES, ANCHOR_RANGE, WINDOW_RANGE = 4 << 20, 64 << 20, 16 << 20
WORDS_KEPT = 1_000_000
_U = np.uint64
_BASE, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
RUN = "batch long, bucket long, keys binary, many binary"
MASK = "batch long, bucket long, mask binary"
_MASK = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("mask", pa.binary())])


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words; polynomial prefix sums modulo 2**64."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power = np.full(len(h) + 1, _BASE | _U(1), np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(len(h) + 1, _U(pow(int(_BASE | _U(1)), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * inverse[: len(h) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    if len(x) < n:
        return x[:0]
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Batch:
    """The words of some texts one after the other, and their windows."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, span: int):
        self.words = [t.split() for t in texts]
        self.ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        self.starts = self.ends - [len(w) for w in self.words]
        self.h = hashes.of([w for ws in self.words for w in ws])
        self.span = span
        count = max(0, len(self.h) - span + 1)
        self.doc = np.repeat(np.arange(len(texts)), [len(w) for w in self.words])
        first = np.arange(count)
        self.windows = first[self.ends[self.doc[first]] - first >= span] if count else first

    def anchors(self, n: int) -> np.ndarray:
        """The anchor's hash, and its place, for each window."""
        g = grams(self.h, n)
        low = _U((1 << 20) - 1)
        place = np.arange(len(g), dtype=np.uint64)
        least = sliding_min((g & ~low) | (place & low), self.span - n + 1)[self.windows]
        at = self.windows + ((least.astype(np.int64) - self.windows) & int(low))
        return g[at], at

    def fingerprints(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the words' hashes, and the hash of the words' bytes."""
        words = [w for ws in self.words for w in ws]
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        until = np.cumsum(size)
        first, end = (until - size)[windows].tolist(), (until[windows + self.span - 1] - 1).tolist()
        joined = memoryview(b" ".join(words))
        own = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(first, end, strict=True)), np.uint64, len(windows))
        return grams(self.h, self.span)[windows], own


def sorted_runs(first: np.ndarray, second: np.ndarray | None, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, distinct keys, flags, where): keys sorted, n x 1 or n x 2; flags tell keys that come
    more than once; where[i] is the key's number for the rows of `order` of this bucket."""
    bucket = (first >> _U(32)) % _U(buckets)
    order = np.lexsort((first, bucket)) if second is None else np.lexsort((second, first, bucket))
    a, k = first[order], bucket[order]
    b = None if second is None else second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1]) | (False if b is None else b[1:] != b[:-1])
    heads = np.flatnonzero(new)
    many = np.diff(np.append(heads, len(a))) > 1
    number = np.cumsum(new) - 1
    cuts = np.flatnonzero(np.concatenate([[True], k[heads][1:] != k[heads][:-1]])) if len(heads) else []
    for c, cut in enumerate(cuts):
        until = cuts[c + 1] if c + 1 < len(cuts) else len(heads)
        rows = slice(heads[cut], heads[until] if until < len(heads) else len(a))
        keys = a[heads[cut:until], None] if b is None else np.stack([a[heads[cut:until]], b[heads[cut:until]]], 1)
        yield int(k[heads[cut]]), keys, many[cut:until], np.stack([order[rows], number[rows] - cut])


def merge_join(runs: DataFrame, width: int, history: DataFrame | None = None) -> DataFrame:
    """For each run, one bit per key: whether the key is repeated among the runs of its bucket.
    history: compacted runs of earlier batches, that get no answer."""
    every = runs if history is None else runs.unionByName(history)

    def join(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, width) for x in table["keys"]]
        flags = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["many"]])
        joined = np.concatenate(keys)
        order = np.lexsort(joined.T[::-1])
        s = joined[order]
        same = (s[1:] == s[:-1]).all(1)
        twice = flags[order].astype(bool)
        group = np.concatenate([[0], np.cumsum(~same)])
        count = np.bincount(group)
        repeated = (count > 1) | (np.bincount(group, twice) > 0)
        answer = np.empty(len(order), bool)
        answer[order] = repeated[group]
        cuts = np.cumsum([0, *[len(k) for k in keys]])
        batch = table["batch"].to_pylist()
        own = [i for i in range(len(keys)) if batch[i] >= 0]
        return pa.table({"batch": [batch[i] for i in own], "bucket": [table["bucket"][i].as_py() for i in own], "mask": [np.packbits(answer[cuts[i] : cuts[i + 1]]).tobytes() for i in own]}, schema=_MASK)

    return every.groupBy("bucket").applyInArrow(join, MASK)


def compacted(runs: DataFrame, width: int) -> DataFrame:
    """One run per bucket (batch -1) that holds all keys, flagged where they are repeated."""

    def merge(table: pa.Table) -> pa.Table:
        joined = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(-1, width) for x in table["keys"]])
        flags = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["many"]])
        keys, number, count = np.unique(joined, axis=0, return_inverse=True, return_counts=True)
        many = (count > 1) | (np.bincount(number.ravel(), flags) > 0)
        return pa.table({"batch": pa.array([-1], pa.int64()), "bucket": [table["bucket"][0].as_py()], "keys": pa.array([keys.tobytes()], pa.binary()), "many": pa.array([many.astype(np.uint8).tobytes()], pa.binary())})

    return runs.groupBy("bucket").applyInArrow(merge, RUN)


def cut(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[tuple[int, pa.Table, list[bytes]]]:
    """(batch number, rows, texts) of about `size` bytes of text in column 2; one text at least."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
        at, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= size or i + 1 == len(texts):
                yield (part << 32) + k, batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, held, k = i + 1, 0, k + 1


ANCHORS = "kind int, batch long, bucket long, keys binary, many binary, key_of binary, row_of binary, ids array<long>, n_words binary, sha256 binary"
_ANCHORS = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int64()), *[(n, pa.binary()) for n in ("keys", "many", "key_of", "row_of")], ("ids", pa.list_(pa.int64())), ("n_words", pa.binary()), ("sha256", pa.binary())])


def anchor_runs(span: int, anchor: int, buckets: int):
    """From rows (row, doc_id, text). kind 0: a batch's rows with word counts and digests of all words; kind 1: a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for number, rows, texts in cut(batches):
            b = Batch(texts, hashes, span)
            names = np.array(rows.column(0).to_numpy(zero_copy_only=False), np.int64)
            out = [{"kind": 0, "batch": number, "row_of": names.tobytes(), "ids": rows.column(1).to_pylist(), "n_words": (b.ends - b.starts).tobytes(), "sha256": b"".join(hashlib.sha256(b" ".join(w)).digest() for w in b.words)}]
            found, at = b.anchors(anchor)
            at, where = np.unique(at, return_index=True)
            found, doc = found[where], b.doc[at]
            for bucket, keys, many, (row, key) in sorted_runs(found, None, buckets):
                pair = np.unique(np.stack([key, doc[row]]), axis=1)
                out.append({"kind": 1, "batch": number, "bucket": bucket, "keys": keys.tobytes(), "many": many.astype(np.uint8).tobytes(), "key_of": pair[0].astype(np.uint32).tobytes(), "row_of": names[pair[1]].tobytes()})
            yield pa.RecordBatch.from_pylist(out, _ANCHORS)

    return run


def repeated_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, its repeated anchors) from runs with their answers."""
    for batch in batches:
        names, data = [], []
        for keys, key_of, row_of, mask in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            keys, key_of, row_of = np.frombuffer(keys, np.uint64), np.frombuffer(key_of, np.uint32), np.frombuffer(row_of, np.int64)
            hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(keys)).astype(bool)[key_of]
            order = np.argsort(row_of[hit], kind="stable")
            own, rows = keys[key_of[hit]][order], row_of[hit][order]
            for part in np.split(np.arange(len(rows)), np.flatnonzero(rows[1:] != rows[:-1]) + 1):
                if len(part):
                    names.append(int(rows[part[0]]))
                    data.append(own[part].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], ["row", "anchors"])


GROUPS = "batch long, ids array<long>, texts array<binary>, anchors binary"
_GROUPS = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())), ("anchors", pa.binary())])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a batch: its ids, texts and the union of its texts' repeated anchors."""
    for number, rows, texts in cut(batches):
        anchors = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for a in rows.column(3).to_pylist() for x in a])) if rows.num_columns > 3 else None
        yield pa.RecordBatch.from_pylist([{"batch": number, "ids": rows.column(1).to_pylist(), "texts": texts, "anchors": None if anchors is None else anchors.tobytes()}], _GROUPS)


def chosen(b: Batch, anchors: bytes | None, anchor: int) -> np.ndarray:
    """The windows that go on: those with a repeated anchor, or all of them."""
    if anchors is None:
        return b.windows
    return b.windows[np.isin(b.anchors(anchor)[0], np.frombuffer(anchors, np.uint64))]


def window_runs(span: int, anchor: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for number, texts, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = Batch(texts, hashes, span)
                own = chosen(b, anchors, anchor)
                out = [{"batch": number, "bucket": bucket, "keys": keys.tobytes(), "many": many.astype(np.uint8).tobytes()} for bucket, keys, many, _ in sorted_runs(*b.fingerprints(own), buckets)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())]))

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string"


def remover(span: int, anchor: int, buckets: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for ids, texts, anchors, answers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                b = Batch(texts, hashes, span)
                own = chosen(b, anchors, anchor)
                masks = {x["bucket"]: x["mask"] for x in answers or []}
                hit = np.zeros(len(own), bool)
                for bucket, keys, _, (row, key) in sorted_runs(*b.fingerprints(own), buckets):
                    hit[row] = np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=len(keys)).astype(bool)[key]
                step = np.zeros(len(b.h) + 1, np.int64)
                np.add.at(step, own[hit], 1)
                np.add.at(step, own[hit] + span, -1)
                keep = np.cumsum(step)[:-1] == 0
                out = {"doc_id": ids, "n_words": (b.ends - b.starts).tolist(), "n_removed": [], "kept": [], "kept_sha256": []}
                for words, s, e in zip(b.words, b.starts.tolist(), b.ends.tolist(), strict=True):
                    flags = keep[s:e]
                    left = b" ".join(words if flags.all() else [w for w, k in zip(words, flags.tolist(), strict=True) if k])
                    out["n_removed"].append(int(e - s - flags.sum()))
                    out["kept"].append(left if with_text else None)
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())]))

    return run


def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of kind 0."""
    for batch in batches:
        for row_of, ids, n_words, digests in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row_of, np.int64)), pa.array(ids, pa.int64()), pa.array(np.frombuffer(n_words, np.int64)), pa.array([digests[at : at + 32].hex() for at in range(0, len(digests), 32)], pa.string())], ["row", "doc_id", "n_words", "kept_sha256"])


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, kept): all words of a text."""
    for batch in batches:
        kept = [b" ".join((t or "").encode("utf-8", "surrogatepass").split()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(k.split()) for k in kept], pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "kept", "kept_sha256"])


def ranges(total: int | None, each: int) -> int:
    return max(16, -(-(total or 0) // each))


class FingerprintIndex:
    """Incremental use: add() judges a table against all earlier ones and itself, then takes it in. total: bytes of
    text that it is to hold, by which the number of hash ranges is set, once and for all."""

    def __init__(self, spark: SparkSession, span: int = SPAN, anchor: int = ANCHOR, total: int = 0):
        self.spark, self.span, self.anchor = spark, span, anchor
        self.anchor_ranges, self.window_ranges = ranges(total, ANCHOR_RANGE), ranges(total, WINDOW_RANGE)
        self.anchors: DataFrame | None = None
        self.windows: DataFrame | None = None

    def _rows(self, docs: DataFrame) -> DataFrame:
        """(row, doc_id, text); row tells rows apart that differ in id or text."""
        return pick(docs, "doc_id", "text").select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def _anchor_runs(self, texts: DataFrame) -> DataFrame:
        return stored(texts.mapInArrow(anchor_runs(self.span, self.anchor, self.anchor_ranges), ANCHORS), "anchor-runs")

    def _judged(self, texts: DataFrame, first: DataFrame, with_text: bool) -> DataFrame:
        runs = first.where("kind = 1").select("batch", "bucket", "keys", "many", "key_of", "row_of")
        answers = stored(merge_join(runs.select("batch", "bucket", "keys", "many"), 1, self.anchors), "anchor-answers")
        hits = runs.join(answers, ["batch", "bucket"]).select("keys", "key_of", "row_of", "mask").mapInArrow(repeated_of, "row long, anchors binary")
        # A row's anchors come in one piece for each range; those of rows that are the same are the same.
        hits = stored(hits.groupBy("row").agg(F.collect_set("anchors").alias("anchors")), "anchor-hits")
        groups = stored(texts.join(hits, "row").select("row", "doc_id", "text", "anchors").mapInArrow(grouped, GROUPS), "groups")
        windows = groups.select("batch", "texts", "anchors").mapInArrow(window_runs(self.span, self.anchor, self.window_ranges), RUN)
        bits = stored(merge_join(windows, 2, self.windows), "window-answers")
        per_batch = bits.groupBy("batch").agg(F.collect_list(F.struct("bucket", "mask")).alias("answers"))
        changed = groups.join(per_batch, "batch", "left").select("ids", "texts", "anchors", "answers").mapInArrow(remover(self.span, self.anchor, self.window_ranges, with_text), KEPT)
        names = hits.select("row")
        if with_text:
            rest = texts.join(names, "row", "left_anti").select("row", "doc_id", "text").mapInArrow(whole, "doc_id long, n_words long, kept binary, kept_sha256 string")
        else:
            rest = first.where("kind = 0").select("row_of", "ids", "n_words", "sha256").mapInArrow(untouched, "row long, doc_id long, n_words long, kept_sha256 string")
            rest = rest.join(names, "row", "left_anti").withColumn("kept", F.lit(None).cast("binary"))
        return changed.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept", "kept_sha256"))

    def judge(self, docs: DataFrame, with_text: bool = True) -> DataFrame:
        """doc_id, n_words, n_removed, kept (the words that stay, UTF-8; null without with_text), kept_sha256."""
        bounded_batches(self.spark)
        texts = self._rows(docs)
        return self._judged(texts, self._anchor_runs(texts), with_text)

    def take(self, docs: DataFrame) -> None:
        """Takes a table in: its runs, of all its windows, and the compacted ones become one run per range."""
        bounded_batches(self.spark)
        texts = self._rows(docs)
        groups = texts.mapInArrow(grouped, GROUPS).select("batch", "texts", "anchors")
        new = {"anchors": (self._anchor_runs(texts).where("kind = 1").select("batch", "bucket", "keys", "many"), 1), "windows": (groups.mapInArrow(window_runs(self.span, self.anchor, self.window_ranges), RUN), 2)}
        for name, (runs, width) in new.items():
            old = getattr(self, name)
            setattr(self, name, stored(compacted(runs if old is None else runs.unionByName(old), width), f"index-{name}"))
            if old is not None:
                discard(old)

    def add(self, docs: DataFrame) -> DataFrame:
        """judge(), then take()."""
        out = stored(self.judge(docs), "index-judged")
        self.take(docs)
        return out


def substring_dedup(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (see the module): one table, judged by an index
    without history."""
    total = pick(docs, "text").agg(F.sum(F.octet_length("text"))).first()[0]
    out = FingerprintIndex(docs.sparkSession, span, anchor, total or 0).judge(docs, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Windows as texts, put together by doubling; removed are the words that a repeated window starts at or up to 34 words before.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
w2 AS (SELECT *, word || ' ' || lead(word) OVER (PARTITION BY r ORDER BY i) AS t2 FROM p),
w4 AS (SELECT *, t2 || ' ' || lead(t2, 2) OVER (PARTITION BY r ORDER BY i) AS t4 FROM w2),
w8 AS (SELECT *, t4 || ' ' || lead(t4, 4) OVER (PARTITION BY r ORDER BY i) AS t8 FROM w4),
w16 AS (SELECT *, t8 || ' ' || lead(t8, 8) OVER (PARTITION BY r ORDER BY i) AS t16 FROM w8),
w35 AS (SELECT r, i, word, t16 || ' ' || lead(t16, 16) OVER w || ' ' || lead(t2, 32) OVER w || ' ' || lead(word, 34) OVER w AS t35 FROM w16 WINDOW w AS (PARTITION BY r ORDER BY i)),
marked AS (SELECT r, i, word, t35 IS NOT NULL AND count(*) OVER (PARTITION BY t35) > 1 AS again FROM w35),
covered AS (SELECT r, i, word, max(again::INTEGER) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM marked),
out AS (SELECT r, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN out USING (r)
"""
