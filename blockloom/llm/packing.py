"""Pattern packing by non-negative least squares.

Token lengths form a histogram of at most `room` entries, whatever the number of documents. On a
grid of coarse lengths (rounded up), all patterns of two or three documents that fill a sequence
are enumerated, and non-negative least squares fits how often each pattern is repeated so that the
patterns use up the histogram. The counts are rounded down, patterns are realised with exact lengths,
and the residual documents go best-fit into the gaps of those sequences or open new ones. All that
happens on the histogram and gives a plan of (length, rank interval) -> (first sequence, offset);
documents find their place by their rank among those of their length.

pack_in_order() packs consecutive ranges of a given order, each by a plan of its own; ranks follow
the order, and sequences are numbered range after range, in a range by the first of their pieces.

Defined results: null text is empty text and still has its closing id; a document longer than a
sequence, and only such a one, is cut into full pieces and a shorter last one; repeated rows and
null ids are packed like any row; an empty table gives an empty table; other columns don't count.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.shared import bounded_batches, parted, pick, ranked, stored, table_of

ROOM = 4096
#: Coarse lengths are multiples of this many tokens.
GRID = 64
#: Words whose ids a worker remembers; bounds its memory.
CACHE = 500_000
#: Bytes of text that are tokenized at once.
CHUNK = 1 << 20
#: Documents of a range that is packed by itself where an order is given.
EACH = 8192


def _byte_alphabet() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


BYTE_ALPHABET = _byte_alphabet()
#: Words whose characters normalisation only lower-cases and that have no contraction, and how they are cut:
#: runs of letters, single digits, runs of other marks.
PLAIN = re.compile(r"[!-&(-~ªµºÀ-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"[^\W\d_]+|\d|[\W_]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "len bigint,lo bigint,hi bigint,seq0 bigint,offset bigint"


class WordIds(dict):
    """Word (bytes without ASCII white space) -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space, lower-cases, and never joins what white space separates, so a
    text's ids are its words' ids one after the other. Texts with the mark of special tokens are left
    to the tokenizer as a whole. Words are remembered in two generations of cache / 2."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.half = Tokenizer.from_file(path), cache // 2
        self.old: dict[bytes, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.as_bytes = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]

    @staticmethod
    @functools.cache
    def shared(path: str) -> WordIds:
        """One for all tasks of a worker process."""
        return WordIds(path)

    def learn(self, missing: list[bytes]) -> None:
        """Words of plain characters are cut as the tokenizer cuts them, and each piece goes to its model,
        byte by byte in the model's alphabet; all others go through the whole tokenizer."""
        new = list(dict.fromkeys(missing))
        if len(self) + len(new) > self.half:
            self.old = dict(self)
            self.clear()
        others = []
        for w in new:
            if (ids := self.old.get(w)) is not None:
                self[w] = ids
            elif w.isalpha():
                self[w] = self.model_ids(w.decode())
            elif PLAIN.fullmatch(s := w.decode()):
                self[w] = b"".join([self.piece(p) for p in PIECE.findall(s.lower())])
            else:
                others.append(w)
        for at in range(0, len(others), 1000):
            part = others[at : at + 1000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.update(zip(part, [np.array(e.ids, "<u4").tobytes() for e in found], strict=True))

    def model_ids(self, piece: str) -> bytes:
        return b"".join([self.as_bytes[t.id] for t in self.tokenize(piece)])

    def piece(self, text: str) -> bytes:
        key = text.encode()
        ids = self.get(key)
        if ids is None:
            ids = self[key] = self.model_ids(key.decode("latin-1").translate(BYTE_ALPHABET))
        return ids

    def encode(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text, in parts."""
        if b"<|" in text:
            yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        at = 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                end = cut if cut > at else len(text)
            words = text[at:end].lower().split()
            ids = list(map(self.get, words))
            if None in ids:
                self.learn([w for w, i in zip(words, ids, strict=True) if i is None])
                ids = [self[w] if i is None else i for w, i in zip(words, ids, strict=True)]
            yield b"".join(ids)
            at = end


def tokenized_pieces(tokenizer: str, room: int, last_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = WordIds.shared(tokenizer)
        end = np.array([last_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            rows: list[int] = []
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, name in enumerate(names):
                text = (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
                data = b"".join([*ids.encode(text), end])
                for piece, at in enumerate(range(0, len(data), 4 * room)):
                    part = data[at : at + 4 * room]
                    for column, x in zip(out, (name, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
                    rows.append(k)
            passing = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]], *passing], ["doc_id", "piece", "start", "length", "ids_crc32", *batch.schema.names[2:]])

    return run


def nnls(a: np.ndarray, b: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min || W (a x - b) ||, x >= 0, by accelerated projected gradient steps."""
    a, b = a * weight[:, None], b * weight
    if not a.shape[1]:
        return np.zeros(0)
    v = np.ones(a.shape[1])
    for _ in range(30):  # the largest eigenvalue of a'a
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(a @ v) ** 2 * 1.02)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def patterns(cells: int) -> list[tuple[int, ...]]:
    """Two or three coarse lengths, longest first, that fill a sequence of `cells` grid cells."""
    two = [(a, cells - a) for a in range(cells - 1, 0, -1) if a >= cells - a]
    three = [(a, b, cells - a - b) for a in range(cells - 2, 0, -1) for b in range(min(a, cells - a - 1), 0, -1) if 0 < cells - a - b <= b]
    return two + three


class Plan:
    """Sequences as groups of equals: (gap, contents, how many); contents are exact lengths."""

    def __init__(self, counts: dict[int, int], room: int):
        self.left, self.room = dict(counts), room
        self.groups: dict[tuple[int, ...], int] = defaultdict(int)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def filler(self, stock: list[int], own: list[int]) -> int | None:
        """The greatest length that is left and goes into what `own` leaves free. stock: ascending
        lengths; those used up are dropped when met."""
        at = bisect.bisect_right(stock, self.room - sum(own)) - 1
        while at >= 0:
            if stock[at] not in self.left:
                del stock[at]
            elif self.left[stock[at]] > own.count(stock[at]):
                return stock[at]
            at -= 1
        return None

    def fit(self, grid: int) -> None:
        """Patterns by least squares, realised with exact lengths, longest of a coarse length first."""
        cells = self.room // grid
        coarse: dict[int, list[int]] = defaultdict(list)
        for length in sorted(self.left, reverse=True):
            if length < self.room:
                coarse[-(-length // grid)].append(length)
        found = [p for p in patterns(cells) if all(c in coarse for c in p)]
        if not found:
            return
        a = np.zeros((cells + 1, len(found)))
        for k, p in enumerate(found):
            for c in p:
                a[c, k] += 1
        b = np.zeros(cells + 1)
        for c, lengths in coarse.items():
            b[c] = sum(self.left[x] for x in lengths)
        weight = 0.2 + np.arange(cells + 1) / cells  # what is left over matters less where it is short
        repeats = np.floor(nnls(a, b, weight) + 1e-9).astype(int)
        stock = sorted(self.left)
        for k in sorted(range(len(found)), key=lambda k: (-max(found[k]), found[k])):
            n = int(repeats[k])
            while n > 0:
                own: list[int] = []
                for c in found[k][:-1]:
                    x = next((x for x in coarse[c] if self.left.get(x, 0) > own.count(x)), None)
                    if x is None:
                        break
                    own.append(x)
                else:  # the last one fills the gap as well as any length that is left
                    x = self.filler(stock, own)
                    if x is not None:
                        own.append(x)
                if len(own) < len(found[k]):
                    break
                m = min([n, *(self.left[x] // own.count(x) for x in own)])
                for x in own:
                    self.take(x, m)
                self.groups[tuple(sorted(own, reverse=True))] += m
                n -= m

    def rest(self) -> None:
        """Best fit, longest first: the smallest gap that holds a piece, or else a new sequence."""
        by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        for own, n in self.groups.items():
            by_gap[self.room - sum(own)][own] = n
        gaps = sorted(by_gap)
        for length in sorted(self.left, reverse=True):
            n = self.left[length]
            while n:
                at = bisect.bisect_left(gaps, length)
                if at == len(gaps):
                    each = max(1, self.room // length)
                    own, m = ((length,) * each, n // each) if n >= each else ((length,) * n, 1)
                    used = len(own) * m
                else:
                    gap = gaps[at]
                    old, there = by_gap[gap].popitem()
                    each = min(gap // length, n)
                    m = min(there, n // each)
                    if there > m:
                        by_gap[gap][old] = there - m
                    if not by_gap[gap]:
                        del by_gap[gap], gaps[at]
                    own, used = (*old, *(length,) * each), each * m
                gap = self.room - sum(own)
                if gap not in by_gap:
                    bisect.insort(gaps, gap)
                own = tuple(sorted(own, reverse=True))
                by_gap[gap][own] = by_gap[gap].get(own, 0) + m
                n -= used
        self.left = {}
        self.groups = defaultdict(int)
        for each in by_gap.values():
            self.groups.update(each)

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        """(length, lo, hi, first sequence, offset): rank r of a length in [lo, hi) is in sequence
        first + r - lo at that offset."""
        out, rank, seq = [], defaultdict(int), 0
        for own in sorted(self.groups, reverse=True):
            n, offset = self.groups[own], 0
            for length in own:
                out.append((length, rank[length], rank[length] + n, seq, offset))
                rank[length] += n
                offset += length
            seq += n
        return out


def plan_packing(counts: dict[int, int], room: int = ROOM, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    plan = Plan(counts, room)
    plan.fit(grid)
    plan.rest()
    return plan.rows()


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, last_id: int = 1, grid: int = GRID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = texts.mapInArrow(tokenized_pieces(tokenizer, room, last_id), PIECES)
    pieces = parted(made, "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    plan = table_of(spark, plan_packing(counts, room, grid), PLAN, "packing-plan")
    numbered = ranked(pieces, ["length"], "_rank", 64)
    # The plan's size depends on the room alone: a few entries for each length and pattern.
    placed = numbered.join(F.broadcast(plan), (F.col("length") == F.col("len")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq0") + F.col("_rank") - F.col("lo")).cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, seq long, offset long"


def place_range(room: int, grid: int) -> Callable[[pa.Table], pa.Table]:
    """The places of one range's pieces (with part and position)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("position", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
        by_length = np.argsort(lengths, kind="stable")
        first = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist(), strict=False))
        seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length, lo, hi, seq0, at in plan_packing(counts, room, grid):
            rows = by_length[first[length] + lo : first[length] + hi]
            seq[rows], offset[rows] = np.arange(seq0, seq0 + hi - lo), at
        _, start = np.unique(seq, return_index=True)  # the first piece of each sequence
        number = np.empty(len(start), np.int64)
        number[np.argsort(start)] = np.arange(len(start))
        return pa.table({**{c: table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part")}, "seq": number[seq], "offset": offset})

    return run


def pack_in_order(docs: DataFrame, tokenizer: str, room: int = ROOM, last_id: int = 1, grid: int = GRID, each: int | None = None) -> DataFrame:
    """As pack(), of docs with a gapless `position`: every `each` documents are packed by themselves."""
    bounded_batches(docs.sparkSession)
    texts = pick(docs, "doc_id", "text", "position").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("position").cast("long").alias("position"))
    made = texts.mapInArrow(tokenized_pieces(tokenizer, room, last_id), PIECES + ", position long")
    made = made.withColumn("part", F.floor(F.col("position") / (each or EACH)).cast("long"))
    placed = stored(made.groupBy("part").applyInArrow(place_range(room, grid), PLACED), "placed")
    # One row a range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg((F.max("seq") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq0"))
    return placed.join(starts, "part").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq0") + F.col("seq")).cast("long").alias("sequence_id"), "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
