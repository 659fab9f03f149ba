"""Quality classifier by weak labels.

Overlapping heuristic labellers vote good (+1), bad (-1) or nothing (0) on every whole text. The votes
of all documents are counted by pattern (3 ** labellers patterns, however many documents), and
expectation maximisation over the patterns estimates each labeller's accuracy and the share of good
documents without any true label. The posterior of a pattern is a soft label; on a bounded sample of
documents (the `sample` smallest hashes) soft labels train a linear scorer of hashed features, which
then scores every document.

Defined results: null text, or text without a word, has no votes, score 0 and isn't kept; if all
documents get the same label the scorer gives that; repeated rows are scored alike; an empty table
gives an empty table; columns other than doc_id and text don't count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import bounded_batches, pick

WIDTH = 1 << 12
#: Documents that the scorer is trained on, at most.
SAMPLE = 4000
_LETTERS = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b >= 0x80)
_FINE = _LETTERS + b" \n\r\t.,;:'-()0123456789\"?"
#: Every byte as its kind: letters a or A, digits 0, white space, and other marks as they are.
_KIND = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 0x80 else ord("0") if 48 <= b <= 57 else 32 if b in b"\t\n\v\f\r" else b for b in range(256))
_NO_MARKS = {b: None for b in range(128) if not chr(b).isalnum()}


@dataclass
class Facts:
    """What the labellers see of a text."""

    words: int
    odd: float  # share of bytes that are neither letters, digits, white space nor plain punctuation
    distinct: float  # distinct word pairs among word pairs
    upper: float  # share of words without a lower-case letter but with two upper-case ones
    ends: float  # share of words that end a clause
    short: float  # share of words of at most three letters
    length: float  # mean length of a word
    repeats: float  # share of lines that were there before
    echoes: float  # share of words that repeat the word before
    bare: float  # share of words without a letter or digit


def facts(text: str) -> Facts:
    words = text.split()
    n = max(1, len(words))
    data = text.encode("utf-8", "surrogatepass")
    pairs = len(words) - 1
    lines = [x for x in text.split("\n") if x.strip()]
    return Facts(
        words=len(words),
        odd=len(data.translate(None, _FINE)) / max(1, len(data)),
        distinct=len(set(zip(words, words[1:], strict=False))) / pairs if pairs > 0 else 1.0,
        upper=sum(w.isupper() and len(w) > 1 for w in words) / n,
        ends=sum(w[-1] in ".,;:?" for w in words) / n,
        short=sum(len(w) <= 3 for w in words) / n,
        length=sum(map(len, words)) / n,
        repeats=1 - len(set(lines)) / len(lines) if lines else 0.0,
        echoes=sum(map(str.__eq__, words, words[1:])) / n,
        bare=sum(1 for w in words if not (w[0].isalnum() or w.translate(_NO_MARKS))) / n,
    )


def _between(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


#: Name -> vote. Short texts get fewer votes.
LABELLERS = {
    "odd marks": lambda f: 0 if f.words < 8 else _between(f.odd > 0.015, f.odd < 0.004),
    "word pairs": lambda f: 0 if f.words < 20 else _between(f.distinct < 0.3, f.distinct > 0.5),
    "capitals": lambda f: 0 if f.words < 8 else _between(f.upper > 0.25, f.upper < 0.08),
    "clauses": lambda f: 0 if f.words < 20 else _between(f.ends < 0.02 or f.ends > 0.6, 0.04 < f.ends < 0.4),
    "short words": lambda f: 0 if f.words < 20 else _between(f.short < 0.08 or f.short > 0.9, 0.15 < f.short < 0.8),
    "word length": lambda f: 0 if f.words < 20 else _between(f.length > 14 or f.length < 2, 3 < f.length < 10),
    "lines": lambda f: 0 if f.words < 20 else _between(f.repeats > 0.4, f.repeats < 0.1),
    "echoes": lambda f: 0 if f.words < 8 else _between(f.echoes > 0.15, f.echoes < 0.05),
    "bare marks": lambda f: 0 if f.words < 8 else _between(f.bare > 0.1, f.bare < 0.04),
}


def pattern(f: Facts) -> int:
    """The votes as one number in base three."""
    code = 0
    for vote in LABELLERS.values():
        code = code * 3 + vote(f) + 1
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


@dataclass
class LabelModel:
    prior: float
    #: rate[labeller, class, vote]: chance of a vote (bad, none, good) given the class (bad, good) and
    #: that the labeller votes; it is 1 where it doesn't, which says nothing about the class.
    rate: np.ndarray

    def accuracy(self) -> np.ndarray:
        """Chance that a labeller is right when it votes."""
        share = np.array([1 - self.prior, self.prior])[None, :]
        right = share[:, 0] * self.rate[:, 0, 0] + share[:, 1] * self.rate[:, 1, 2]
        return right / (right + share[:, 0] * self.rate[:, 0, 2] + share[:, 1] * self.rate[:, 1, 0])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of good for each row of votes."""
        pick_ = votes + 1
        each = np.log(self.rate[np.arange(votes.shape[1])[None, :], :, pick_]).sum(1)
        odds = each[:, 1] - each[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> LabelModel:
    """From the number of documents with each vote pattern. It starts from labellers that
    each see a quarter of what is bad and seldom call a good document bad, so that one bad vote can
    outweigh the good votes of labellers that look for other faults; smoothed by that start."""
    m = len(LABELLERS)
    votes = np.array([votes_of(c) for c in counts]) if counts else np.zeros((0, m), int)
    n = np.array(list(counts.values()), float)
    start = np.array([[0.25, 1, 0.75], [0.002, 1, 0.998]])
    model = LabelModel(0.8, np.tile(start, (m, 1, 1)))
    for _ in range(rounds if len(n) else 0):
        good = model.posterior(votes)
        prior = (n @ good + 1) / (n.sum() + 2)
        rate = np.tile(start, (m, 1, 1))
        for cls, weight in ((0, n * (1 - good)), (1, n * good)):
            for v in (-1, 1):
                rate[:, cls, v + 1] += ((votes == v) * weight[:, None]).sum(0)
        rate[:, :, 1] = 0
        rate /= rate.sum(2, keepdims=True)
        rate[:, :, 1] = 1
        done = abs(prior - model.prior) < 1e-9 and np.abs(rate - model.rate).max() < 1e-9
        model = LabelModel(float(np.clip(prior, 1e-4, 1 - 1e-4)), rate)
        if done:
            break
    return model


def features(text: str, f: Facts) -> np.ndarray:
    """Hashed 3- and 4-grams of byte kinds of the whole text, and hashed steps of the facts."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_KIND), np.uint8).astype(np.uint32)
    counts = np.zeros(WIDTH)
    for at in range(0, len(data), 1 << 20):
        a = data[max(0, at - 3) : at + (1 << 20)]
        for n in (3, 4):
            if len(a) >= n:
                g = np.zeros(len(a) - n + 1, np.uint32)
                for i in range(n):
                    g = g * np.uint32(257) + a[i : len(a) - n + 1 + i]
                counts += np.bincount((g * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(20), minlength=WIDTH)
    counts = np.sqrt(counts)
    norm = np.sqrt((counts * counts).sum())
    out = counts / norm if norm else counts
    for name, x in (("odd", f.odd), ("distinct", f.distinct), ("upper", f.upper), ("ends", f.ends), ("short", f.short), ("length", f.length / 20), ("repeats", f.repeats), ("echoes", f.echoes), ("bare", f.bare)):
        out[zlib.crc32(f"{name}/{min(10, int(x * 10))}".encode()) % WIDTH] += 1
    return out.astype(np.float32)


def fit_scorer(x: np.ndarray, soft: np.ndarray, rounds: int = 300, reg: float = 1e-4) -> np.ndarray:
    """Logistic regression (last weight: bias) on soft labels, both classes weighing the same."""
    share = np.clip(soft.mean(), 1e-3, 1 - 1e-3)
    weight = ((soft / share + (1 - soft) / (1 - share)) / 2 / len(soft)).astype(np.float32)
    balanced = soft / share / (soft / share + (1 - soft) / (1 - share))
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    step, t = 1 / (0.25 * float((weight * ((x * x).sum(1) + 1)).sum()) + reg), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30)))
        d = ((p - balanced) * weight).astype(np.float32)
        nxt = (v - step * (np.append(d @ x, d.sum()) + reg * np.append(v[:-1], 0))).astype(np.float32)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = nxt + np.float32((t - 1) / t2) * (nxt - w), nxt, t2
    return w


WORD = re.compile(r"\S")


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = pick(docs, "doc_id", "text").where(F.col("text").rlike(r"\S"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = np.unique([pattern(facts(t)) for t in batch.column(0).to_pylist()] or np.zeros(0, int), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(n, pa.int64())], ["pattern", "n"])

    counted = texts.select("text").mapInArrow(patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    counts = {r.pattern: r.n for r in counted}  # at most 3 ** labellers
    labels = expectation_maximisation(counts)
    total, size = sum(counts.values()), 1 << 30
    h = F.xxhash64("doc_id", "text")
    share = min(1.0, (1.2 * sample + 50) / max(1, total))
    few = texts.withColumn("h", h).where(F.pmod("h", F.lit(size)) < int(share * size)).orderBy("h", "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(facts(t), t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([pattern(f) for f, _ in own], pa.int32()), pa.array([features(t, f).astype(np.float16).tobytes() for f, t in own], pa.binary())], ["pattern", "x"])

    rows = sorted((r.pattern, bytes(r.x)) for r in few.select("text").mapInArrow(run, "pattern int, x binary").collect())  # at most `sample`
    if not rows:
        return QualityModel(labels, np.zeros(WIDTH + 1))
    x = np.stack([np.frombuffer(b, np.float16) for _, b in rows]).astype(np.float32)
    soft = labels.posterior(np.array([votes_of(p) for p, _ in rows]))
    return QualityModel(labels, fit_scorer(x, soft).astype(np.float32))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.35) -> DataFrame:
    """doc_id, votes (as text, one of + - 0 a labeller), posterior, score and kept."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, posts, scores = [], [], []
            for text in batch.column(1).to_pylist():
                if not text or not WORD.search(text):
                    votes.append("0" * len(LABELLERS))
                    posts.append(0.0)
                    scores.append(0.0)
                    continue
                f = facts(text)
                v = votes_of(pattern(f))
                votes.append("".join("-0+"[x + 1] for x in v))
                posts.append(float(model.labels.posterior(np.array([v]))[0]))
                scores.append(float(model.score(features(text, f)[None])[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string()), pa.array(posts, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())], ["doc_id", "votes", "posterior", "score", "kept"])

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, votes string, posterior double, score double, kept boolean")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
