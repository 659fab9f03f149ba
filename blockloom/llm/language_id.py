"""Language identification by hierarchical discrimination.

Texts become hashed counts of byte 2-, 3- and 4-grams (square root, unit length). One-versus-rest
linear support vector machines predict the language family; inside the family, one-versus-one
machines between its languages vote, ties broken by summed margins, then by name. Margins only tell
learned languages apart, so the score also counts how strange the text's n-grams are to all of them:
a text that is clearly stranger than any training row has a score near 0. Without enough training
documents, or if the machines don't recognize most of them, nothing counts as strange. The machines are
fitted in one task on a bounded sample: at most `sample` labelled documents a language (the ones
with the smallest hash) and about `most` in all, each also as a short snippet. Every language that a
usable row has is learned. The driver gets the weights only. Predictions read the whole text and nothing else.

Defined results: null text, or text without a letter, is `und` with score 0; without any labelled
row every prediction is `und`; with one language every text with a letter gets it; repeated rows are
predicted alike; an empty table gives an empty table; other columns don't count.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.shared import bounded_batches, pick, stored

UNDETERMINED = "und"
WIDTH_BITS = 12
WIDTH = 1 << WIDTH_BITS
SAMPLE, MOST, SNIPPET = 400, 8000, 120
CHUNK = 1 << 20
#: So many languages, with a row each, are broadcast.
SMALL = 100_000
#: Texts can be strange if there are so many training documents and so large a share of them is predicted as labelled.
#: They are beyond so many times the strangeness of the strangest one; from there a score falls by e for each 1/STEEP.
KNOWN_DOCS, KNOWN_RIGHT, BEYOND, STEEP = 20, 0.9, 1.25, 4.0
LETTER = re.compile(r"[^\W\d_]")
#: ISO 639-1 codes by family. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "rm", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["ar", "he", "mt"],
    "baltic": ["lt", "lv"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_PLAIN = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def features(text: str) -> np.ndarray:
    """The hashed n-gram profile of the whole text."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    counts = np.zeros(WIDTH)
    for at in range(0, len(data), CHUNK):
        a = np.frombuffer(data[max(0, at - 3) : at + CHUNK], np.uint8).astype(np.uint32)
        g = a
        for n in (2, 3, 4):
            if len(g) < 2:
                break
            g = (g[:-1] << np.uint32(8)) | a[n - 1 :]
            h = (g * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(32 - WIDTH_BITS)
            counts += np.bincount(h, minlength=WIDTH)
    counts = np.sqrt(counts)
    norm = np.sqrt((counts * counts).sum())
    return (counts / norm if norm else counts).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights (last one: bias) of a linear machine with squared hinge loss; y is +1 or -1. The two
    classes weigh the same however many rows they have."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    reg = 1 / (c * 100)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    step, t = 1 / (2 * 2.0 + reg), 1.0  # unit rows with a bias: the squared norm is at most 2
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = np.append(-2 * (slack @ x) + reg * v[:-1], -2 * slack.sum()).astype(np.float32)
        nxt = v - step * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = nxt + np.float32((t - 1) / t2) * (nxt - w), nxt, t2
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def says(x: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """For each n-gram the logarithm of its share in the learned language that has most of it, smoothed,
    against equal shares. A feature's square is its n-gram's share of the text."""
    most = np.zeros(x.shape[1], np.float32)
    for lang in sorted(set(langs.tolist())):
        most = np.maximum(most, np.mean(x[langs == lang] ** 2, 0))
    return np.log(0.95 * most * x.shape[1] + 0.05)


def strangeness(x: np.ndarray, said: np.ndarray, usual: float) -> np.ndarray:
    """How far a text's n-grams say less than usual, in units of chance for as many n-grams as it has."""
    shares = x * x
    return (usual - shares @ said) / np.sqrt(np.maximum((shares * shares).sum(1), 1e-9))


def set_strange(model: LanguageModel, langs: np.ndarray, x: np.ndarray) -> None:
    """Sets model.known. x has two rows a document, one after the other; a document is judged by the
    other half of the documents."""
    if len(x) < 2 * KNOWN_DOCS:
        return
    right = sum(a == b for at in range(0, len(x), 256) for a, b in zip(model.judge(x[at : at + 256])[0], langs[at : at + 256], strict=True))
    if right < KNOWN_RIGHT * len(x):
        return
    half, got, usual = np.arange(len(x)) // 2 % 2 == 0, [], []
    for own, other in ((half, ~half), (~half, half)):
        said = says(x[other], langs[other])
        usual.append(float(np.median((x[own] * x[own]) @ said)))
        got.append(float(strangeness(x[own], said, usual[-1]).max()))
    model.known = says(x, langs), float(np.mean(usual)), BEYOND * max(got)


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    family_weights: dict[str, np.ndarray] = field(default_factory=dict)
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    #: What n-grams say, what they say usually, and the greatest strangeness of a text in a learned language.
    known: tuple[np.ndarray, float, float] | None = None

    def judge(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of rows of features."""
        out, scores = [UNDETERMINED] * len(x), [0.0] * len(x)
        names = sorted(self.families)
        if len(names) == 1:
            first, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            m = np.stack([x @ self.family_weights[f][:-1] + self.family_weights[f][-1] for f in names], 1)
            order = np.sort(m, 1)
            first, sure = m.argmax(1), _sigmoid(2 * (order[:, -1] - order[:, -2]))
        for j, name in enumerate(names):
            rows = np.flatnonzero(first == j)
            if not len(rows):
                continue
            langs = self.families[name]
            votes, sums, worst = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for a, b in combinations(range(len(langs)), 2):
                w = self.pair_weights[langs[a], langs[b]]
                d = x[rows] @ w[:-1] + w[-1]
                votes[:, a] += d >= 0
                votes[:, b] += d < 0
                sums[:, a] += d
                sums[:, b] -= d
                worst[:, a] = np.minimum(worst[:, a], d)
                worst[:, b] = np.minimum(worst[:, b], -d)
            best = (votes + np.tanh(sums / (4 * len(langs))) * 0.49).argmax(1)
            inner = _sigmoid(4 * worst[np.arange(len(rows)), best])
            for r, b, s in zip(rows.tolist(), best.tolist(), (sure[rows] * inner).tolist(), strict=True):
                out[r], scores[r] = langs[b], float(s)
        if self.known:
            said, usual, most = self.known
            scores = (np.array(scores) * np.exp(-STEEP * np.clip(strangeness(x, said, usual) - most, 0, 100))).tolist()
        return out, scores

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        real = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.families else []
        out, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for at in range(0, len(real), 256):
            part = real[at : at + 256]
            langs, sure = self.judge(np.stack([features(texts[k]) for k in part]))
            for k, a, b in zip(part, langs, sure, strict=True):
                out[k], scores[k] = a, b
        return out, scores


def train(labelled: list[tuple[str, np.ndarray]]) -> LanguageModel:
    """From (language, features) rows, two a document."""
    if not labelled:
        return LanguageModel()
    langs = np.array([a for a, _ in labelled])
    x = np.empty((len(labelled), WIDTH), np.float32)
    for k, (_, row) in enumerate(labelled):
        x[k] = row
    families: dict[str, list[str]] = defaultdict(list)
    for code in sorted(set(langs.tolist())):
        families[FAMILY_OF.get(code, "=" + code)].append(code)
    model = LanguageModel(dict(families))
    family = np.array([FAMILY_OF.get(code, "=" + code) for code in langs.tolist()])
    if len(families) > 1:
        for name in families:
            model.family_weights[name] = fit_svm(x, np.where(family == name, 1, -1).astype(np.float32))
    for codes in families.values():
        for a, b in combinations(codes, 2):
            own = (langs == a) | (langs == b)
            model.pair_weights[a, b] = fit_svm(x[own], np.where(langs[own] == a, 1, -1).astype(np.float32))
    set_strange(model, langs, x)
    return model


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE, most: int = MOST) -> LanguageModel:
    """A model learned from text and lang of the usable rows (a condition on doc_id, text, lang). With so many
    languages that `sample` of each would be more than `most`, each gives fewer, but 4 at least."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    size, each = 1 << 30, F.least(F.lit(sample), F.greatest(F.lit(4), (F.lit(most) / F.count(F.lit(1)).over(Window.partitionBy())).cast("int")))
    # A row a language. Of a language's rows, the share whose hash is low enough holds `each` ones almost surely.
    shares = stored(counts.withColumn("each", each).select(F.col("lang").alias("_lang"), "each", (F.least(F.lit(1.0), (1.5 * F.col("each") + 20) / F.col("n")) * size).cast("long").alias("share")), "languages")
    small = F.broadcast if shares.count() <= SMALL else (lambda d: d)
    few = rows.withColumn("h", F.xxhash64("doc_id", "text", "lang")).join(small(shares), F.col("lang") == F.col("_lang")).where(F.pmod("h", F.lit(size)) < F.col("share"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= F.col("each"))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for text in batch.column(1).to_pylist():
                middle = max(0, len(text) - SNIPPET) // 2
                data.append(b"".join(features(t).astype(np.float16).tobytes() for t in (text, text[middle : middle + SNIPPET])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["lang", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        model = train([(lang, row) for lang, both in rows for row in np.frombuffer(both, np.float16).reshape(2, WIDTH)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    learned = few.select("lang", "text").mapInArrow(profiles, "lang string, x binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(learned[0].model) if learned else LanguageModel()


def predict(docs: DataFrame, model: LanguageModel, passing: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every document, and the columns named in passing."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", *[n for n in passing if n not in ("doc_id", "text")]).withColumn("doc_id", F.col("doc_id").cast("long"))
    names = ["doc_id", "lang_pred", "score", *passing]
    schema = ", ".join(["doc_id long, lang_pred string, score double", *[f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in passing]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[batch.column(batch.schema.get_field_index(n)) for n in passing]], names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
