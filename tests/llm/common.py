"""Small tables with everything that may go wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=300):
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


def odd_rows(seed=1, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 160)) for _ in range(n)]
    passage = words(rng, 50)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(base)]
    k = n
    for t in (None, "", "   ", "\n\t", "…", "one", "two words", "é" * 5000, base[0], base[0], base[0].upper(), base[1] + " more", passage, f"{words(rng, 20)} {passage} {words(rng, 20)}", f"{passage} {words(rng, 9)} {passage}", words(rng, 20000)):
        rows.append((k, t, None, "a", 0))
        k += 1
    for i in range(25):  # near copies
        w = base[5].split() + words(random.Random(9), 120).split()
        w[i % len(w)] = f"edit{i}"
        rows.append((k, " ".join(w), "en", "b", 0))
        k += 1
    rows.append((k - 1, rows[-1][1], "en", "b", 0))  # a repeated row
    rows.append((None, base[2], None, None, None))
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def with_clashes(df):
    """Extra columns whose names clash with what operators make, or differ by case alone."""
    from pyspark.sql import functions as F

    extra = ["digest", "_rank", "shard", "slot", "Text", "DOC_ID", "rep", "batch", "keys", "n", "_cell", "label", "kept", "position", "media"]
    return df.select("*", *[F.lit("clash").alias(c) for c in extra])
