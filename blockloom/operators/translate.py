"""The seam to a translator: an injected batch function, called per batch of distinct texts, with strict replies, retries
by halving and errors as rows. The default is a deterministic echo, so that everything runs without a model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.joins import cache_fill, cache_todo
from blockloom.operators.layout import split_translation
from blockloom.operators.sequence import greedy_batches

#: fn(texts, lang=..., glossary=...) -> as many texts.
Translate = Callable[..., list[str]]


class Fatal(RuntimeError):
    """Not worth another try (a refused key, an unknown model): the job fails."""


class Busy(RuntimeError):
    """Worth another try after a while (a full queue, a lost connection)."""


#: Seconds before the second and the third try.
WAITS = (1.0, 2.0)


def echo(texts: list[str], *, lang: str = "", glossary: dict[str, str] | None = None) -> list[str]:
    out = []
    for t in texts:
        for source, target in (glossary or {}).items():
            t = t.replace(source, target)
        out.append(f"MOCK:{t}")
    return out


REGISTRY: dict[str, Callable] = {"translate": echo}


def register(name: str, fn: Callable) -> None:
    """Backends by name: translate, ocr, structure, judge."""
    REGISTRY[name] = fn


def patient(fn: Translate, texts: list[str], lang: str, glossary: dict[str, str], waits: tuple[float, ...] = WAITS) -> list[str]:
    """The reply; a busy translator is asked again after each wait."""
    for wait in waits:
        try:
            return list(fn(texts, lang=lang, glossary=glossary))
        except Busy:
            time.sleep(wait)
    return list(fn(texts, lang=lang, glossary=glossary))


def call(fn: Translate, texts: list[str], lang: str, glossary: dict[str, str], waits: tuple[float, ...] = WAITS) -> list[tuple[str | None, str | None]]:
    """(text, error) per text. A reply of the wrong length, with a blank or that fails is tried again in halves, down to
    single texts; then the error stands and no text."""
    try:
        got = [str(t) for t in patient(fn, texts, lang, glossary, waits)]
        if len(got) == len(texts) and all(t.strip() for t in got):
            return [(t, None) for t in got]
        error = f"{len(got)} texts for {len(texts)}" if len(got) != len(texts) else "a blank text"
    except Fatal:
        raise
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [(None, error)]
    middle = len(texts) // 2
    return call(fn, texts[:middle], lang, glossary, waits) + call(fn, texts[middle:], lang, glossary, waits)


def translate_todo(todo: DataFrame, fn: Translate, lang: str, glossary: dict[str, str] | None = None, budget: int = 4000, most: int = 25, groups: int = 64, group_rows: int = 10_000) -> DataFrame:
    """(block_hash, text, error) for distinct texts (block_hash, text). Texts are dealt into groups by hash, `groups` of
    them or as many more as keep a group at about `group_rows`; within a group batches keep to a budget."""
    dealt = todo.withColumn("_group", F.pmod(F.xxhash64("block_hash"), F.lit(max(groups, -(-todo.count() // group_rows)))))
    batched = greedy_batches(dealt, ["_group"], "block_hash", F.length("text") + 6, budget, most)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        own = batch.sort_values("block_hash")
        got = call(fn, own["text"].tolist(), lang, glossary or {})
        return pd.DataFrame({"block_hash": own["block_hash"].tolist(), "text": [t for t, _ in got], "error": [e for _, e in got]})

    return batched.select("_group", "batch_no", "block_hash", "text").groupBy("_group", "batch_no").applyInPandas(run, "block_hash string, text string, error string")


def translate_blocks(blocks: DataFrame, cache: DataFrame, fn: Translate, lang: str, skip: Column | None = None, glossary: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks with target, new cache rows with errors). skip: blocks that keep their text and are never sent. Equal texts
    are asked for once; a text that failed keeps its source and isn't cached."""
    own = blocks.withColumn("block_hash", F.md5("text")).withColumn("_skip", F.lit(False) if skip is None else F.coalesce(skip, F.lit(False)))
    made = translate_todo(cache_todo(own.where("not _skip"), cache), fn, lang, glossary)
    every = cache.select("block_hash", "text").unionByName(made.where("error is null").select("block_hash", "text"))
    return cache_fill(own, every, F.col("_skip")).drop("_skip", "block_hash"), made


def distribute_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """One translation per unit (sources: array of texts, block_ids: array, target) back onto its blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["pieces"] = [split_translation(list(s), t) for s, t in zip(pdf["sources"], pdf["target"], strict=True)]
            yield pdf[[*keys, "block_ids", "pieces"]]

    kinds = ", ".join(f"`{k}` {units.schema[k].dataType.simpleString()}" for k in keys)
    made = units.select(*keys, "block_ids", "sources", "target").mapInPandas(run, f"{kinds}, block_ids {units.schema['block_ids'].dataType.simpleString()}, pieces array<string>")
    return made.select(*keys, F.explode(F.arrays_zip("block_ids", "pieces")).alias("z")).select(*keys, F.col("z.block_ids").alias("block_id"), F.col("z.pieces").alias("target"))


def retranslate(texts: list[str], fn: Translate, lang: str, glossary: dict[str, str] | None = None) -> list[str]:
    """Without a cache; what fails keeps its source."""
    return [t if t is not None else s for s, (t, _) in zip(texts, call(fn, texts, lang, glossary or {}), strict=True)] if texts else []
