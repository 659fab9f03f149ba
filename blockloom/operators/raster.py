"""Pixel operators on grey pages (0 black to 255 white) as numpy arrays, and their use on a table of pages.

A page row has width, height and `pixels` (bytes, row by row). Pages are handled one by one within Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def paper(page: np.ndarray, tile: int = 32) -> float:
    """The paper's tone: the darkest of the tiles' 90th percentiles that is still in the brighter half."""
    h, w = page.shape
    tones = [np.percentile(page[y : y + tile, x : x + tile], 90) for y in range(0, max(1, h), tile) for x in range(0, max(1, w), tile)]
    bright = [t for t in tones if t >= (min(tones) + max(tones)) / 2]
    return float(min(bright))


def ink(page: np.ndarray, depth: float = 48.0) -> np.ndarray:
    return page < paper(page) - depth


def runs(line: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def closed(line: np.ndarray, gap: int) -> np.ndarray:
    """Gaps of at most `gap` between runs filled."""
    out = line.copy()
    found = runs(line)
    for (_, a), (b, _) in zip(found, found[1:], strict=False):
        if b - a <= gap:
            out[a:b] = True
    return out


def bands(mask: np.ndarray, gap: int = 2, least: int = 1) -> list[tuple[int, int]]:
    """Rows of ink from top to bottom."""
    return [(a, b) for a, b in runs(closed(mask.any(1), gap)) if b - a >= least]


def rules(mask: np.ndarray, least: int, gap: int = 2) -> list[tuple[int, int, int]]:
    """(row, start, end) of horizontal strokes that are long enough; rows of one stroke are told once."""
    out: list[tuple[int, int, int]] = []
    for y in range(len(mask)):
        for a, b in runs(closed(mask[y], gap)):
            if b - a >= least and not any(y - r <= 2 and a < e and s < b for r, s, e in out[-8:]):
                out.append((y, a, b))
    return out


def skew(mask: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """Degrees by which the lines are tilted: the shear under which the ink of rows is most uneven; of equals the least."""
    y, x = np.nonzero(mask)
    if not len(y):
        return 0.0
    angles = np.arange(-most, most + step / 2, step)
    score = [np.square(np.bincount(np.round(y - x * np.tan(np.radians(a)) - (y - x * np.tan(np.radians(a))).min()).astype(int))).sum() for a in angles]
    return float(max(zip(score, -np.abs(angles), angles, strict=True))[2])


def page_marks(pages: DataFrame, keys: list[str], least_rule: int = 40) -> DataFrame:
    """keys, paper, bands, rules and skew of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                page = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]).astype(float)
                mask = ink(page)
                out.append({k: r[k] for k in keys} | {"paper": paper(page), "bands": [list(b) for b in bands(mask)], "rules": [list(x) for x in rules(mask, least_rule)], "skew": skew(mask)})
            yield pd.DataFrame(out, columns=[*keys, "paper", "bands", "rules", "skew"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, "width", "height", "pixels").mapInPandas(run, f"{kinds}, paper double, bands array<array<int>>, rules array<array<int>>, skew double")
