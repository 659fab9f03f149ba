"""Scores from finding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import text as X
from blockloom.operators.aggregates import count_if

#: Weight of each layout finding, and of the findings that join the final score.
LAYOUT_WEIGHTS = {"overflow": 2.0, "band_violation": 2.0, "too_small": 1.5, "crowding": 1.5, "severe_tiny": 2.0, "too_many_lines": 1.0}
MISSING_WEIGHT, RESIDUAL_WEIGHT, NUMBER_WEIGHT, IDENTITY_WEIGHT = 2.0, 2.0, 2.0, 3.0
COUNTS = ["too_small", "overflow", "crowding", "band_violation", "single_over", "severe_tiny", "too_many_lines"]
BUCKETS = {"b_lt4": (0.0, 4.0), "b_4_5": (4.0, 5.0), "b_5_6": (5.0, 6.0), "b_ge6": (6.0, 1e9)}


def layout_counts(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: measured blocks (total), layout findings by kind and blocks by font size. fitted: fs, floor, height,
    n_lines, gap, fit_height, in_table, y0, y1."""
    box = F.greatest(F.lit(0.5), F.col("y1") - F.col("y0"))
    many = F.col("n_lines") > 1
    band = F.col("in_table") & (F.col("fit_height") > 0) & (F.col("height") > F.col("fit_height") + 0.05)
    tests = {
        "too_small": F.col("fs") + 1e-9 < F.col("floor"), "overflow": F.col("height") > box + 2, "crowding": F.coalesce(F.col("height") > box + F.col("gap") + 2, F.lit(False)),
        "band_violation": band & many, "single_over": band & (F.col("n_lines") == 1), "severe_tiny": F.col("fs") < 5, "too_many_lines": many & (F.col("fs") + 1e-9 <= F.col("floor")),
    }
    sizes = {n: (F.col("fs") >= a) & (F.col("fs") < b) for n, (a, b) in BUCKETS.items()}
    return fitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[count_if(t).alias(n) for n, t in (tests | sizes).items()])


def ratio_score(weighted: Column, total: Column) -> Column:
    """100 * (1 - min(1, weighted / total)); 0 without anything measured."""
    return F.when(total > 0, F.bround(100 * (1 - F.least(F.lit(1.0), weighted / total)), 2)).otherwise(0.0)


def layout_score(counts: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Summed counts, weighted findings, their ratio and the layout score."""
    w = LAYOUT_WEIGHTS | (weights or {})
    sums = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ["total", *COUNTS, *BUCKETS]])
    weighted = sum((F.col(k) * F.lit(v) for k, v in w.items()), F.lit(0.0))
    out = sums.withColumn("weighted", F.bround(weighted, 2))
    ratio = F.when(F.col("total") > 0, F.bround(F.least(F.lit(1.0), F.col("weighted") / F.col("total")), 4)).otherwise(0.0)
    return out.withColumn("issue_ratio", ratio).withColumn("score", ratio_score(F.col("weighted"), F.col("total"))).withColumn("no_data", F.col("total") == 0)


def completeness(blocks: DataFrame, keys: list[str], cjk_target: bool = False) -> DataFrame:
    """missing, identity and residual per page, of measurable blocks; identity is told before residual."""
    t = X.stripped(F.col("target"))
    left = X.is_latin_prose(t) if cjk_target else X.has_residual_cjk(t)
    same = X.is_identity(F.col("text"), t)
    own = blocks.where("measurable")
    return own.groupBy(*keys).agg(count_if(t == "").alias("missing"), count_if((t != "") & same).alias("identity"), count_if((t != "") & ~same & left).alias("residual"), count_if(t != "").alias("measured"))


def final_score(totals: DataFrame) -> DataFrame:
    """Adds score and no_data to rows with total, weighted, missing, residual, identity and numbers."""
    c = F.col
    base = c("total") + c("missing") + c("residual") + c("identity")
    weight = c("weighted") + c("missing") * MISSING_WEIGHT + c("residual") * RESIDUAL_WEIGHT + c("numbers") * NUMBER_WEIGHT + c("identity") * IDENTITY_WEIGHT
    return totals.withColumn("score", ratio_score(weight, base)).withColumn("no_data", base == 0)


def compare(base: DataFrame, candidate: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, delta (candidate less base); metrics that are 0 on both sides are left out."""
    long = lambda d, n: d.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(*keys, "m.metric", F.col("m.v").alias(n))
    both = long(base, "b").join(long(candidate, "c"), [*keys, "metric"], "full").select(*keys, "metric", F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("c", F.lit(0.0)).alias("c"))
    return both.where("b <> 0 or c <> 0").select(*keys, "metric", F.bround(F.col("c") - F.col("b"), 2).alias("delta"))
