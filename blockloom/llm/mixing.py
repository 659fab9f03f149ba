"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks of a fixed number of rows. A source of weight w gives its block j the
release time floor(j / w) and the deadline ceil((j + 1) / w); earliest deadline first among released
blocks then fills one slot after the other, and at any time every source has had its share to
within less than one block. With weights as whole quanta of A, the schedule repeats every A slots,
so one period is worked out on the driver (A entries) and any block's slot follows from its number
by arithmetic of built-in functions.

When a source has no block left, a new phase starts: the weights of the others are scaled up and
their schedule begins anew. Each row appears exactly once. Rows of a source follow their own hash, so that
the order depends on the rows alone, not on how they lie in files.

Defined results: rows with null source form one source of their own; sources without a stated weight
get weight_of's default; null ids and repeated rows are placed like any row; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import parted, pick, ranked, table_of

BLOCK_ROWS = 16
QUANTA = 512
#: Rows of a source are shuffled into so many buckets at least, which are also the unit of ranking.
BUCKETS = 256


def quanta(weights: dict[str, float], total: int) -> dict[str, int]:
    """Whole quanta that sum to total (or to 4 per source, if that is more): each source gets one
    quantum at least, the rest by largest remainder, ties by name."""
    if not weights:
        return {}
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    total, whole = max(total, 4 * len(weights)), sum(weights.values())
    spare = total - len(weights)
    exact = {s: w / whole * total for s, w in weights.items()}
    over = {s: max(0.0, x - 1) for s, x in exact.items()}
    scale = spare / (sum(over.values()) or 1)
    out = {s: 1 + int(over[s] * scale) for s in weights}
    order = sorted(weights, key=lambda s: (-(over[s] * scale - int(over[s] * scale)), s))
    for i in range(total - sum(out.values())):
        out[order[i % len(order)]] += 1
    return out


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """Earliest-deadline-first over one period: the slots of each source's blocks, ascending."""
    whole = sum(shares.values())
    release = lambda s, j: j * whole // shares[s]
    deadline = lambda s, j: -(-(j + 1) * whole // shares[s])
    waiting = [(0, s, 0) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for t in range(whole):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, j), s, j))
        due, s, j = heapq.heappop(ready)
        assert t < due
        slots[s].append(t)
        if j + 1 < shares[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return slots


def schedule(rows: dict[str, int], shares: dict[str, int], block: int) -> list[tuple]:
    """The plan: for each phase, source and block number modulo the source's quanta, one entry."""
    left = {s: -(-n // block) for s, n in rows.items() if n}
    done = dict.fromkeys(left, 0)
    plan, slot0, row0, phase = [], 0, 0, 0
    while left:
        active = {s: shares[s] for s in left}
        whole, slots = sum(active.values()), period(active)

        def slot(s: str, j: int) -> int:
            return j // active[s] * whole + slots[s][j % active[s]]  # noqa: B023

        end = min(slot(s, n - 1) for s, n in left.items())
        took = {s: end // whole * active[s] + sum(x <= end % whole for x in slots[s]) for s in left}
        for s in left:
            plan += [(s, k, phase, done[s], done[s] + took[s], active[s], whole, x, slot0, row0) for k, x in enumerate(slots[s])]
        left = {s: n - took[s] for s, n in left.items()}
        done = {s: done[s] + took[s] for s in left}
        last = next(s for s in left if left[s] == 0)  # it holds the phase's last slot, which alone may be partial
        slot0, row0, phase = slot0 + end + 1, row0 + end * block + (rows[last] - (done[last] - 1) * block), phase + 1
        left = {s: n for s, n in left.items() if n}
    return plan


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block: int = BLOCK_ROWS, total_quanta: int = QUANTA, passing: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, block (number in its source), phase, slot, position, and
    the columns named in passing.

    position is gapless from 0 and is the mixed order. weights: target weight per source (null
    source: key ""); a source that isn't named gets the smallest weight named. Without weights, a
    source of n rows weighs n ** temperature. The number of sources is bounded by what the driver
    can plan for: sources * max(total_quanta, 4 * sources) plan entries.
    """
    spark = docs.sparkSession
    named = pick(docs, "doc_id", "source", *passing).withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    table = parted(named, "mix-rows")
    counts = {r._source: r.n for r in table.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    if weights is None:
        chosen = {s: float(n) ** temperature for s, n in counts.items()}
    else:
        stated = {("=" + s if s else ""): w for s, w in weights.items()}
        chosen = {s: stated.get(s, min(stated.values(), default=1.0)) for s in counts}
    shares = quanta(chosen, total_quanta)
    plan = schedule(counts, shares, block)
    numbered = ranked(table, ["_source"], "_rank", BUCKETS)
    numbered = numbered.withColumn("_block", F.floor(F.col("_rank") / block).cast("long"))
    phases = table_of(spark, sorted({(p[0], p[2], p[3], p[4], p[5]) for p in plan}), "ps string,pp int,p0 bigint,p1 bigint,pa bigint", "mix-phases")
    offsets = table_of(spark, [(p[0], p[1], p[2], p[6], p[7], p[8], p[9]) for p in plan], "os string,k bigint,op int,period bigint,offset bigint,slot0 bigint,row0 bigint", "mix-plan")
    # Both plan tables are bounded by (sources, quanta), see above; their size doesn't follow the rows.
    small = F.broadcast if len(plan) <= 1_000_000 else (lambda d: d)
    placed = numbered.join(small(phases), (F.col("_source") == F.col("ps")) & (F.col("_block") >= F.col("p0")) & (F.col("_block") < F.col("p1")))
    placed = placed.withColumn("_k", F.pmod(F.col("_block") - F.col("p0"), F.col("pa"))).withColumn("_turn", F.floor((F.col("_block") - F.col("p0")) / F.col("pa")))
    placed = placed.join(small(offsets), (F.col("_source") == F.col("os")) & (F.col("_k") == F.col("k")) & (F.col("pp") == F.col("op")))
    inner = (F.col("_turn") * F.col("period") + F.col("offset")).cast("long")
    position = F.col("row0") + inner * block + F.pmod(F.col("_rank"), F.lit(block))
    return placed.select("doc_id", "source", F.col("_block").alias("block"), F.col("pp").alias("phase"), (F.col("slot0") + inner).alias("slot"), position.cast("long").alias("position"), *passing)


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
