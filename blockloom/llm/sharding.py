"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into CELLS equal cells. Virtual nodes own the cells up to the next node clockwise; a
row's key hashes to a cell. Every shard has a capacity. A shard takes the rows of its own cells
first; rows that find it full continue clockwise to the first shard with room. Only the counts per
cell (at most CELLS rows) come to the driver, which walks the ring once and returns a plan of
(cell, rank interval) -> (shard, first slot); all rows are then placed by joins and windows of
built-in functions. Rows of a cell are ranked by their own hash, so that placement depends on the rows
alone, not on how they lie in files.

Defined results: null text has size 16 and the checksum of no bytes; null ids hash like any value;
repeated rows are placed one by one; an empty table gives an empty table; other columns don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import parted, pick, ranked, table_of

CELLS = 1 << 14
SCHEMA = "cell int,lo bigint,hi bigint,shard int,slot0 bigint"


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[int]:
    """The owner of each cell: virtual node (shard, copy) sits at the hash of its name."""
    at = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), cell_of(F.concat_ws("/", F.lit("node"), (F.col("id") % shards).cast("string"), F.floor(F.col("id") / shards).cast("string"))).alias("cell"))
    nodes = sorted((r.cell, r.shard) for r in at.collect())
    if not nodes:
        raise ValueError("a ring needs a shard and a virtual node")
    owner, k = [0] * CELLS, len(nodes) - 1  # cells before the first node belong to the last one
    spots = {}
    for cell, shard in nodes:
        spots.setdefault(cell, shard)  # two nodes on one cell: the lower shard has it
    held = nodes[k][1]
    for cell in range(CELLS):
        held = spots.get(cell, held)
        owner[cell] = held
    return owner


def cell_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def capacities(total: int, shards: int, load: float | None) -> list[int]:
    """load None: the tight bound, counts at most one apart; else ceil(load * total / shards)."""
    if load is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    if load < 1:
        raise ValueError("load must be at least 1")
    return [-int(-load * total // shards)] * shards


def place(counts: dict[int, int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Walks the ring: (cell, lo, hi, shard, slot0) for rank intervals of every cell's rows. The
    intervals of a cell lie side by side; there are at most len(counts) + 2 * shards of them plus
    one for each time that an overflowing cell fills a shard."""
    room, used, plan, over = list(room), [0] * len(room), [], []

    def put(cell: int, lo: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n > 0:
            plan.append((cell, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return max(n, 0)

    for cell in sorted(counts):
        took = put(cell, 0, counts[cell], owner[cell])
        if took < counts[cell]:
            over.append((cell, took))
    around = len(owner)
    for cell, lo in over:
        step = cell
        while lo < counts[cell]:
            step = (step + 1) % around
            lo += put(cell, lo, counts[cell] - lo, owner[step])
    return plan


def shard_on_ring(table: DataFrame, key: str, shards: int, vnodes: int = 32, load: float | None = None) -> DataFrame:
    """Adds shard int and slot long (gapless from 0 within the shard). The tables's column names must
    not start with an underscore. load: see capacities()."""
    spark = table.sparkSession
    names = table.columns
    rows = parted(table.withColumn("_cell", cell_of(F.col(key))), "ring-rows")
    owner = ring(spark, shards, vnodes)
    counts = {r._cell: r.n for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS rows
    plan = place(counts, owner, capacities(sum(counts.values()), shards, load))
    at = table_of(spark, plan, SCHEMA, "ring-plan")  # bounded by CELLS and shards, see place()
    numbered = ranked(rows, ["_cell"], "_rank", 1)
    placed = numbered.join(F.broadcast(at), (F.col("_cell") == F.col("cell")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return placed.select(*names, "shard", (F.col("slot0") + F.col("_rank") - F.col("lo")).cast("long").alias("slot"))


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """law rows: the capacities differ by one row at most, and every shard ends up full."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))
    out = shard_on_ring(narrow, "doc_id", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
