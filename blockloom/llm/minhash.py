"""Near-duplicate detection by min-max hashing.

Under each permutation both the minimum and the maximum of a document's shingle set are kept; each
is equal between two documents with the probability of their Jaccard similarity, so half the hash
evaluations give a signature of the same length (and of lower variance). Signatures are cut into bands
of `rows` values; documents with an equal band share a bucket. Candidates are confirmed on full sets.

No bucket's pairs are enumerated: equal sets are one class; each class is first compared with one
leader (the class with the least number in the bucket it shares most often), which settles copies in a
number of comparisons linear in their number. Buckets that still hold several components are then
compared one by one: a bucket is one block, or, where its sets don't fit into one, several that meet two
at a time; only sets of different components meet, each pair in one of the buckets that it shares, and
only until their components are joined. Sets are sets of 64-bit hashes of shingles; they are made once
for every class that shares a bucket.

Defined results: null text has no words; a document without words has an empty set and is linked
with nothing; with fewer than `words` words the whole sequence is one shingle; a document is an id
with a text, so texts that share an id, or have none, are documents of their own; rows with a null id
take part and are never a representative while their component has an id; one document of a component
is kept; rows that share id and text are one document with several rows; an empty table gives an empty table; other columns don't count.
With rows=6 and bands=32 a pair at similarity 0.85 is missed with probability 3e-7; with bands=48
a pair at 0.80 with 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.components import components
from blockloom.llm.shared import bounded_batches, discard, pick, rows_literal, stored
from blockloom.llm.substring_dedup import WordHashes, grams, mixed

#: Shingles of a block of documents that are compared in one task.
BLOCK = 1 << 18
#: A class that holds more than 1/HEAVY of all rows is heavy: there are fewer than HEAVY of them.
HEAVY = 1000
#: Stands for a null id: the greatest value, so that it never is the least of others.
NO_ID = (1 << 63) - 1
_U = np.uint64


def shingles(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a whole text, A-Z lower-cased."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = hashes.of(own)
    if len(own) < words:
        return mixed(grams(h, len(own)) + _U(len(own)))
    return np.unique(grams(h, words))


class MinMax:
    """Signatures of bands * rows values, from half as many permutations."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        if rows % 2:
            raise ValueError("a band holds minima and maxima in pairs: rows must be even")
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * _U(2) + _U(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)
        self.mix = rng.integers(0, 1 << 63, rows, np.uint64) * _U(2) + _U(1)
        self.band = mixed(np.arange(bands, dtype=np.uint64) + _U(0x5851F42D4C957F2D))

    def signature(self, s: np.ndarray) -> np.ndarray:
        low, high = None, None
        for at in range(0, len(s), 512):
            h = np.multiply.outer(s[at : at + 512], self.a)
            h += self.b
            a, b = h.min(0), h.max(0)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.stack([low, high], 1).reshape(self.bands, self.rows)

    def keys(self, s: np.ndarray) -> np.ndarray:
        return mixed((mixed(self.signature(s)) * self.mix).sum(1, dtype=np.uint64) ^ self.band).astype(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits over the whole sorted set."""
    place = np.arange(len(s), dtype=np.uint64)
    one = mixed(s ^ mixed(place)).sum(dtype=np.uint64) + _U(len(s))
    two = mixed(mixed(s) + place * _U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


SIGNED = "doc_id long, text_key long, n long, one long, two long, bands array<long>"


def signed(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minmax = WordHashes(), MinMax(bands, rows)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                s = shingles((text or "").encode("utf-8", "surrogatepass"), words, hashes)
                one, two = digest(s)
                for column, x in zip(out, (len(s), one, two, minmax.keys(s) if len(s) else []), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "one", "two", "bands"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def full_sets(words: int):
    """(rep, n, set) from rows (rep, n, one, two, text), set as little-endian 64-bit hashes; a text that only
    collides with the one that its class was made from, in id and text_key, gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep, sets = [], []
            for k, (one, two, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)], strict=True)):
                s = shingles((text or "").encode("utf-8", "surrogatepass"), words, hashes)
                if digest(s) == (one, two):
                    keep.append(k)
                    sets.append(s.tobytes())
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sets, pa.binary())], ["rep", "n", "set"])

    return run


SETS = "rep long, n long, set binary"
EDGES = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def by_group(run, names: list[str]):
    """For partitions sorted by two leading columns: run(columns) for every group of rows that agree in both,
    where columns has a list for each of `names`, the other columns. One group is held at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            found = run(key, {n: [x for part in held for x in part.column(n).to_pylist()] for n in names})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=_EDGES)

        for batch in batches:
            one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                now = (int(one[at]), int(two[at]))
                if key is not None and now != key:
                    yield from flush()
                    held = []
                key = now
                held.append(batch.slice(at, end - at))
        if held:
            yield from flush()

    return each


def grouped_edges(rows: DataFrame, one: str, two: str, run, names: list[str]) -> DataFrame:
    """Edges that run() finds in the groups of (one, two)."""
    sent = rows.select(one, two, *names).repartition(one, two).sortWithinPartitions(one, two)
    return sent.mapInArrow(by_group(run, names), EDGES)


def leader_edges(percent: int):
    """Of a group of (lead, salt): the members that are similar to the leader."""

    def run(key: tuple[int, int], rows: dict[str, list]) -> list[tuple[int, int]]:
        lead = key[0]
        sets = {x: np.frombuffer(s, np.uint64) for x, s in zip(rows["rep"], rows["set"], strict=True)}
        if lead not in sets:
            return []
        return [(lead, x) for x, s in sets.items() if x != lead and similar(sets[lead], s, percent)]

    return run


def block_edges(percent: int):
    """Of one or two blocks of a bucket (grp): pairs of components that similar sets join. A pair of sets is
    compared in the least of the buckets that it shares."""

    def run(key: tuple[int, int], rows: dict[str, list]) -> list[tuple[int, int]]:
        found: dict[int, tuple] = {}
        for name, comp, block, keys, data in zip(*[rows[x] for x in ("rep", "comp", "block", "keys", "set")], strict=True):
            if name not in found:
                found[name] = (len(data), name, comp, block, frozenset(keys), np.frombuffer(data, np.uint64))
        two = len({x[3] for x in found.values()}) > 1
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges, members = [], sorted(found.values(), key=lambda x: x[:2])
        for i, (size, _, comp, block, keys, data) in enumerate(members):
            for size2, _, comp2, block2, keys2, data2 in members[i + 1 :]:
                if percent * size2 > 100 * size:
                    break
                if (two and block == block2) or find(comp) == find(comp2) or min(keys & keys2) != key[0]:
                    continue
                if similar(data, data2, percent):
                    parent[find(comp)] = find(comp2)
                    edges.append((min(comp, comp2), max(comp, comp2)))
        return edges

    return run


def labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the component of `key`, which is its own where labels has none."""
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(own, F.col(key) == F.col("_node"), "left").select(*rows.columns, F.coalesce("_label", key).alias(name))


def roots(edges: DataFrame) -> DataFrame:
    """(node, label) from edges (a, b) in which every b has one a, which is smaller: the root of each b, by
    pointer jumping. Nodes that are no b are roots themselves."""
    now = stored(edges.select(F.col("b").alias("node"), F.col("a").alias("label")), "roots")
    while True:
        up = now.select(F.col("node").alias("_node"), F.col("label").alias("_up"))
        after = stored(now.join(up, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_up", "label").alias("label"), F.col("_up").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after.select("node", "label")
        if not after.where("moved").take(1):
            return now


def residual_blocks(rest: DataFrame) -> DataFrame:
    """The block of each row (rep, comp, n, grp), for which pairs of blocks of a group are compared. Groups within
    BLOCK are one block. In larger ones, components above BLOCK / 4 are
    cut into blocks of their own, that aren't compared with each other, and the others share blocks."""
    per_comp = rest.groupBy("grp", "comp").agg(F.sum("n").alias("cn"))
    per_group = per_comp.groupBy("grp").agg(F.sum("cn").alias("gn"))
    sized = rest.join(per_comp, ["grp", "comp"]).join(per_group, "grp")
    large, own = F.col("gn") > BLOCK, F.col("cn") > BLOCK // 4
    number = F.when(~large, F.lit(0)).when(own, F.pmod(F.xxhash64("rep"), F.ceil(F.col("cn") / BLOCK))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("gn") / BLOCK)))
    return sized.select("rep", "comp", "keys", "grp", F.struct(F.when(large & own, F.col("comp")).alias("pure"), number.cast("long").alias("number")).alias("block"))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = 32, rows: int = 6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return judged(docs, words, percent, bands, rows).drop("text_key")


def text_key(text: str) -> Column:
    """With doc_id, tells documents apart."""
    return F.xxhash64(text)


def judged(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = 32, rows: int = 6) -> DataFrame:
    """near_duplicates() and the text_key of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_key("text").alias("text_key"), "text")
    sig = stored(texts.mapInArrow(signed(words, bands, rows), SIGNED), "signatures")
    full = sig.where("n > 0")
    # A class is named by a number of its own, `rep`; one of its documents, `of`, stands for it.
    classes = full.groupBy("one", "two").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), "one", "two", "of.doc_id", "of.text_key", "rows", "n", "bands"), "classes")
    exploded = classes.select("rep", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
    members = stored(exploded.join(shared, "key").select("key", "lead", "rep"), "members")

    # The sets of classes that share a bucket with another one.
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "one", "two", "doc_id", "text_key")
    found = texts.join(wanted, ["doc_id", "text_key"]).select("rep", "n", "one", "two", "text").mapInArrow(full_sets(words), SETS)
    bodies = stored(found, "sets")
    again = bodies.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if again.take(1):  # rows that share id and text
        bodies = stored(bodies.groupBy("rep").agg(F.first("n").alias("n"), F.first("set").alias("set")), "sets")

    # Round one: each class against one leader.
    ties = members.where("rep <> lead").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("k"))
    choice = ties.groupBy("rep").agg(F.max(F.struct("k", (-F.col("lead")).alias("minus"))).alias("best")).select("rep", (-F.col("best.minus")).alias("lead"))
    choice = stored(choice.join(bodies.select("rep", "n"), "rep"), "choice")
    groups = choice.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("salts"))
    sent = choice.join(groups, "lead").select("rep", "lead", F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"))
    sent = sent.unionByName(groups.select(F.col("lead").alias("rep"), "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    first = roots(grouped_edges(bodies.join(sent, "rep"), "lead", "salt", leader_edges(percent), ["rep", "set"]))

    # Round two: buckets that still hold several components.
    placed = stored(labelled(members.select("key", "rep"), first, "rep", "comp"), "placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = placed.join(open_keys, "key").select(F.col("key").alias("grp"), "rep", "comp")
    keys = rest.groupBy("rep").agg(F.collect_list("grp").alias("keys"))  # as many as there are bands
    rest = stored(rest.join(keys, "rep").join(classes.select("rep", "n"), "rep"), "open")
    blocks = stored(residual_blocks(rest), "blocks")
    each = blocks.select("grp", "block").distinct()
    pairs = each.select("grp", F.col("block").alias("x")).join(each.select("grp", F.col("block").alias("y")), "grp").where((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & F.col("x.pure").isNull()))
    pairs = pairs.where(~F.coalesce(F.col("x.pure") == F.col("y.pure"), F.lit(False))).select("grp", F.xxhash64("x.pure", "x.number", "y.pure", "y.number").alias("task"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    tasks = blocks.join(pairs, ["grp", "block"]).select("grp", "task", "rep", "comp", "keys", F.xxhash64("block.pure", "block.number").alias("block"))
    second = components(grouped_edges(bodies.select("rep", "set").join(tasks, "rep"), "grp", "task", block_edges(percent), ["rep", "comp", "block", "keys", "set"]))
    final = labelled(first, second, "label", "last").select("node", F.col("last").alias("label"))
    # Roots aren't nodes of `first`: those with members, and those that only round two has linked.
    final = final.unionByName(labelled(first.select("label").distinct(), second, "label", "last").select(F.col("label").alias("node"), F.col("last").alias("label")))
    final = final.unionByName(second.join(first.select(F.col("label").alias("node")).distinct(), "node", "left_anti"))
    final = stored(final, "components")
    for gone in (bodies, members, placed, rest, blocks):
        discard(gone)

    # A component is named by its smallest id; its first document by (doc_id, text_key) is kept.
    linked = final.join(classes.select(F.col("rep").alias("node"), "doc_id", "text_key"), "node")
    best = linked.groupBy("label").agg(F.min(F.struct("doc_id", "text_key", "node")).alias("best"))
    named = final.join(best, "label").select(F.col("node").alias("rep"), F.col("best.doc_id").alias("first_id"), (F.col("best.node") == F.col("node")).alias("leads"))
    classified = classes.join(named, "rep", "left").select("one", "two", "rows", F.coalesce("first_id", "doc_id").alias("component_id"), F.when(F.coalesce("leads", F.lit(True)), F.col("text_key")).alias("keep_key"))
    out = lookup(full.select("doc_id", "text_key", "n", "one", "two"), classified, ["one", "two"], ["component_id", "keep_key"], sig.count())
    kept = (F.col("doc_id") == F.col("component_id")) & F.col("text_key").eqNullSafe(F.col("keep_key"))
    out = out.select("doc_id", "text_key", "n", "component_id", kept.alias("kept"))
    out = out.unionByName(sig.where("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), "text_key", F.col("n").alias("n_shingles"), real("component_id"), "kept")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], total: int) -> DataFrame:
    """rows joined with table, which has one row per key and says in `rows` how many rows have it.
    Heavy keys (fewer than HEAVY) go by broadcast, so that none of them meets in one task."""
    limit = total // HEAVY
    heavy = rows_literal(rows.sparkSession, [tuple(r) for r in table.where(F.col("rows") > limit).select(*keys, *values).limit(HEAVY + 1).collect()], ",".join(f"{k} bigint" for k in [*keys, *values]))
    hot = rows.join(F.broadcast(heavy), keys)
    cold = rows.join(F.broadcast(heavy), keys, "left_anti").join(table.where(F.col("rows") <= limit).drop("rows"), keys)
    return hot.select(*rows.columns, *values).unionByName(cold.select(*rows.columns, *values))


def op2_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of documents that share a shingle, and what can be reached by links.
OP2_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT r, len(ws) AS k, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT r, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS s FROM p WHERE k >= 3 WINDOW w AS (PARTITION BY r ORDER BY i)),
sets AS (SELECT DISTINCT r, s FROM g WHERE s IS NOT NULL UNION ALL SELECT r, array_to_string(ws, ' ') FROM d WHERE len(ws) IN (1, 2)),
n AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, edges.y FROM reach JOIN edges ON edges.x = reach.t),
least_of AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN least_of USING (r) LEFT JOIN n USING (r)
"""
