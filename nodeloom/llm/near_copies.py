"""Near copies: SimHash first, verified on whole shingle sets, then an exact join for the pairs that no radius of SimHash finds.

Two texts are near copies if their sets of WORDS-word shingles have a Jaccard index of 0.8 or more. Fingerprints of the
same shingles within BITS bits, found by the deletion-variant index, propose pairs; the sets verify them, and what they
join is not compared again. Pairs further apart than any indexable radius are found exactly: with shingles in one order,
rare ones first, two such sets share a shingle among the first n - ceil(4 n / 5) + 1 of each, so an equality join on
those finds every pair, and the sets verify it, once sketches of a quarter to half a byte for each shingle have ruled
out most pairs that are not near copies: a bit that only one of two sketches has is a shingle that only one set has. The order comes from SLOTS counters of hashed shingles: any order gives
the same pairs, a rare-first one gives few candidates. What a set has left from its place of the first shared shingle on
bounds what it shares; where that is too little for the smallest set of a shingle, it leaves that shingle. Where many sets
share a shingle, PIVOTS of them are compared with all others that are not yet in their component, and leave: at first
those with most left, as the text that the others are copies of has few rare shingles of its own and joins them by one
comparison each, later those of the least components. Each round takes GROWTH times as many, until those left are one
component. Every pair is compared, joined or ruled out by that bound by then; none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import chosen, discard, materialize, remembered, row_keys
from .components import connected_components

BITS = 3
WORDS, SLOTS, PIECE, PIVOTS, GROWTH, LANES = 5, 1 << 20, 1024, 1, 8, 8
#: Rows that a task of a shuffle gets where their number is known: members of keys, comparisons, pairs with their sketches and with their sets.
MEMBERS_A_TASK, COMPARED_A_TASK, SKETCHED_A_TASK, PAIRS_A_TASK = 100_000, 500_000, 5_000, 100
#: Candidates whose ends are sent to the sets; the ends of more meet the sets in a shuffle of both.
SENT = 250_000


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64)))


def _sketch(found: np.ndarray) -> np.ndarray:
    """A bitmap of a set's hashes modulo its length, as 64-bit words: the least power of two that has two bits for each hash."""
    bits = 64
    while bits < 2 * len(found):
        bits *= 2
    out = np.zeros(bits, dtype=np.uint8)
    out[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, key_col: str | None = None) -> DataFrame:
    """doc_id, row_key, node (a hash of the set), fp (the SimHash), size, sketch and the set, for every row; texts of one set are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("near_copies")
        for batch in batches:
            for start in range(0, len(batch), 1024):
                some = batch.slice(start, 1024)
                hashes = [simhash.shingle_hashes(x.as_py(), words) for x in some.column(1)]
                prints = np.array([simhash.majority(x) for x in hashes], dtype=np.uint64).view(np.int64)
                found = [np.unique(x) for x in hashes]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in found], dtype=np.uint64).view(np.int64)
                sizes, sketches = pa.array([len(x) for x in found], pa.int32()), _lists([_sketch(x) for x in found])
                yield pa.record_batch([some.column(0), some.column(2), pa.array(nodes), pa.array(prints), sizes, sketches, _lists(found)], names=["doc_id", "row_key", "node", "fp", "size", "sketch", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    key = (F.col(key_col) if key_col else F.monotonically_increasing_id()).cast("long").alias("row_key")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"), key)
    return rows.mapInArrow(run, f"doc_id {kind}, row_key long, node long, fp long, size int, sketch array<long>, shingles array<long>")


def _proposed(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints lie within BITS bits: one pair for each two linked fingerprints, and each node with the least of its own fingerprint."""
    nodes = sets.where("size(shingles) > 0").select("node", "fp").groupBy("node").agg(F.min("fp").alias("fp"))
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    own = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(least.select("fp"), BITS).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    ends = linked.join(least.toDF("fa", "x"), "fa").join(least.toDF("fb", "y"), "fb")
    return own.unionByName(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _levels(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot are, in steps of a quarter octave: SLOTS bytes, whatever the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.uint32)
        for batch in batches:
            slots = batch.column(0).flatten().to_numpy() & (SLOTS - 1)
            for start in range(0, len(slots), SLOTS):
                total += np.bincount(slots[start : start + SLOTS], minlength=SLOTS).astype(np.uint32)
        for start in range(0, SLOTS, 16 * PIECE):
            pieces = total[start : start + 16 * PIECE].reshape(-1, PIECE)
            numbers = pa.array(range(start // PIECE, start // PIECE + len(pieces)), pa.int32())
            yield pa.record_batch([numbers, pa.array([x.tobytes() for x in pieces], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(np.int64)
        levels = [np.minimum(255, 4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    parts = sets.select("shingles").mapInArrow(count, schema).repartition(LANES, "piece").mapInArrow(add, schema)
    out = np.zeros((SLOTS // PIECE, PIECE), dtype=np.uint8)
    for r in parts.collect():  # SLOTS / PIECE rows
        out[r["piece"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.reshape(-1)


def _prefixes(sets: DataFrame, levels: np.ndarray) -> DataFrame:
    """node, size of its set, and its first shingles: (key, place) for each."""
    shared = sets.sparkSession.sparkContext.broadcast(levels.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            sizes, found = [], []
            for x in batch.column(1):
                s = x.values.to_numpy(zero_copy_only=False)
                n = len(s)
                sizes.append(n)
                found.append(s[np.lexsort((s, level[s & (SLOTS - 1)]))[: n - (4 * n + 4) // 5 + 1]].view(np.uint64))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), _lists(found)], names=["node", "size", "keys"])

    rows = sets.where("size(shingles) > 0").select("node", "shingles").mapInArrow(run, "node long, size int, keys array<long>")
    return rows.select("node", "size", F.posexplode("keys").alias("place", "key"))


def _missing(x: str, y: str) -> str:
    """How many bits sketch `x` has that `y` has not; the longer of two sketches is folded to the length of the other."""
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (u, v) -> u | v), {0})"
    return f"aggregate(zip_with({fold.format(x, y)}, {fold.format(y, x)}, (u, v) -> bit_count(u & ~v)), 0, (s, k) -> s + k)"


#: What a pair with sets x and y of m and n shingles must meet, and before that its sketches x and y: sets of a Jaccard
#: index of 0.8 differ by a quarter in size at most, so one sketch has at most twice the length of the other.
NEAR = "9 * size(array_intersect(x, y)) >= 4 * (m + n)"
POSSIBLE = f"5 * least(m, n) >= 4 * greatest(m, n) AND 9 * least(m - {_missing('x', 'y')}, n - {_missing('y', 'x')}) >= 4 * (m + n)"


def _kept(pairs: DataFrame, sets: DataFrame, column: str, condition: str, tag: str, a_task: int) -> DataFrame:
    """The pairs (a, b) that meet the condition, with x and y from the column of their sets, and m and n from their sizes."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    n = pairs.count()
    found = sets.join(F.broadcast(ends) if n <= SENT else ends, "node", "left_semi").groupBy("node")
    needed = materialize(found.agg(F.first("size").alias("size"), F.first(column).alias(column)), f"{tag}-needed")
    out = materialize(pairs.join(needed.toDF("a", "m", "x"), "a").join(needed.toDF("b", "n", "y"), "b").where(condition).select("a", "b"), tag, tasks=1 + n // a_task)
    discard(needed)
    return out


def _verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share at least 4/5 of their union; sets are sent for those alone that their sketches leave."""
    possible = _kept(candidates, sets, "sketch", POSSIBLE, "possible-pairs", SKETCHED_A_TASK)
    out = _kept(possible, sets, "shingles", NEAR, "near-pairs", PAIRS_A_TASK)
    discard(possible)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, component_id (the least doc_id reachable by pairs of Jaccard index 0.8 or more), kept, row_key.

    Null texts count as empty; texts without words are copies of each other. A null doc_id keeps its row and is never
    the least id unless all ids of its component are null. Repeated rows stay rows of their own: `kept` marks one row
    of each component, that of the least id and, of rows that share it, the least row_key (the column `key_col`, or the
    row's place). An empty table gives no rows.
    """
    sets = materialize(shingle_sets(docs, id_col, text_col, key_col=key_col), "shingle-sets")
    proposed = materialize(_proposed(sets), "proposed")
    edges = _verified(proposed, sets)
    groups = connected_components(edges, "a", "b")
    for done in (proposed, edges):
        discard(done)
    by_key = Window.partitionBy("key")
    # most shingles are those of one set: they go before anything is joined, in the one shuffle of all prefixes
    shared = _prefixes(sets, _levels(sets)).withColumn("low", F.min("node").over(by_key)).withColumn("high", F.max("node").over(by_key)).where("low < high")
    prefixes = materialize(shared.groupBy("key", "node").agg(F.min("size").alias("size"), F.min("place").alias("place")), "prefixes")
    members = _open(prefixes, groups, by_key, True)
    discard(prefixes)
    pivots = PIVOTS
    while rows := members.count():
        left = members.where(F.col("rank") < pivots).select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "place", "rank", "component")])
        # at the first shingle that a pair shares, what both have left from there on must suffice
        candidates = materialize(
            left.join(members, "key")
            .where("rank > rank_a AND component <> component_a AND 9 * least(size - place, size_a - place_a) >= 4 * (size + size_a)")
            .select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b"))
            .distinct(),
            "candidates",
            tasks=1 + rows * pivots // COMPARED_A_TASK,
        )
        edges = _verified(candidates, sets)
        discard(candidates)
        # what was linked before is a star for each component by now: only those and the new pairs are joined
        stars = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
        older, groups = groups, connected_components(stars.unionByName(edges), "a", "b")
        waiting = members.where(F.col("rank") >= pivots).drop("component", "rank")
        before, members = members, _open(waiting, groups, by_key, False, 1 + rows // MEMBERS_A_TASK)
        for done in (before, older, edges):
            discard(done)
        pivots *= GROWTH
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    nodes = sets.groupBy("node").agg(first.alias("first"))
    labelled = materialize(nodes.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "labels")
    least = labelled.groupBy("component").agg(F.min("first").alias("first"))
    found = sets.select("doc_id", "row_key", "node").join(labelled.join(least.withColumnRenamed("first", "best"), "component").select("node", "best"), "node")
    out = materialize(found.select("doc_id", F.col("best.doc_id").alias("component_id"), (F.col("row_key") == F.col("best.row_key")).alias("kept"), "row_key"), "near-copies")
    discard(sets)
    return out


def _open(members: DataFrame, groups: DataFrame, by_key, first: bool, tasks: int | None = None) -> DataFrame:
    """The rows of `members` with component and rank, of those keys that more than one component shares, where enough is left for the smallest set of the key.

    Least components come first, of each those with most left from the key on; in the first round that alone counts.
    """
    now = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    for name, column in (("low", F.min("component")), ("high", F.max("component")), ("smallest", F.min("size"))):
        now = now.withColumn(name, column.over(by_key))
    now = now.where("low < high AND 9 * (size - place) >= 4 * (size + smallest)").withColumn("mine", F.count(F.lit(1)).over(Window.partitionBy("key", "component")))
    order = by_key.orderBy(*[] if first else ["mine"], F.expr("place - size"), "node")
    return materialize(now.withColumn("rank", F.row_number().over(order) - 1).select("key", "node", "size", "place", "rank", "component"), "members", tasks=tasks)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one of each component of near copies: the one that near_components keeps. Repeated ids are told apart."""
    rows, key = row_keys(docs, id_col, "rows-shingled")
    # those that go are few: they meet the texts, not those that stay
    return chosen(rows, key, near_components(rows, id_col, text_col, key).where("NOT kept").select("row_key"), docs, "left_anti")
