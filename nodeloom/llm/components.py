"""Connected components of an edge table by alternating large-star and small-star steps.

Up to ONE_TASK edges of whole-number nodes are joined by one task, whose bound does not grow with the data; beyond that,
every round is two aggregations and two equi-joins; the number of rounds is logarithmic. Between rounds the edges
are written to the shared folder, so lineage stays short and a lost executor costs one round at most. A round uses a
task for each EDGES_A_TASK edges, as far as there are shuffle partitions: few edges need few tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

EDGES_A_TASK, ONE_TASK = 100_000, 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Link, for each node, its larger (or smaller) neighbours and itself to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), in order, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        # the greater root of each edge hangs below the least one that it meets, then all nodes go up to their roots
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        found = least_reachable(rows.column("u").to_numpy(), rows.column("v").to_numpy())
        yield pa.record_batch([pa.array(x) for x in found], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the least node reachable.

    Null ends and self links are ignored; an empty edge table gives no rows.
    """
    now = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if dict(now.dtypes) == {"u": "bigint", "v": "bigint"} and now.count() <= ONE_TASK:
        out = materialize(_in_one_task(now), "components")
        discard(now)
        return out
    before = mark(now)
    while before[0]:
        after = materialize(_star(_star(now, True), False), "edges", tasks=1 + before[0] // EDGES_A_TASK)
        discard(now)
        now, seen = after, mark(after)
        if seen == before:
            break
        before = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    both = roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = materialize(both, "components", tasks=1 + before[0] // EDGES_A_TASK)
    discard(now)
    return out
