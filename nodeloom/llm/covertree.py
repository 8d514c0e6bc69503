"""Exact embedding near-duplicates by dual traversal of cover trees.

Unit vectors within angle arccos(t) lie within distance sqrt(2 - 2t). Equal vectors of a label are one node with a
multiplicity. Nodes are dealt to cells by their nearest pivot, cells are cut into leaves of the deal of CELL nodes at
most, and a pair of such parts is a task if the triangle inequality over centres and covering radii does not rule it
out. In a task each part becomes a cover tree: nested levels whose centres are kept from level to level, with halving
radii, every node knowing its true covering radius. A dual traversal drops node pairs by these bounds and computes
exact cosines at the leaves. A task returns a count of links for each vector and a spanning forest of its links, so
that a dense group costs no more output than a sparse one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

THRESHOLD, CELL, PIVOTS, LEAF = 0.93, 2_000, 16, 48
#: Slack of radii and bounds against rounding (a distance from a product is good to 3e-8); exact cosines decide.
SLACK = 1e-7


def _gaps(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from one of them."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ centre)))


class Tree:
    """A cover tree over rows of unit vectors: arrays of centre, radius, children and points of each node."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        if len(x):
            self._grow(np.arange(len(x)), 0, 2.0)

    def _node(self, centre: int, points: np.ndarray, away: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(away.max(initial=0.0)) + SLACK)
        self.children.append([])
        self.points.append(points)
        return len(self.centre) - 1

    def _grow(self, points: np.ndarray, centre: int, scale: float) -> None:
        away = _gaps(self.x[points], self.x[centre])
        todo = [(self._node(centre, points, away), away, scale)]
        while todo:
            node, away, scale = todo.pop()
            points, centre = self.points[node], self.centre[node]
            if len(points) <= LEAF or self.radius[node] < 2 * SLACK:
                continue
            while scale >= self.radius[node]:
                scale /= 2
            # a net of the next level: the centre stays, each further centre is more than `scale` from those before
            own, owner, best = self.x[points], np.zeros(len(points), dtype=np.int64), away.copy()
            centres = [centre]
            while True:
                far = int(best.argmax())
                if best[far] <= scale:
                    break
                centres.append(int(points[far]))
                gap = _gaps(own, own[far])
                closer = gap < best
                owner[closer], best[closer] = len(centres) - 1, gap[closer]
            for k, c in enumerate(centres):
                mine = owner == k
                child = self._node(c, points[mine], best[mine])
                self.children[node].append(child)
                todo.append((child, best[mine], scale))


def _expand(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes, and for each the place of its parent among `nodes`; leaves stand for themselves."""
    lists = [tree.children[n] or [n] for n in nodes.tolist()]
    return np.array([c for some in lists for c in some], dtype=np.int64), np.repeat(np.arange(len(nodes)), [len(s) for s in lists])


def dual(a: Tree, b: Tree, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of a, rows of b) with cosine >= threshold; each unordered pair once if the trees are the same."""
    if not len(a.x) or not len(b.x):
        return
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    centre_a, centre_b, radius_a, radius_b = np.array(a.centre), np.array(b.centre), np.array(a.radius), np.array(b.radius)
    leaf_a, leaf_b = np.array([not c for c in a.children]), np.array([not c for c in b.children])
    todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        i, j = todo.pop()
        if len(i) > 200_000:  # a bounded frontier
            todo += [(i[k : k + 100_000], j[k : k + 100_000]) for k in range(0, len(i), 100_000)]
            continue
        gap = np.empty(len(i))
        for k in range(0, len(i), 8192):
            products = np.einsum("ij,ij->i", a.x[centre_a[i[k : k + 8192]]], b.x[centre_b[j[k : k + 8192]]])
            gap[k : k + 8192] = np.sqrt(np.maximum(0.0, 2 - 2 * products))
        near = gap <= reach + radius_a[i] + radius_b[j] + SLACK
        i, j = i[near], j[near]
        ends = leaf_a[i] & leaf_b[j]
        for m, n in zip(i[ends].tolist(), j[ends].tolist(), strict=True):
            p, q = a.points[m], b.points[n]
            hit = a.x[p] @ b.x[q].T >= threshold
            if same and m == n:
                hit &= p[:, None] < q[None, :]
            r, c = np.nonzero(hit)
            if len(r):
                yield p[r], q[c]
        i, j = i[~ends], j[~ends]
        if not len(i):
            continue
        if same:  # both sides go down together; only a node with itself gives its pairs of children twice
            left, up = _expand(a, i)
            right, again = _expand(b, j[up])
            left, twin = left[again], (i == j)[up][again]
            once = ~twin | (left <= right)
            todo.append((left[once], right[once]))
            continue
        wide = (radius_a[i] >= radius_b[j]) & ~leaf_a[i] | leaf_b[j]
        if wide.any():
            down, up = _expand(a, i[wide])
            todo.append((down, j[wide][up]))
        if not wide.all():
            down, up = _expand(b, j[~wide])
            todo.append((i[~wide][up], down))


class Forest:
    """Union-find by rows; what it keeps of the links is a spanning forest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.vstack([np.frombuffer(v) for v in column]) if len(column) else np.zeros((0, 1))


def _compare(threshold: float):
    """Links within a part, or between the two sides of a pair of parts (side 0 and 1)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = bool(group["own"].iloc[0])
        sides = [group] if own else [group[group["side"] == 0], group[group["side"] == 1]]
        trees = [Tree(_vectors(s["unit"])) for s in sides]
        a, b = trees[0], trees[-1]
        ids = np.concatenate([s["node"].to_numpy() for s in sides])
        times = [s["copies"].to_numpy(dtype=np.int64) for s in sides]
        shift = 0 if own else len(times[0])
        counts = np.zeros(len(ids), dtype=np.int64)
        forest = Forest(len(ids))
        for p, q in dual(a, b, threshold, own):
            np.add.at(counts, p, times[-1][q])
            np.add.at(counts, q + shift, times[0][p])
            for i, j in zip(p.tolist(), (q + shift).tolist(), strict=True):
                forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(ids))], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
        out = pd.DataFrame({"node": ids, "links": counts, "up": ids[roots] if len(ids) else ids})
        return out[out["links"] > 0]

    return run


def _unit(embedding: pd.Series) -> pd.Series:
    """Unit vectors in double precision as bytes; None for what links with nothing."""
    out = []
    for v in embedding:
        x = np.array([np.nan if y is None else y for y in v], dtype=float) if v is not None and len(v) else np.full(1, np.nan)
        top = np.abs(x).max() if len(x) else 0.0
        if not np.isfinite(x).all() or top == 0:
            out.append(None)
            continue
        x = x / top  # no overflow or underflow of the norm
        out.append((x / np.sqrt(x @ x)).tobytes())
    return pd.Series(out, dtype=object)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = THRESHOLD,
    cell: int = CELL,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least `threshold` (above 0). Null, empty or zero vectors and those with null or non-finite
    components link with nothing. `component_id` is the least id reachable (null ids are never least); a row without
    links has its own. Repeated rows are vectors of their own and link with each other. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold in (0, 1]")
    kind = vectors.schema[id_col].dataType.simpleString()
    label = F.col(label_col).cast("string") if label_col else F.lit("")

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(pd.Series(batch.column(1).to_pylist(), dtype=object))
            yield pa.record_batch([batch.column(0), pa.array(units.tolist(), pa.binary()), batch.column(2)], names=["vec_id", "unit", "label"])

    rows = materialize(
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col), label.alias("label"))
        .mapInArrow(normalise, f"vec_id {kind}, unit binary, label string")
        .withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("group", F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), F.concat_ws(":", F.length("unit"), "label"))),
        "vectors",
    )
    nodes = materialize(
        rows.where("group IS NOT NULL").groupBy("group", "unit").agg(F.min("row_no").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")), "nodes"
    )
    # as many pivots as cells are needed, PIVOTS at most: each part meets all others of its group that bounds allow
    sized = nodes.groupBy("group").agg(F.least(F.lit(PIVOTS), F.ceil(F.count(F.lit(1)) / cell)).alias("lanes"))
    digest = F.xxhash64("unit")
    lanes = nodes.join(sized, "group").groupBy("group", F.pmod(digest, F.col("lanes")).alias("lane")).agg(F.min_by("unit", digest).alias("unit"))
    pivots = lanes.groupBy("group").agg(F.sort_array(F.collect_list("unit")).alias("pivots"))

    @F.pandas_udf("pivot int, away double")
    def deal(unit: pd.Series, pivots: pd.Series) -> pd.DataFrame:
        place, away = np.zeros(len(unit), dtype=np.int32), np.zeros(len(unit))
        keys = pivots.map(lambda p: hash(tuple(p)))
        for _, index in unit.groupby(keys).groups.items():
            at = unit.index.get_indexer(index)
            x, c = _vectors(unit.loc[index]), np.vstack([np.frombuffer(v) for v in pivots.loc[index[0]]])
            for k in range(0, len(x), 4096):
                gaps = np.sqrt(np.maximum(0, 2 - 2 * x[k : k + 4096] @ c.T))
                place[at[k : k + 4096]], away[at[k : k + 4096]] = gaps.argmin(axis=1), gaps.min(axis=1)
        return pd.DataFrame({"pivot": place, "away": away})

    dealt = nodes.join(pivots, "group").withColumn("d", deal("unit", "pivots"))
    dealt = dealt.select("group", "unit", "node", "copies", F.col("d.pivot").alias("pivot"), F.col("d.away").alias("away"), F.col("pivots")[F.col("d.pivot")].alias("centre"))
    sizes = dealt.groupBy("group", "pivot").agg(F.count(F.lit(1)).alias("cell_n"))
    # a cell over the limit is cut evenly, so that one crowded direction is shared by several tasks
    parted = (
        dealt.join(sizes, ["group", "pivot"])
        .withColumn("cuts", F.expr(f"cast(ceil(cell_n / {cell}) as int)"))
        .withColumn("part", F.when(F.col("cuts") <= 1, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("cuts").cast("long")).cast("int")))
    )
    placed = materialize(parted.select("group", "pivot", "part", "centre", "away", "unit", "node", "copies"), "cells")
    parts = placed.groupBy("group", "pivot", "part").agg(F.first("centre").alias("centre"), F.max("away").alias("radius"))
    parts = materialize(parts.withColumn("part_id", F.row_number().over(Window.partitionBy("group").orderBy("pivot", "part"))), "parts")
    left = parts.select("group", F.col("part_id").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    right = parts.select("group", F.col("part_id").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    @F.pandas_udf("double")
    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.linalg.norm(np.frombuffer(x) - np.frombuffer(y))) for x, y in zip(a, b, strict=True)], dtype=float)

    pairs = left.join(right, "group").where("a <= b").withColumn("gap", gap("ca", "cb")).where(F.col("gap") <= reach + F.col("ra") + F.col("rb")).select("group", "a", "b")
    members = placed.join(parts.select("group", "pivot", "part", "part_id"), ["group", "pivot", "part"]).select("group", "part_id", "unit", "node", "copies")
    one = pairs.join(members.withColumnRenamed("part_id", "a"), ["group", "a"]).select("group", "a", "b", F.lit(0).alias("side"), (F.col("a") == F.col("b")).alias("own"), "unit", "node", "copies")
    two = pairs.where("a < b").join(members.withColumnRenamed("part_id", "b"), ["group", "b"]).select("group", "a", "b", F.lit(1).alias("side"), F.lit(False).alias("own"), "unit", "node", "copies")
    linked = materialize(one.unionByName(two).groupBy("group", "a", "b").applyInPandas(_compare(threshold), "node long, links long, up long"), "links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    trees = connected_components(linked.select("node", "up"), "node", "up")
    found = nodes.join(counts, "node", "left").join(trees, "node", "left").select("group", "unit", "copies", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    found = materialize(found, "found")
    least = found.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = found.join(least, "component").select("group", "unit", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    with_links = rows.where("group IS NOT NULL").join(by_node, ["group", "unit"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("group IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_links.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
         embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
         AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS valid
  FROM embeddings),
e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.valid AND b.valid
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {THRESHOLD}),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""
