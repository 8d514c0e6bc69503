"""All pairs of vectors in blocks: a task multiplies two blocks, and only what its nodes keep of the pairs leaves it.

Vectors are frames of node and x (array of doubles), dealt to blocks of about BLOCK nodes by a hash. Each vector goes to
one task for each block of its group, so the shuffle is nodes times blocks; a task holds two blocks and a strip of their
products. Pairs are formed within groups of equal values of `by` and equal length of x; a hot group has more blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import tidy

#: Nodes of a block, cells of a strip of products, cells of a strip that is given out whole, and rows of a batch given out.
BLOCK, STRIP, THIN, ROWS = 4096, 1 << 22, 1 << 17, 1 << 17


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(1 + cosine) / 2 of the rows; a zero vector has cosine 0 with all."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return (1 + unit(a) @ unit(b).T) / 2


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The positive part of the rows' products."""
    return np.maximum(a @ b.T, 0.0)


def squared_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0.0)


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -squared_distance(a, b)


def _dealt(vectors: DataFrame, by: list[str], carry: list[str], block: int) -> DataFrame:
    """Each vector once for every block of its group: group columns, lo, hi, side and what is carried."""
    rows = vectors.where(F.col("x").isNotNull()).select("node", "x", *by, *carry).withColumn("_length", F.size("x"))
    keys = [*by, "_length"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    placed = rows.alias("r").join(sizes.alias("s"), same).select("r.*", "s._blocks").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other")).withColumn("_side", (F.col("_own") > F.col("_other")).cast("int")).drop("_blocks", "_own", "_other")


def _run(vectors: DataFrame, by: list[str], carry: list[str], block: int, task: Callable[[pa.Table, pa.Table | None], Iterator[dict]], schema: str, names: list[str]) -> DataFrame:
    """`task` on each pair of blocks: it gets their rows by node (None as the second for a block with itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        side = group.column("_side").to_numpy()
        lo, hi = group.column("_lo")[0].as_py(), group.column("_hi")[0].as_py()
        one = group.filter(pa.array(side == 0)).sort_by("node")
        two = None if lo == hi else group.filter(pa.array(side == 1)).sort_by("node")
        keys = {b: group.column(b)[0] for b in by}
        del group
        for found in task(one, two):  # given out strip by strip, in batches: a task never holds all of its pairs
            arrays = [pa.array(found[n], kinds[n]) for n in names]
            for at in range(0, len(arrays[0]), ROWS):
                part = [a.slice(at, ROWS) for a in arrays]
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(part[0])) for k in keys.values()] + part, names=[*keys, *names])

    kinds = {n: {"long": pa.int64(), "double": pa.float64()}[k] for n, k in (p.split() for p in schema.split(", "))}
    schema = ", ".join([*[f"`{b}` {vectors.schema[b].dataType.simpleString()}" for b in by], schema])
    return _dealt(vectors, by, carry, block).groupBy(*by, "_length", "_lo", "_hi").applyInArrow(run, schema)


def _strips(one: pa.Table, two: pa.Table | None, measure, cells: int | None = None, once: bool = False) -> Iterator[tuple[bool, slice, np.ndarray]]:
    """Products strip by strip: (whether rows are of the first block, the rows, the products with the other block).

    With `once` the second block's rows are not taken in their turn, so that each pair is met once (twice in a block with itself).
    """
    a = _matrix(one.column("x"))
    b = a if two is None else _matrix(two.column("x"))
    for first, left, right in ((True, a, b), (False, b, a)):
        if not first and (once or two is None) or not len(left) or not len(right):
            continue
        step = max(1, (cells or STRIP) // len(right))
        for at in range(0, len(left), step):
            rows = slice(at, min(at + step, len(left)))
            yield first, rows, measure(left[rows], right)


def top_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest finite scores of each row; of equal ones the first columns."""
    k = min(k, scores.shape[1])
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, ties = scores > least, scores == least
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero((above | ties & (np.cumsum(ties, axis=1) <= room)) & np.isfinite(scores))


def best_columns(w: np.ndarray, k: int, digits: int, spans: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """As `top_columns` of `w` rounded to `digits`, but only cells that may be among the k greatest are rounded and ordered.

    The k-th of the maxima of `spans` spans of columns is no greater than the k-th of all cells.
    """
    n = w.shape[1]
    if not k or spans < k or n < 4 * spans:
        return top_columns(np.round(w, digits), k)
    maxima = np.maximum.reduceat(w, np.arange(spans) * n // spans, axis=1)
    least = np.partition(maxima, spans - k, axis=1)[:, spans - k, None]
    if np.isnan(maxima).any():
        return top_columns(np.round(w, digits), k)
    r, c = np.nonzero(w >= least - 2 * 10.0**-digits - 1e-15 * np.abs(least))  # what rounding may lift
    value = np.round(w[r, c], digits)
    finite = np.isfinite(value)
    r, c, value = r[finite], c[finite], value[finite]
    order = np.lexsort((c, -value, r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def nearest(vectors: DataFrame, k: int, measure=cosine, by: list[str] | None = None, unlike: str | None = None, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """src, dst, weight, place (and the columns of `by`): the k others of greatest `measure`, rounded for the order; ties go to the smaller id.

    `by` keeps pairs within groups. `unlike` names a column of whole numbers whose value the other must not share. A
    task gives k others a node at most, of which the k best of all blocks stay.
    """

    def task(one: pa.Table, two: pa.Table | None) -> Iterator[dict]:
        blocks = (one, one if two is None else two)
        ids = [t.column("node").to_numpy() for t in blocks]
        kinds = [t.column(unlike).to_numpy(zero_copy_only=False) for t in blocks] if unlike else None
        for first, rows, w in _strips(one, two, measure):
            i, j = (0, 1) if first else (1, 0)
            if two is None:  # a node is in one block
                w[ids[i][rows][:, None] == ids[j]] = -np.inf
            if kinds:
                w[kinds[i][rows][:, None] == kinds[j]] = -np.inf
            r, c = best_columns(w, k, digits)
            yield {"src": ids[i][rows][r], "dst": ids[j][c], "weight": w[r, c]}

    found = _run(vectors, by or [], [unlike] if unlike else [], block, task, "src long, dst long, weight double", ["src", "dst", "weight"])
    over = Window.partitionBy("src").orderBy(F.round("weight", digits).desc(), "dst")
    return found.withColumn("place", F.row_number().over(over)).where(F.col("place") <= k)


def _couples(ids: list[np.ndarray], rows: slice, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ids of each cell of a strip, and whether the cell counts: a pair is met once, none with itself."""
    src, dst = np.broadcast_arrays(ids[0][rows][:, None], ids[1])
    return src, dst, src < dst if same else src != dst


def every(vectors: DataFrame, measure=product, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """src, dst, weight (and the columns of `by`) of all pairs, src < dst: as many rows as pairs, for what needs each of them."""

    def task(one: pa.Table, two: pa.Table | None) -> Iterator[dict]:
        ids = [t.column("node").to_numpy() for t in (one, one if two is None else two)]
        for _, rows, w in _strips(one, two, measure, THIN, once=True):
            src, dst, keep = _couples(ids, rows, two is None)
            yield {"src": np.minimum(src, dst)[keep], "dst": np.maximum(src, dst)[keep], "weight": w[keep]}

    return _run(vectors, by or [], [], block, task, "src long, dst long, weight double", ["src", "dst", "weight"])


def lagged(vectors: DataFrame, lags: np.ndarray, measure, best: bool, by: list[str], block: int = BLOCK) -> DataFrame:
    """x, y, lag, r, n (and the columns of `by`) of all pairs x < y: `measure` gives r and n of one strip for each lag of y against x; a lag with n = 0 is left out.

    With `best` only the lag of the greatest r, rounded to nine digits, NaN above all; of equal ones the least. The lags are symmetric about 0.
    """

    def task(one: pa.Table, two: pa.Table | None) -> Iterator[dict]:
        ids = [t.column("node").to_numpy() for t in (one, one if two is None else two)]
        for _, rows, found in _strips(one, two, measure, THIN, once=True):
            src, dst, keep = _couples(ids, rows, two is None)
            x, y = np.minimum(src, dst)[keep], np.maximum(src, dst)[keep]
            turned = (src > dst)[keep]
            r, n = (np.stack([f[part][keep] for f in found]) for part in (0, 1))
            r, n = np.where(turned, r[::-1], r), np.where(turned, n[::-1], n)
            if best:
                order = np.where(n > 0, np.where(np.isnan(r), np.inf, np.round(r, 9)), -np.inf)
                at = order.argmax(axis=0)
                i = np.flatnonzero((n > 0).any(axis=0))
                yield {"x": x[i], "y": y[i], "lag": lags[at[i]], "r": r[at[i], i], "n": n[at[i], i].astype(np.int64)}
            else:
                for k, lag in enumerate(lags):
                    i = np.flatnonzero(n[k] > 0)
                    yield {"x": x[i], "y": y[i], "lag": np.full(len(i), lag), "r": r[k, i], "n": n[k, i].astype(np.int64)}

    return _run(vectors, by, [], block, task, "x long, y long, lag long, r double, n long", ["x", "y", "lag", "r", "n"])


def quantiles(vectors: DataFrame, shares: list[float], measure=product, by: list[str] | None = None, block: int = BLOCK) -> tuple[int, list[float]]:
    """The number of pairs, and exact quantiles (interpolated between neighbours) of their measures, none of them negative; NaN is no pair.

    The order of such numbers is that of their bits. Passes over the pairs count the leading bits, then the next ones
    below the prefixes in which the wanted ranks lie; where few values are left, a pass counts all the rest of the bits.
    A pass gives out a count for each of at most 2^20 values of a prefix. `vectors` are read once for each pass.
    """

    def counted(prefixes: np.ndarray | None, shift: int, width: int) -> pd.DataFrame:
        def task(one: pa.Table, two: pa.Table | None) -> Iterator[dict]:
            ids = [t.column("node").to_numpy() for t in (one, one if two is None else two)]
            kept: list[np.ndarray] = []
            held = 0

            def given() -> dict:
                keys, n = np.unique(np.concatenate(kept) if kept else np.zeros(0, np.int64), return_counts=True)
                return {"key": keys, "n": n.astype(np.int64)}

            dense = np.zeros(1 << width, dtype=np.int64) if prefixes is None else None
            for _, rows, w in _strips(one, two, measure, THIN, once=True):
                _, _, keep = _couples(ids, rows, two is None)
                w = w[keep & ~np.isnan(w)]
                bits = (w + 0.0).view(np.int64) >> shift  # -0.0 becomes 0.0
                if dense is not None:
                    dense += np.bincount(bits, minlength=len(dense))
                    continue
                upper = bits >> width
                kept.append(bits[np.logical_or.reduce([upper == p for p in prefixes])])
                held += len(kept[-1])
                if held > STRIP:
                    yield given()
                    kept, held = [], 0
            if dense is not None:
                yield {"key": np.flatnonzero(dense), "n": dense[dense > 0]}
            else:
                yield given()

        with tidy(vectors.sparkSession):
            found = _run(vectors, by or [], [], block, task, "key long, n long", ["key", "n"])
            return found.groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")

    def places(table: pd.DataFrame, width: int, wanted: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The key, the rank below it and the count of each wanted (prefix, rank in the prefix)."""
        out = []
        for prefix, rank in wanted:
            part = table[table["key"].to_numpy() >> width == prefix] if prefix >= 0 else table
            upto = part["n"].cumsum().to_numpy()
            i = min(int(np.searchsorted(upto, rank, side="right")), len(part) - 1)
            out.append((int(part["key"].iloc[i]), rank - int(upto[i - 1] if i else 0), int(part["n"].iloc[i])))
        return out

    left, width = 64 - 20, 20
    table = counted(None, left, width)
    total = int(table["n"].sum())
    if not total:
        return 0, [float("nan")] * len(shares)
    at = [q * (total - 1) for q in shares]
    ranks = sorted({r for p in at for r in (int(np.floor(p)), int(np.ceil(p)))})
    found = places(table, width, [(-1, r) for r in ranks])
    while left:
        few = sum({k: n for k, _, n in found}.values()) <= 1 << 17
        width = left if few else min(left, 16)
        left -= width
        table = counted(np.unique([k for k, _, _ in found]), left, width)
        found = places(table, width, [(k, r) for k, r, _ in found])
    value = dict(zip(ranks, np.array([k for k, _, _ in found], dtype=np.int64).view(np.float64).tolist(), strict=True))
    return total, [float(value[int(np.floor(p))] + (value[int(np.ceil(p))] - value[int(np.floor(p))]) * (p - np.floor(p))) for p in at]


def distance_sums(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, place, label, other, total, n: the sum of Euclidean distances of each node to the other nodes of each label.

    `labels` is an array, one label for each of several partitions (place 0 and on), for which distances are taken once.
    """

    def task(one: pa.Table, two: pa.Table | None) -> Iterator[dict]:
        blocks = (one, one if two is None else two)
        ids = [t.column("node").to_numpy() for t in blocks]
        labels = [_matrix(t.column("labels")).astype(np.int64) for t in blocks]
        for first, rows, d2 in _strips(one, two, squared_distance):
            i, j = (0, 1) if first else (1, 0)
            d = np.sqrt(d2)
            own = ids[i][rows][:, None] == ids[j]
            d[own] = 0.0
            itself = own.any(axis=1)
            for place in range(labels[j].shape[1]):
                names, at = np.unique(labels[j][:, place], return_inverse=True)
                member = np.eye(len(names))[at]
                mine = labels[i][rows, place]
                n = np.bincount(at, minlength=len(names)) - (itself[:, None] & (mine[:, None] == names))
                yield {
                    "node": np.repeat(ids[i][rows], len(names)), "place": np.full(n.size, place), "label": np.repeat(mine, len(names)), "other": np.tile(names, len(mine)),
                    "total": (d @ member).reshape(-1), "n": n.reshape(-1).astype(np.int64),
                }

    schema = "node long, place long, label long, other long, total double, n long"
    found = _run(vectors, [], ["labels"], block, task, schema, ["node", "place", "label", "other", "total", "n"])
    return found.where("n > 0").groupBy("node", "place", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
