"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a share of all words by its weight, at most `limit` times its own words. A document is taken
floor(rate) times for certain and once more with probability frac(rate); which documents get the extra copy is a
balanced sample: the inclusion probabilities move through the null space of two constraints, the number of documents
and the number of words, until they are 0 or 1. The flight runs in blocks of bounded size and leaves two undecided
documents per block at most; those of FAN blocks fly again together, until one block per source is left. There the
last few units land: a handful held back and the two left over are decided by the subset nearest the target.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, row_keys, spare

#: Documents in a block of the first flight, and blocks whose leftovers fly together afterwards.
BLOCK, FAN = 20_000, 2_000
#: Documents of a source that the flight leaves to the landing, besides its own two.
LANDING = 14
#: Sources whose plan is broadcast; with more of them it is joined.
SOURCES = 50_000
EPS = 1e-9


def plan(sized: DataFrame, weights: tuple[float, ...], limit: float, block: int) -> DataFrame:
    """One row per source: source, source_no, source_size, target, whole, p, blocks. No source's row goes to the driver.

    Each gets a share of all words by its weight. A target stops at `limit` times the source's size; the excess is
    shared again by weight among the others, until none is above. Sources without words get nothing.

    Sources are numbered by code point, null last, within ranges of the sorted table and by the ranges' offsets, so no
    task sorts them all. A round of sharing is one sum over the table: a source is at its limit if the level of words
    for a unit of weight would give it more; levels only rise, and no round without a new source at its limit follows.
    """
    none = F.col("source").isNull()
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    dealt = totals.repartitionByRange(none, F.col("source")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "sources")
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(none, "source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    # `before` has a row per partition of the shuffle above
    numbered = dealt.withColumn("within", within).join(F.broadcast(before.select("part", "before")), "part").select(
        "source", (F.col("before") + F.col("within") - 1).cast("int").alias("source_no"), "words", "n"
    )
    table = materialize(numbered.withColumn("weight", turn).withColumn("most", F.lit(float(limit)) * F.col("words")), "source-weights")
    total = float(table.agg(F.sum("words")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("most")
        row = table.agg(
            F.sum(F.when(over, F.col("most"))).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("full")
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (total - (row["given"] or 0.0)) / row["open"]
    target = F.least(F.col("weight") * level, F.col("most"))
    rate = F.coalesce(F.try_divide(target, F.col("words")), F.lit(0.0))
    whole = F.floor(rate + EPS).cast("int")
    return table.select(
        "source", "source_no", F.col("words").alias("source_size"), target.alias("target"), whole.alias("whole"),
        F.greatest(F.lit(0.0), rate - whole).alias("p"), F.ceil(F.col("n") / block).alias("blocks"),
    )


def _draws(seed: int, key: str, n: int) -> np.ndarray:
    digest = hashlib.sha256(f"{seed}|{key}".encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:8], "big"))).random(n)


def flight(p: np.ndarray, size: np.ndarray, draws: Iterator[float]) -> np.ndarray:
    """Move the probabilities `p` along the null space of (documents, words) until two at most lie inside (0, 1)."""
    p = p.astype(float).copy()
    queue = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    live = list(itertools.islice(queue, 3))
    while len(live) == 3:
        a, b, c = live
        # null vector of [[1, 1, 1], [sa, sb, sc]]
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min([(1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(live, u, strict=True) if d])
        down = min([p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(live, u, strict=True) if d])
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(live, u, strict=True):
            p[i] += step * d
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        live = [i for i in live if 0.0 < p[i] < 1.0]
        live += list(itertools.islice(queue, 3 - len(live)))
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last units by the subset whose words, then documents, are nearest the expected ones.

    There are LANDING held back from the flight and two that it left at most, so 2 ** (LANDING + 2) subsets at most.
    """
    p = p.copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    if len(rest):
        words = documents = np.zeros(1)
        for i in rest:
            words, documents = np.concatenate([words, words + size[i]]), np.concatenate([documents, documents + 1])
        miss = np.abs(words - (p[rest] * size[rest]).sum()) + 0.01 * size[rest].mean() * np.abs(documents - p[rest].sum())
        best = int(miss.argmin())
        p[rest] = [best >> k & 1 for k in range(len(rest))]
    return p


def _fly(level: int, seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "tie", "row_no"], kind="stable")
        p, size = group["p"].to_numpy(), group["size"].to_numpy(dtype=float)
        first = group.iloc[0]
        order = np.argsort(_draws(seed, f"order|{level}|{first['source_no']}|{first['block']}", len(group)), kind="stable")
        draws = itertools.chain(_draws(seed, f"step|{level}|{first['source_no']}|{first['block']}", len(group) + 8), itertools.repeat(0.5))
        held = min(LANDING, len(order)) if last else 0
        moved = np.concatenate([p[order[:held]], flight(p[order[held:]], size[order[held:]], iter(draws))])
        if last:
            moved = land(moved, size[order])
        out = group.iloc[order].copy()
        out["p"] = moved
        return out

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    limit: float = 3.0,
    seed: int = 42,
    block: int = BLOCK,
    key_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and row_key where `key_col` names a unique column.

    `size` counts words (a null text has none), `taken` is size times the number of times the mix repeats the document,
    at most `limit` times. A null source is a source of its own, last in order. The result depends on the rows alone,
    not on their partitioning: blocks follow a hash of id, source and size, ties are broken by the same. Rows equal in
    all these are interchangeable. An empty table gives no rows.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            (F.col(key_col) if key_col else F.monotonically_increasing_id()).cast("long").alias("row_no"),
        ),
        "sized",
    )
    sources = materialize(plan(sized, weights, limit, block), "plan")
    found = sources.agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("most")).first()
    # the plan is broadcast up to a number of sources, as counted above
    units = sized.join(F.broadcast(sources) if found["n"] <= SOURCES else sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    deal = F.xxhash64(F.lit(seed), "doc_id", "size", "source_no")
    units = units.withColumn("block", F.when(F.col("size") > 0, F.pmod(deal, F.greatest("blocks", F.lit(1)))).otherwise(F.lit(-1)))
    fields = "tie long, size long, row_no long, source_no int, block long, p double"
    most, level = found["most"] or 1, 0
    flying = units.where(f"size > 0 AND p > {EPS} AND p < {1 - EPS}").select(
        deal.alias("tie"), "size", "row_no", "source_no", "block", "p"
    )
    done = []
    while True:
        flown = materialize(flying.groupBy("source_no", "block").applyInPandas(_fly(level, seed, most <= 1), fields), "flight")
        done.append(flown.where("p <= 0 OR p >= 1"))
        if most <= 1:
            break
        most, level = -(-most // FAN), level + 1
        flying = flown.where("p > 0 AND p < 1").withColumn("block", F.expr(f"block div {FAN}"))
    extra = done[0]
    for part in done[1:]:
        extra = extra.unionByName(part)
    extra = extra.where("p >= 1").select("row_no", F.lit(1).alias("extra"))
    return units.join(extra, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.coalesce("extra", F.lit(0)))).alias("taken"),
        *([F.col("row_no").alias("row_key")] if key_col else []),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` as the mix takes them: each row as often as it is taken, rows not taken left out. Rows without words stay once.

    Rows are told apart even where ids repeat or are null.
    """
    rows, key = row_keys(docs, id_col, "rows-mixed")
    row, times = spare(rows, "row"), spare(rows, "times")
    taken = mix(rows, id_col, text_col, source_col, key_col=key)
    counted = taken.select(F.col("row_key").alias(row), F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1).cast("int").alias(times)).where(F.col(times) > 0)
    out = rows.join(counted, F.col(key) == F.col(row))
    copy = spare(out, "copy")
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, times, copy)
    return out if key in docs.columns else out.drop(key)
