"""Removal of repeated substrings by a sparse enhanced suffix array and its common-prefix intervals.

A string of `length` bytes that occurs twice has the same minimal seed (of SEED bytes, by hash) in both places, so
every start position belongs to one anchor, chosen by the string alone. Start positions with one anchor are
neighbours; an anchor and the stretch of text they cover make a context. Only anchors are sorted, one in some eighty
positions.

Equal contexts are counted first, by hash, with partial aggregation: all their strings are repeated. Contexts that
share a seed but differ meet in a suffix array ordered by the text from the seed on. A stack scan of its
longest-common-prefix array walks the interval tree; in each interval of depth r the left extensions decide: where two
occurrences agree on at least `length` - r bytes to the left of the seed, they share maximal repeats, and the start
positions these cover are given out for every occurrence, not just for neighbours. Seeds with more than CROWD
different contexts are settled by counting hashes of each start position's string instead, which needs no group.

Exact copies of a whole text take part once, with a mark; every string of theirs is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

LENGTH, SEED, CROWD = 200, 40, 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, dtype=np.uint64)
    down = np.full(n + 1, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_POWERS = _powers(1 << 12)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` bytes, the same for equal runs wherever they stand."""
    global _POWERS
    if len(data) >= len(_POWERS[0]):
        _POWERS = _powers(2 * len(data))
    up, down = _POWERS
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - width + 1
    return _mix((sums[width:] - sums[:-width]) * down[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values (van Herk: prefix and suffix minima of blocks of that width)."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first and last start position of each anchor, the anchor, and its seed's hash; anchors ascend.

    The anchor of a start position is the leftmost least seed of its `length` bytes.
    """
    whole = np.frombuffer(text, dtype=np.uint8)
    firsts, lasts, places, seeds = [], [], [], []
    low = np.uint64((1 << 22) - 1)  # the place within a block; it also settles ties of the hash above it
    for begin in range(0, len(whole) - length + 1, _BLOCK):
        data = whole[begin : begin + _BLOCK + length - 1]
        hashes = window_hashes(data, seed)
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(keyed, length - seed + 1) & low).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        firsts.append(edge + begin)
        lasts.append(np.append(edge[1:], len(at)) - 1 + begin)
        places.append(at[edge] + begin)
        seeds.append(hashes[at[edge]])
    if not firsts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, np.zeros(0, dtype=np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places), np.concatenate(seeds)


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def repeated_starts(contexts: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For contexts (bytes, place of the seed) that share a seed: runs of start positions whose strings another has too.

    Suffixes from the seed on are sorted with their common-prefix lengths; the stack scan visits every interval of the
    interval tree once, deepest first.
    """
    n = len(contexts)
    right = [text[at:] for text, at in contexts]
    left = [text[:at][::-1] for text, at in contexts]
    order = sorted(range(n), key=right.__getitem__)
    by_left = sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def interval(depth: int, members: list[int]) -> None:
        """Members agree on `depth` bytes from the seed on; they are in order of their left extensions."""
        if depth + max(len(left[i]) for i in members) < length:
            return
        previous = 0
        for k, i in enumerate(members):
            following = _common(left[i], left[members[k + 1]]) if k + 1 < len(members) else 0
            best = max(previous, following)
            previous = following
            if best + depth >= length:
                at = contexts[i][1]
                low, high = max(0, at - best), min(at - (length - depth), len(contexts[i][0]) - length)
                if low <= high:
                    out[i].append((low, high))

    # stack of open intervals: depth and members merged in order of rank
    stack: list[tuple[int, list[int]]] = []
    for k, i in enumerate(order):
        depth = _common(right[order[k - 1]], right[i]) if k else 0
        tail = [order[k - 1]] if k else []
        while stack and stack[-1][0] > depth:
            top, members = stack.pop()
            members = _merge(members, tail, rank)
            interval(top, members)
            tail = members
        if k:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, _merge(stack[-1][1], tail, rank))
            else:
                stack.append((depth, tail))
    tail = [order[-1]] if n else []
    while stack:
        top, members = stack.pop()
        tail = _merge(members, tail, rank)
        interval(top, tail)
    return out


def _merge(a: list[int], b: list[int], rank: list[int]) -> list[int]:
    return sorted(a + b, key=rank.__getitem__) if a and b else a or b


def spans(starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs [a, b) from runs of repeated start positions, both ends included."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable"):
        a, b = int(starts[i]), int(ends[i]) + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _find_anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, copies, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                first, last, place, hashes = anchors(text, length, seed)
                view = memoryview(text)
                for a in range(0, len(first), 20_000):
                    s = slice(a, a + 20_000)
                    context = np.fromiter((xxhash.xxh3_64_intdigest(view[x : y + length]) for x, y in zip(first[s].tolist(), last[s].tolist(), strict=True)), dtype=np.uint64)
                    n = len(context)
                    yield pa.record_batch(
                        [
                            pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int8)), pa.array([key], pa.binary())).dictionary_decode(),
                            pa.array(first[s].astype(np.int32)), pa.array((last[s] - first[s]).astype(np.int32)), pa.array((place[s] - first[s]).astype(np.int32)),
                            _signed(hashes[s]), _signed(context), pa.array(np.full(n, min(copies, 2), np.int8)),
                        ],
                        names=["key", "first", "span", "seed_at", "seed", "context", "copies"],
                    )

    return run


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, contexts, places, texts = [], [], [], []
            for row, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                view = text.as_buffer()
                for x in row:
                    seeds.append(x["seed"])
                    contexts.append(x["context"])
                    places.append(x["seed_at"])
                    texts.append(view[x["first"] : x["first"] + x["span"] + length].to_pybytes())
            yield pa.record_batch([pa.array(seeds, pa.int64()), pa.array(contexts, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.binary())], names=["seed", "context", "seed_at", "text"])

    return run


def _scan_groups(length: int):
    """Groups of contexts by seed, from partitions sorted by seed; memory holds one group."""
    names = ["seed", "context", "lows", "highs"]

    def solve(seed: int, rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, list[int], list[int]]]:
        found = repeated_starts([(text, at) for _, at, text in rows], length)
        return [(seed, c, [a for a, _ in f], [b for _, b in f]) for (c, _, _), f in zip(rows, found, strict=True) if f]

    def pack(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out = None, [], []
        for batch in batches:
            for seed, context, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seed != current:
                    if len(rows) > 1:
                        out += solve(current, rows)
                    current, rows = seed, []
                    if len(out) > 5_000:
                        yield pack(out)
                        out = []
                rows.append((context, at, text))
        if len(rows) > 1:
            out += solve(current, rows)
        yield pack(out)

    return run


def _each_start(length: int):
    """The strings of crowded seeds one by one: a hash for every start position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, context, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(text) - length + 1
                view = memoryview(text)
                hashes = np.array([xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)])
                yield pa.record_batch(
                    [pa.array(np.full(n, seed)), pa.array(np.full(n, context)), pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes.tolist(), pa.binary())],
                    names=["seed", "context", "low", "hash"],
                )

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, digests = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                view = memoryview(text.as_buffer())
                found = found or []
                cut = spans(np.array([x["low"] for x in found], dtype=np.int64), np.array([x["high"] for x in found], dtype=np.int64), length)
                digest, at = hashlib.sha256(), 0
                for a, b in cut:
                    digest.update(view[at:a])
                    at = b
                digest.update(view[at:])
                sizes.append(len(view))
                gone.append(sum(b - a for a, b in cut))
                runs.append([{"low": a, "high": b} for a, b in cut])
                digests.append(digest.hexdigest())
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, kind), pa.array(digests, pa.string())],
                names=["key", "n_bytes", "n_removed", "runs", "kept_sha256"],
            )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs (the removed [low, high) byte runs).

    A byte goes if a string of `length` bytes that covers it starts anywhere else, in the same document or another;
    strings are judged on the input. Null texts count as empty; texts under `length` bytes lose nothing. Repeated rows
    are copies of each other, so all of a long one goes. An empty table gives no rows; other columns are not read.
    """
    if seed >= length:
        raise ValueError("a seed is shorter than the strings it anchors")
    bytes_ = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), bytes_.alias("text")).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    long = rows.where(F.length("text") >= length)
    texts = materialize(long.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), "texts")
    found = materialize(
        texts.select("key", "copies", "text").mapInArrow(_find_anchors(length, seed), "key binary, first int, span int, seed_at int, seed long, context long, copies tinyint"),
        "anchors",
    )
    one = F.min(F.struct("key", "first", "span", "seed_at"))
    contexts = materialize(found.groupBy("seed", "context").agg(F.sum("copies").alias("n"), one.alias("at")), "contexts")
    shared = contexts.groupBy("seed").agg(F.count(F.lit(1)).alias("n_contexts")).where("n_contexts > 1")
    wanted = materialize(contexts.join(shared, "seed").select("seed", "context", "n_contexts", "at.*"), "wanted")
    equal = materialize(contexts.where("n > 1").select("seed", "context"), "equal")
    discard(contexts)
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("seed", "context", "seed_at", "first", "span")).alias("places"))
    cut = materialize(texts.join(by_text, "key").select("text", "places").mapInArrow(_cut_contexts(length), "seed long, context long, seed_at int, text binary"), "cut")
    sized = cut.join(wanted.select("seed", "n_contexts").distinct(), "seed")
    usual = sized.where(F.col("n_contexts") <= crowd).select("seed", "context", "seed_at", "text")
    differing = (
        usual.repartition("seed").sortWithinPartitions("seed").mapInArrow(_scan_groups(length), "seed long, context long, lows array<int>, highs array<int>")
    )
    crowded = sized.where(F.col("n_contexts") > crowd).select("seed", "context", "seed_at", "text")
    each = crowded.mapInArrow(_each_start(length), "seed long, context long, low int, hash binary")
    again = each.join(each.groupBy("hash").count().where("count > 1"), "hash", "left_semi")
    partial = differing.select("seed", "context", F.explode(F.arrays_zip("lows", "highs")).alias("x")).select("seed", "context", F.col("x.lows").alias("low"), F.col("x.highs").alias("high"))
    partial = partial.unionByName(again.select("seed", "context", "low", F.col("low").alias("high")))
    whole = equal.select("seed", "context", F.lit(0).alias("low"), F.lit(-1).alias("high"))
    runs = materialize(
        partial.unionByName(whole).groupBy("seed", "context").agg(F.min("high").alias("least"), F.collect_list(F.struct("low", "high")).alias("runs")), "runs"
    )
    for frame in (cut, wanted, equal):
        discard(frame)
    single = texts.where("copies = 1")
    by_key = materialize(
        found.where("copies = 1")
        .join(runs, ["seed", "context"])
        .select("key", F.explode(F.when(F.col("least") < 0, F.array(F.struct(F.lit(0).alias("low"), F.col("span").alias("high")))).otherwise(F.col("runs"))).alias("x"), "first")
        .groupBy("key")
        .agg(F.collect_list(F.struct((F.col("first") + F.col("x.low")).alias("low"), (F.col("first") + F.col("x.high")).alias("high"))).alias("found")),
        "by_key",
    )
    for frame in (found, runs):
        discard(frame)
    settled = materialize(
        single.join(by_key, "key", "left").select("key", "text", "found").mapInArrow(
            _removed(length), "key binary, n_bytes long, n_removed long, runs array<struct<low: long, high: long>>, kept_sha256 string"
        ),
        "settled",
    )
    discard(by_key)
    copied = texts.where("copies > 1").select(
        "key", F.length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_removed"),
        F.array(F.struct(F.lit(0).cast("long").alias("low"), F.length("text").cast("long").alias("high"))).alias("runs"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"),
    )
    known = settled.unionByName(copied)
    short = rows.where(F.length("text") < length).select(
        "doc_id", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.expr("cast(array() as array<struct<low: bigint, high: bigint>>)").alias("runs"), F.sha2("text", 256).alias("kept_sha256"),
    )
    out = long.select("doc_id", "key").join(known, "key").drop("key").unionByName(short)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256", "runs")
