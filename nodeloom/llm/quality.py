"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

One pass turns each whole text into STATS numbers. Their random Fourier features approximate a Gaussian kernel;
each partition sums its normal equations, a two-level sum adds them up, and the driver solves one system of FEATURES
unknowns. Isotonic regression on a fold that the ridge has not seen maps raw scores to probabilities; it works on
BINS sums, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, fold, materialize, remembered, row_keys

FEATURES, BINS, RIDGE, WIDTH, SEED = 256, 2048, 0.1, 8.0, 20240229
#: Documents with this calibrated score or more are accepted.
THRESHOLD = 0.3
#: Frequent function words of the four languages the statistics know; fixed values, as text in natural order.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "au avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "das dem den der des die ein eine er für im ist mit nicht sich sie und von zu "
    "como con del el es las lo los no para por se su una y".split()
)
_FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)
_KIND = np.zeros(256, dtype=np.intp)
_KIND[list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = 1
_KIND[range(ord("A"), ord("Z") + 1)] = 2
_KIND[range(ord("0"), ord("9") + 1)] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"-()"]] = 5
STATS = 20


def statistics(text: str | None) -> np.ndarray:
    """STATS numbers of a whole text, each of about unit scale; a null or empty text gives zeros."""
    out = np.zeros(STATS)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return out
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=6)
    size = len(raw)
    lines = raw.split(b"\n")
    distinct = set(words)
    plain = sum(w in _FUNCTION_BYTES for w in words) / n
    marked = sum(map(raw.count, (b"!!", b"***", b"$$$", b"###", b"%%%", b"&&&", b"??", b"...")))
    longest = max(map(len, words))
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[:] = (
        np.log1p(n) / 4, np.log1p(size / n), kinds[1] / size, kinds[2] / size * 4, kinds[3] / size * 8, kinds[4] / size * 4,
        kinds[5] / size * 8, kinds[0] / size * 8, plain * 2, np.log(len(distinct)) / np.log(n + 1), marked / n * 2, np.log1p(longest) / 2,
        twins * 4, np.log1p(len(lines)) / 3, np.log1p(n / len(lines)) / 3, len(set(lines)) / len(lines), raw.count(b"|") / n * 2,
        raw.count(b"http") / n * 8, sum(w.isupper() for w in words) / n, float(lines[-1].rstrip()[-1:] in (b".", b"!", b"?")),
    )
    return out


class Fourier:
    """A fixed random projection of scaled statistics to FEATURES cosines, plus the constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: float = WIDTH, features: int = FEATURES, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.omega, self.phase = rng.standard_normal((len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(scaled @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.hstack([waves, np.ones((len(stats), 1))])


def pool(sums: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: (x, weight, weighted sum) in order of x to knots (x, mean).

    Each pooled block is flat from its first to its last x; between blocks the knots are joined by straight lines.
    """
    blocks: list[list[float]] = []
    for x, w, s in sums:
        blocks.append([x, x, w, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, w1, s1 = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += w1
            blocks[-1][3] += s1
    return np.array([x for b in blocks for x in b[:2]]), np.repeat([b[3] / b[2] for b in blocks], 2)


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, STATS))


def document_statistics(docs: DataFrame, id_col: str, text_col: str, key_col: str | None = None) -> DataFrame:
    """doc_id, stats and, where a key column is named, its value as row_key."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("quality")
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(1)]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0))
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * STATS)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, flat), batch.column(2)], names=["doc_id", "stats", "row_key"])

    key = (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("row_key")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"), key).mapInArrow(run, f"doc_id {kind}, stats array<double>, row_key long")


def _normal_equations(rows: DataFrame, waves: Fourier) -> np.ndarray:
    """The sum over `rows` (stats, y) of z zᵀ with z = (features, 1, y), added in two levels."""
    side = len(waves.phase) + 2

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((side, side))
        for pdf in batches:
            for start in range(0, len(pdf), 4096):
                some = pdf.iloc[start : start + 4096]
                z = np.hstack([waves(_stack(some["stats"])), some["y"].to_numpy(dtype=float)[:, None]])
                total += z.T @ z
        yield pd.DataFrame({"sums": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(side * side)
        for pdf in batches:
            for b in pdf["sums"]:
                total += np.frombuffer(b)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.mapInPandas(part, "sums binary")
    lanes = max(1, min(64, int(parts.rdd.getNumPartitions() ** 0.5)))
    # a row is one matrix; `lanes` of them, of fixed size, come to the driver, whatever the number of rows
    found = parts.repartition(lanes).mapInPandas(add, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in found), np.zeros(side * side)).reshape(side, side)


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, key_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and row_key where `key_col` names a column of whole numbers.

    Labels are learned from rows with fold(doc_id, 5) other than 0: fold 1 calibrates, the rest fit the ridge. Null and
    empty texts score like any other from zero statistics. Null labels or ids are not learned from; conflicting labels
    of an id all count. Without any label (or labels of one class only) the score is the base rate, or 0.5 without a
    base rate. An empty table gives no rows. Language, source, id and label are never inputs of a score.
    """
    stats = materialize(document_statistics(docs, id_col, text_col, key_col).withColumn("part", fold("doc_id", 5).cast("int")), "stats")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    known = materialize(stats.where("part <> 0").join(marks, "doc_id").select("stats", "y", "part"), "known")
    moments = known.where("part > 1").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("base"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(STATS)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(STATS)],
    ).first()
    n = moments["n"]
    if n:
        scale = np.array([moments[f"s{i}"] for i in range(STATS)])
        waves = Fourier(np.array([moments[f"m{i}"] for i in range(STATS)]), np.where(scale > 1e-6, scale, 1.0))
        total = _normal_equations(known.where("part > 1").select("stats", "y"), waves)
        gram, right = total[:-1, :-1], total[:-1, -1]
        penalty = np.eye(len(gram)) * RIDGE * n / len(gram)
        penalty[-1, -1] = 1e-9
        beta = np.linalg.solve(gram + penalty, right)
    else:
        waves, beta = Fourier(np.zeros(STATS), np.ones(STATS)), np.r_[np.zeros(FEATURES), 0.5]

    @F.pandas_udf("double")
    def raw(column: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([waves(_stack(column.iloc[i : i + 4096])) @ beta for i in range(0, len(column), 4096)]) if len(column) else [], dtype=float)

    place = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) + 0.5) / 2 * BINS).cast("int")
    sums = known.where("part = 1").select(raw("stats").alias("raw"), "y").groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("w"), F.sum("y").alias("s"))
    steps = sorted((r["bin"], float(r["w"]), float(r["s"])) for r in sums.collect())  # BINS + 1 rows at most
    if steps:
        # one row of either class at the ends, where that class occurs
        base = sum(s for _, _, s in steps) / sum(w for _, w, _ in steps)
        steps = [(-1, 1.0, 0.0 if base < 1 else base)] + steps + [(BINS + 1, 1.0, 1.0 if base > 0 else base)]
        knots, means = pool([((b + 0.5) / BINS * 2 - 0.5, w, s) for b, w, s in steps])
    else:
        knots, means = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=float)
        x = np.concatenate([waves(_stack(column.iloc[i : i + 4096])) @ beta for i in range(0, len(column), 4096)])
        # the raw score breaks ties within a step, by a share too small to leave it
        return pd.Series(np.clip(np.interp(x, knots, means) * (1 - 1e-6) + 1e-6 * np.clip((x + 0.5) / 2, 0, 1), 0, 1))

    scored = stats.select("doc_id", (F.col("part") == 0).alias("held_out"), score("stats").alias("score"), "row_key")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["row_key"] if key_col else []))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches `threshold`, each by its own text: rows that share an id are told apart."""
    rows, key = row_keys(docs, id_col, "rows-scored")
    good = fit_and_score(rows, labels, id_col, text_col, threshold=threshold, key_col=key).where("predicted = 1").select("row_key")
    return chosen(rows, key, good, docs)


def accuracy(rows: list[tuple[float, int]]) -> float:
    """The area under the curve of (score, label) rows, for the tests."""
    ranked, at, total = sorted(rows), 0, 0.0
    for _, tied in groupby(ranked, key=lambda r: r[0]):
        tied = list(tied)
        total += sum(y for _, y in tied) * (at + (len(tied) + 1) / 2)
        at += len(tied)
    positive = sum(y for _, y in rows)
    return (total - positive * (positive + 1) / 2) / max(1, positive * (len(rows) - positive))
