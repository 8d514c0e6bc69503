"""Agreement of partitions with each other and with outside variables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from .ranking import running_total, with_average_rank


#: Cells of a contingency table that the driver takes.
CELLS = 1_000_000


def local_contingency(df: DataFrame, a: str, b: str) -> list[tuple]:
    """The cells (a, b, n) on the driver; refused where labels are so many that the table is as long as data."""
    rows = contingency(df, a, b).limit(CELLS + 1).collect()
    if len(rows) > CELLS:
        raise ValueError(f"the contingency table of {a} and {b} has more than {CELLS} cells")
    return [(r[0], r[1], r["n"]) for r in rows]


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def _pairs(c: Column) -> Column:
    return F.sum(c * (c - 1) / 2)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari, from pair counts of the contingency table; 1 for two trivial partitions."""
    table = contingency(df, a, b)
    both = table.agg(_pairs(F.col("n")).alias("ab"), F.sum("n").alias("total"))
    one = table.groupBy(a).agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("a"))
    two = table.groupBy(b).agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("b"))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("total") * (F.col("total") - 1) / 2)
    return both.crossJoin(one).crossJoin(two).select(F.coalesce(F.try_divide(F.col("ab") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)).alias("ari"))


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> float:
    """AMI with the arithmetic mean of entropies. The contingency table, not the data, is on the driver."""
    rows = local_contingency(df, a, b)
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    if len(left) == len(right) == 1 or not rows:
        return 1.0
    if len(left) * len(right) > 100 * CELLS:
        raise ValueError("too many labels")
    table = np.zeros((len(left), len(right)))
    row, column = ({v: i for i, v in enumerate(side)} for side in (left, right))
    for x, y, n in rows:
        table[row[x], column[y]] = n
    total, ra, rb = table.sum(), table.sum(axis=1), table.sum(axis=0)
    entropy = lambda v: -sum(x / total * math.log(x / total) for x in v if x)
    mutual = sum(n / total * math.log(total * n / (ra[i] * rb[j])) for (i, j), n in np.ndenumerate(table) if n)
    log_f = lambda n: math.lgamma(n + 1)
    expected = 0.0
    for x in ra:
        for y in rb:
            for n in range(max(1, int(x + y - total)), int(min(x, y)) + 1):
                weight = log_f(x) + log_f(y) + log_f(total - x) + log_f(total - y) - log_f(total) - log_f(n) - log_f(x - n) - log_f(y - n) - log_f(total - x - y + n)
                expected += n / total * math.log(total * n / (x * y)) * math.exp(weight)
    scale = (entropy(ra) + entropy(rb)) / 2 - expected
    return float((mutual - expected) / scale) if abs(scale) > 1e-15 else 1.0


def eta_squared(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The share of variance between groups; rows without a value are left out."""
    keys = by or []
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    groups = known.groupBy(*keys, group).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("v"))
    over = Window.partitionBy(*keys)
    grand = F.sum(F.col("m") * F.col("n")).over(over) / F.sum("n").over(over)
    return groups.withColumn("g", grand).groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2), F.sum(F.col("n") * ((F.col("m") - F.col("g")) ** 2 + F.col("v")))).alias("eta2"), F.sum("n").alias("n")
    )


def kruskal_h(df: DataFrame, group: str, value: str) -> DataFrame:
    """h with the correction for ties, and the degrees of freedom."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    # ranks come from the distinct values' counts, sorted in ranges
    values = known.groupBy(value).agg(F.count(F.lit(1)).alias("t"))
    ranked = running_total(values, value, "t", "up").withColumn("rank", F.col("up") - (F.col("t") - 1) / 2)
    groups = known.join(ranked, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    sums = groups.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("total"), (F.count(F.lit(1)) - 1).alias("df"))
    ties = values.agg(F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties"))
    n = F.col("total").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return sums.crossJoin(ties).select(h.alias("h"), "df")


def kruskal_p(df: DataFrame, group: str, value: str) -> float:
    row = kruskal_h(df, group, value).first()
    return tails.chi2_sf(row["h"], row["df"])


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, v, df. Tables of two by two get the continuity correction for chi2."""
    table = contingency(df, a, b)
    rows = table.groupBy(a).agg(F.sum("n").alias("ra"))
    cols = table.groupBy(b).agg(F.sum("n").alias("rb"))
    shape = rows.agg(F.count(F.lit(1)).alias("nr"), F.sum("ra").alias("total")).crossJoin(cols.agg(F.count(F.lit(1)).alias("nc")))
    cells = rows.crossJoin(cols).join(table, [a, b], "left").crossJoin(F.broadcast(shape))
    expected = F.col("ra") * F.col("rb") / F.col("total")
    gap = F.abs(F.coalesce("n", F.lit(0)) - expected)
    small = (F.col("nr") == 2) & (F.col("nc") == 2)
    gap = F.when(small, F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))).otherwise(gap)
    found = cells.agg(F.sum(gap * gap / expected).alias("chi2"), F.max("total").alias("total"), (F.least(F.max("nr"), F.max("nc")) - 1).alias("m"), ((F.max("nr") - 1) * (F.max("nc") - 1)).alias("df"))
    return found.select("chi2", F.sqrt(F.try_divide("chi2", F.col("total") * F.col("m"))).alias("v"), "df")


def external_table(df: DataFrame, label: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """variable, kind, strength: eta squared of numbers and Cramér's V of categories against a partition."""
    out = None
    for name in numeric:
        part = eta_squared(df, label, name).select(F.lit(name).alias("variable"), F.lit("eta2").alias("kind"), F.col("eta2").alias("strength"))
        out = part if out is None else out.unionByName(part)
    for name in categorical:
        part = cramers_v(df, label, name).select(F.lit(name).alias("variable"), F.lit("v").alias("kind"), F.col("v").alias("strength"))
        out = part if out is None else out.unionByName(part)
    return out


def q_values(df: DataFrame, key: str, p: str, dependent: bool = False) -> DataFrame:
    """key, p, q: Benjamini-Hochberg, or Benjamini-Yekutieli for dependent tests.

    A running minimum needs all p values in order; tests are as many as hypotheses, not as data rows.
    """
    order = Window.orderBy(p, key)
    n = df.where(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.lit(1.0)).alias("_x"))
    ranked = df.where(F.col(p).isNotNull()).select(key, p).withColumn("_r", F.row_number().over(order)).crossJoin(F.broadcast(n.select("_n")))
    factor = F.sum(1 / F.col("_r")).over(Window.partitionBy()) if dependent else F.lit(1.0)
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_n") * factor / F.col("_r"))
    low = F.min("_raw").over(Window.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return raw.select(key, p, F.least(low, F.lit(1.0)).alias("q"))


def octile_cuts(train: DataFrame, value: str) -> DataFrame:
    return train.agg(F.array_distinct(F.array_sort(F.percentile(value, F.array(*[F.lit(i / 8) for i in range(1, 8)])))).alias("cuts"))


def octiles(train: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """`test` with octile: the number of training cut points at or below the value; -1 for null."""
    below = F.size(F.filter("cuts", lambda c: c <= F.col(value)))
    return test.crossJoin(F.broadcast(octile_cuts(train, value))).withColumn("octile", F.when(F.col(value).isNull(), -1).otherwise(below).cast("long")).drop("cuts")


def group_mean_prediction(train: DataFrame, test: DataFrame, group: str, y: str) -> DataFrame:
    """`test` with predicted: the training mean of its group, or of all where the group is new."""
    means = train.where(F.col(y).isNotNull()).groupBy(group).agg(F.avg(y).alias("_m"))
    overall = train.agg(F.avg(y).alias("_all"))
    return test.join(means, group, "left").crossJoin(F.broadcast(overall)).withColumn("predicted", F.coalesce("_m", "_all")).drop("_m", "_all")


def cross_validated(df: DataFrame, fold: str, group: str, y: str) -> DataFrame:
    """r2 out of sample over all folds at once; the baseline is the mean of each fold's training part.

    Training sums of a fold are the totals less the fold's own, so no fold is scanned on its own.
    """
    known = df.where(F.col(y).isNotNull())
    by_fold = Window.partitionBy(group)
    g = known.groupBy(group, fold).agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("ts", F.sum("s").over(by_fold) - F.col("s")).withColumn("tn", F.sum("n").over(by_fold) - F.col("n"))
    f = known.groupBy(fold).agg(F.sum(y).alias("fs"), F.count(F.lit(1)).alias("fn"))
    whole = known.agg(F.sum(y).alias("ws"), F.count(F.lit(1)).alias("wn"))
    f = f.crossJoin(F.broadcast(whole)).select(fold, ((F.col("ws") - F.col("fs")) / (F.col("wn") - F.col("fn"))).alias("base"))
    scored = known.join(g.select(group, fold, F.try_divide("ts", "tn").alias("m")), [group, fold]).join(F.broadcast(f), fold)
    error = F.col(y) - F.coalesce("m", "base")
    return scored.agg((1 - F.try_divide(F.sum(error * error), F.sum((F.col(y) - F.col("base")) ** 2))).alias("r2"), F.count(F.lit(1)).alias("n"))


def best_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each label of `a`, the greatest Jaccard overlap with a label of `b` (ties to the smaller label)."""
    table = contingency(df, a, b)
    rows, cols = Window.partitionBy(a), Window.partitionBy(b)
    scored = table.withColumn("j", F.col("n") / (F.sum("n").over(rows) + F.sum("n").over(cols) - F.col("n")))
    order = Window.partitionBy(a).orderBy(F.round("j", 12).desc(), b)
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(a, F.col(b).alias("match"), F.col("j").alias("jaccard"))


def match_labels(df: DataFrame, reference: str, other: str, by_overlap: bool = False) -> dict:
    """A one-to-one map of the labels of `other` onto those of `reference` with the greatest total overlap.

    Overlaps are counted in Spark; the assignment is solved on the table of labels. Labels left over get new numbers.
    """
    rows = local_contingency(df, reference, other)
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    table = np.zeros((len(right), len(left)))
    for x, y, n in rows:
        table[right.index(y), left.index(x)] = n
    gain = table if by_overlap else table / np.maximum(table.sum(axis=1)[:, None] + table.sum(axis=0)[None, :] - table, 1)
    found = {right[i]: left[j] for i, j in assign(-gain)}
    spare = max([*left, *right], default=-1) + 1
    for y in right:
        if y not in found:
            found[y], spare = spare, spare + 1
    return found


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of least cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, via, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        current, column, reached = row, -1, 0.0
        while True:
            step = reached + c[current] - u[current] - v
            better = ~seen & (step < best)
            best[better], via[better] = step[better], column
            column = int(np.where(seen, np.inf, best).argmin())
            reached = best[column]
            seen[column] = True
            if owner[column] < 0:
                break
            current = owner[column]
        settled = np.flatnonzero(seen)
        for k in settled:
            v[k] += best[k] - reached
            if owner[k] >= 0:
                u[owner[k]] += reached - best[k]
        u[row] += reached
        while column >= 0:
            previous = via[column]
            owner[column] = row if previous < 0 else owner[previous]
            column = previous
    pairs = [(int(owner[k]), k) for k in range(m) if owner[k] >= 0]
    return [(b, a) for a, b in pairs] if flip else pairs


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = with_average_rank(with_average_rank(known, a, "_a"), b, "_b")
    return ranked.agg(F.corr("_a", "_b").alias("spearman"))
