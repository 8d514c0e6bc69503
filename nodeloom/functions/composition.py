"""Column functions for compositions and codes. All are built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6
#: Cyrillic capitals and the Latin letters they look like.
CYRILLIC, LATIN = "АВЕКМНОРСТХ", "ABEKMHOPCTX"


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def clr(shares: Column, floor: float = FLOOR) -> Column:
    """Centred log-ratios of an array of shares: log of each, floored, less the mean log."""
    logs = F.transform(shares, lambda s: F.ln(F.greatest(s, F.lit(floor))))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, b: a + b) / F.size(logs)
    return F.transform(logs, lambda v: v - mean)


def ilr(shares: Column, parts: int, floor: float = FLOOR) -> Column:
    """Isometric log-ratios in pivot coordinates: part i against the geometric mean of those after it."""
    logs = F.transform(shares, lambda s: F.ln(F.greatest(s, F.lit(floor))))
    out = []
    for i in range(parts - 1):
        rest = parts - i - 1
        mean = F.aggregate(F.slice(logs, i + 2, rest), F.lit(0.0), lambda a, b: a + b) / rest
        out.append((logs[i] - mean) * (rest / (rest + 1)) ** 0.5)
    return F.array(*out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def kemeny(a: Column, b: Column) -> Column:
    """Summed over pairs: 1 for opposite orders, a half for an order against a tie."""
    apart = F.zip_with(a, b, lambda x, y: F.when(x == y, 0.0).when((x == 0) | (y == 0), 0.5).otherwise(1.0))
    return F.aggregate(apart, F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2; norms under 1e-12 count as that."""
    low = F.lit(1e-12)
    return (1 + dot(a, b) / (F.greatest(norm(a), low) * F.greatest(norm(b), low))) / 2


def distance_kernel(distance: Column, sigma: float = 150.0) -> Column:
    return F.exp(-distance / sigma)


def pair_codes(values: Column, n: int, tolerance: float = 0.0) -> Column:
    """For all s < j: 0 for a tie within the tolerance, 1 where the first is less, 2 where it is greater."""
    out = []
    for s in range(n):
        for j in range(s + 1, n):
            gap = values[s] - values[j]
            out.append(F.when(F.abs(gap) <= tolerance, 0).when(gap < 0, 1).otherwise(2))
    return F.array(*out)


def digits(code: Column, width: int = 8) -> Column:
    return F.substring(F.regexp_replace(code, r"\D", ""), 1, width)


def section_letter(title: Column) -> Column:
    """The letter of a classifier section from its title, in Latin; null where the title names none."""
    letter = F.split_part(title, F.lit(" "), F.lit(2))
    return F.when(title.startswith("Раздел "), F.translate(F.substring(letter, 1, 1), CYRILLIC, LATIN))


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """`x` within bounds; null stays null (greatest and least alone would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low) if isinstance(low, float | int) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if isinstance(high, float | int) else high)
    return F.when(x.isNotNull(), out)


def clean(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def candidate_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def rounded(x: Column, digits_: int = 4) -> Column:
    return F.when(x.isNotNull(), F.round(x, digits_))
