"""Near copies against brute force over all pairs of shingle sets."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, node int, component string, n int, key string"


def plain(rows):
    def cut(text):
        t = (text or "").encode().lower().split()
        return frozenset(b" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))) if t else frozenset()

    sets = [cut(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                group[root(i)] = root(j)
    least = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)].append(i)
    return sorted(((i, min(least[root(n)], default=None)) for n, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("pivots", [64, 2])
def test_near_components_match_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(near_copies, "PIVOTS", pivots)
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(6):
        base = fresh(150)
        for _ in range(9):  # one to six words replaced: Jaccard indices on both sides of 0.8
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(1, 6)):
                copy[at] = fresh(1)[0]
            rows.append((len(rows), " ".join(copy)))
    line = fresh(30)
    rows += [(100 + i, " ".join(fresh(rng.randint(3, 9)) + line)) for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "A  b"), (205, "a c"), (None, rows[0][1]), (None, "alone no id"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "c", 2, "k") for r in rows], SCHEMA)
    got = near_copies.near_components(df)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=repr) == plain(rows)
    assert near_copies.near_components(df.limit(0)).count() == 0


def test_pipeline_drops_a_copy_eleven_bits_apart_and_keeps_different_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pair = docs.where("doc_id IN (589, 6676, 385, 4738)")  # within three bits, Jaccard 0.56 to 0.77
    assert corpus_pipeline.near_copies(spark, pair, "").count() == 4
    base = [f"word{i}" for i in range(400)]
    other = list(base)
    for i in range(6):
        other[(18 * i + 7) % 400] = f"changed{i}"
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(other))).bit_count() == 11
    two = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_copies(spark, two, "").collect()] == [1]


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def found(spark, rows):
    got = near_copies.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=repr)


def test_a_large_group_is_compared_in_proportion_to_its_size(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 150)
    rows = [(0, " ".join(base))]
    for _ in range(150):  # up to three changes link with the base alone, four and five with nothing
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 3, 3, 4, 5])):
            copy[at] = words(rng, 1)[0]
        rows.append((len(rows), " ".join(copy)))
    compared, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    assert found(spark, rows) == plain(rows)
    assert sum(compared) <= 4 * len(rows)


def test_whole_sets_are_sent_for_likely_pairs_alone(spark, monkeypatch):
    rng = random.Random(6)
    line = words(rng, 40)
    rows = [(i, " ".join(words(rng, 60) + line)) for i in range(30)]
    sent, write = [], near_copies.materialize

    def counted(df, tag, *rest, **more):
        out = write(df, tag, *rest, **more)
        if "shingles" in df.columns and "fp" not in df.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    monkeypatch.setattr(near_copies, "_levels", lambda sets: np.zeros(near_copies.SLOTS, dtype=np.uint8))  # any order: the line is first in some
    assert found(spark, rows) == plain(rows) == [(i, i) for i in sorted(range(30), key=lambda i: repr((i, i)))]
    assert sum(sent) == 0


def test_pairs_close_to_the_limit_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    pool, rows = words(rng, 40), []
    for _ in range(120):  # passages that others have too, and sizes on both sides of a longer sketch
        at = rng.randrange(30)
        text = words(rng, rng.randint(50, 66)) + pool[at : at + 9]
        other = text[rng.randint(0, 3) :] + words(rng, rng.randint(0, 3))
        for k in rng.sample(range(len(other)), rng.choice([0, 1, 1, 2])):
            other[k] = words(rng, 1)[0]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
    monkeypatch.setattr(near_copies, "_proposed", lambda sets: sets.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b")))
    got = found(spark, rows)
    assert got == plain(rows) and 40 < sum(i == j for i, j in got) - 120 < 110


def test_sketches_leave_every_pair_that_counts(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        both, x, y = int(rng.integers(0, 300)), int(rng.integers(0, 40)), int(rng.integers(0, 40))
        if both + x + y:
            h = rng.integers(0, 2**63, both + x + y, dtype=np.uint64)
            a, b = h[: both + x], np.concatenate([h[:both], h[both + x :]])
            rows.append((near_copies._sketch(a).view(np.int64).tolist(), near_copies._sketch(b).view(np.int64).tolist(), len(a), len(b), 9 * both >= 4 * (len(a) + len(b))))
    pairs = spark.createDataFrame(rows, "x array<long>, y array<long>, m int, n int, near boolean")
    assert {len(r[0]) == len(r[1]) for r in rows if r[4]} == {True, False}
    assert pairs.where("near").count() == pairs.where("near").where(near_copies.POSSIBLE).count() > 100
    assert pairs.where("NOT near").where(near_copies.POSSIBLE).count() < pairs.where("NOT near").count() / 2
