"""The cover tree against brute force, components, and the pipeline stage by stage."""

import collections
import weakref

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import bpe, components, covertree, mixing
from nodeloom.llm.common import remembered
from nodeloom.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int, node int, group string, n int"


def plain(rows, threshold):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        if x.any():
            unit[k] = x / np.linalg.norm(x)
    links = collections.defaultdict(set)
    for a in unit:
        for b in unit:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].add(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((i, len(links[k]), min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell", [2000, 7])
def test_near_duplicates_match_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.35 * rng.standard_normal(8)).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[3][1], 1) for i in range(5)] + [(210, [2 * x for x in rows[3][1]], 1), (3, rows[3][1], 1)]
    rows += [(220, None, 1), (221, [0.0] * 8, 1), (222, [float("nan")] + [1.0] * 7, 1), (223, [None] + [1.0] * 7, 1), (224, [1.0, 2.0], 1), (225, [], 1)]
    rows += [(226, rows[0][1], None), (None, rows[0][1], 0), (227, [1e30] * 8, 0), (228, [float("inf")] * 8, 0)]
    df = spark.createDataFrame([(*r, 7, "g", 1) for r in rows], SCHEMA)
    got = covertree.near_duplicates(df, cell=cell)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=repr) == plain(rows, 0.93)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())


def test_cover_tree_covers_and_nests():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.Tree(x)
    for n, children in enumerate(tree.children):
        assert np.linalg.norm(x[tree.points[n]] - x[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-12
        if children:
            assert tree.centre[children[0]] == tree.centre[n]
            assert sorted(np.concatenate([tree.points[c] for c in children]).tolist()) == sorted(tree.points[n].tolist())
    pairs = {(min(i, j), max(i, j)) for p, q in covertree.dual(tree, tree, 0.9, True) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert pairs == {(i, j) for i in range(400) for j in range(i + 1, 400) if x[i] @ x[j] >= 0.9}


def test_empty_vectors(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_stars_and_islands(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_few_edges_are_joined_in_one_task_and_many_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame(rng.integers(-60, 60, (70, 2)).tolist(), "a long, b long")
    found = lambda: sorted((r["node"], r["component"]) for r in connected_components(edges, "a", "b").collect())
    with monkeypatch.context() as few:
        few.setattr(components, "_star", None)
        one = found()
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert one == found()


def test_a_worker_lets_go_of_a_codec_when_another_operator_begins():
    data = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = weakref.ref(bpe.codec(data, public_tokenizers.PATTERN))
    assert bpe.codec(data, public_tokenizers.PATTERN) is own()
    remembered("near_copies")
    assert own() is None


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    from nodeloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == counts[-1] and last.where("NOT lossless").count() == 0
    rejected = queries.op1_quality(spark, sf).where("predicted = 0").count()
    assert counts[1] == counts[0] - rejected
    times = before.join(docs.groupBy("doc_id").count(), "doc_id", "left").select(F.coalesce("count", F.lit(0)).alias("n"), F.length("text").alias("size"))
    assert times.where("n > 3").count() == 0
    taken = mixing.mix(before).agg(F.sum("taken")).first()[0]
    assert docs.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == taken
