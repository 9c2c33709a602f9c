"""Vector links against brute force, the queries against SQL, and the pipeline's rules."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from formloom.llm import near_vectors, queries
from formloom.llm.graph import components

SF = "/root/testdata/sf0.001"


def vectors():
    rng, rows = np.random.default_rng(9), []
    for label in (0, 1):
        for _ in range(12):
            v = rng.normal(size=8)
            rows += [(label, (v + rng.normal(size=8) * s).tolist()) for s in rng.choice([0, 0.01, 0.08, 0.15], 5)]
    rows += [rows[0]] * 30 + [(0, [2 * x for x in rows[0][1]]), (None, rows[0][1]), (0, None), (0, []), (0, [0.0] * 8), (0, [1.0, None] * 4), (0, [float("nan")] * 8), (0, [1.0] * 5), (0, [2.0] * 5), (0, [3.0]), (0, [float("inf")] * 8)]
    return [(i, e, label) for i, (label, e) in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 7])
def test_vector_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = vectors()
    fine = [x is not None and label is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x, label in rows]
    near = set()
    for i, x, a in rows:
        for j, y, b in rows[:i]:
            if fine[i] and fine[j] and a == b and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                near.add((i, j))
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1))
    got = near_vectors.links(table, codes=3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == (sum(r.vec_id in x for x in near), root[r.vec_id]), r
        assert r.kept == (r.component_id == r.vec_id)
    assert near_vectors.links(table.where("false")).count() == 0


def test_the_walk_visits_every_cell_within_the_bound():
    rng = np.random.default_rng(3)
    a, b = rng.random(20), rng.random(30)
    got = near_vectors.traverse(a, b, 0.7)
    assert set(got) == {(i, j) for i in range(20) for j in range(30) if a[i] + b[j] <= 0.7}
    assert [a[i] + b[j] for i, j in got] == sorted(a[i] + b[j] for i, j in got)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare.difference(entry.queries()[name](spark, SF), compare.connect(SF), queries.ORACLES[name]) == ""


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("12 34 !!")})
    docs = docs.union(strange).withColumns({"score": F.lit(1), "spans": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs, stage(spark, docs, SF).cache()
        assert after.columns == before.columns
        assert after.select("doc_id").distinct().count() == after.count() <= before.count(), name
        if name == "language ID":
            assert after.where("doc_id = -1").count() == 0 and after.count() == before.count() - 1
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert entry.queries()["pipeline"](spark, SF).count() > 0
