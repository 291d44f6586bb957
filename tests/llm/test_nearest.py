"""Nearest neighbours against brute force in double precision."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ann, queries


def recall(rows, ids, x, asked, k=20):
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in asked:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        best = [i for i in ids[np.lexsort((ids, -np.round(score, 12)))] if i != q][:k]
        hits += len(found[q] & set(best))
    return hits / (k * len(asked))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_test_tables(spark, size):
    if not Path(f"/root/testdata/{size}").exists():
        pytest.skip("the test tables are not here")
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    asked = ids[ids % 20 == 0]
    rows = queries.op9_nearest(spark, f"/root/testdata/{size}").collect()
    assert len(rows) == 20 * len(asked) and recall(rows, ids, x, asked) >= 0.95


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    return 4 * r.standard_normal((n // 50, dim))[r.integers(0, n // 50, n)] + 0.5 * r.standard_normal((n, dim))


def test_structure_saves_lists_and_columns():
    x = clustered(6000, 48, 1)
    index = ann.Index(x, float((x**2).sum(1).max()), len(x), 20, ann.TARGET_RECALL)
    own = ann.list_order(index.lifted(x, False), index.centre, 1)[:, 0]
    index.fill(dict(zip(*np.unique(own, return_counts=True), strict=True)), 500)
    assert index.probes < 0.4 * len(index.centre)
    q = x[::60]
    floor = index.floor(q)
    i, j, read = ann.scan(index.lifted(q, True), index.lifted(x, False), index.radius(q, floor))
    assert read < 0.5 * len(q) * x.size + len(q) * len(x)
    score = q @ x.T
    near = score >= np.sort(score, axis=1)[:, -20:-19]
    kept = np.zeros_like(near)
    kept[i, j] = True
    # the tests' error: of the true neighbours in all lists, hardly any is abandoned
    assert (near & kept).sum() >= 0.98 * near.sum()
    for lists in index.probed(q):
        whole = [-1 - g for g in lists if g < 0]
        assert index.sizes[whole].sum() >= 21


def test_ids_of_text_ties_and_lengths(spark):
    x = clustered(400, 8, 2)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:140] = x[5]
    rows = [(f"v{k:03}", [float(a) for a in y], "x", 1.0) for k, y in enumerate(x)] + [("v005", [float(a) for a in x[5]], "x", 1.0), (None, [1.0] * 8, "x", 1.0)]
    table = spark.createDataFrame(rows, "name string, v array<double>, vec_id string, score double")
    got = {}
    for r in ann.search(table, "name", "v", F.col("name") < "v010").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {f"v{k:03}" for k in range(10)} and all(len(g) >= 20 for g in got.values())
    # two rows have that id, so each rank is listed twice, and each is the other one's neighbour
    assert got["v005"][:40:2] == ["v005", *(f"v{k}" for k in range(100, 119))]


def test_few_and_odd_vectors(spark):
    schema = "id long, v array<double>"
    search = lambda rows: [tuple(r) for r in ann.search(spark.createDataFrame(rows, schema), "id", "v", F.col("id") % 2 == 0).orderBy("query_id", "rank").collect()]
    assert search([]) == [] and search([(2, None), (4, []), (6, [0.0, 0.0])]) == []
    assert search([(2, [1.0, 0.0])]) == []
    assert search([(2, [1.0, 0.0]), (3, [2.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, float("inf")])]) == [(2, 1, 3, 2.0), (2, 2, 5, 0.0)]
