"""All-pairs neighbours over many parts, clusters that end where they begin, and clusters without broadcasts."""

import numpy as np
import pytest
from test_density import agree, clusters_of, nested, plain_clusters

from quarry.operators import _tables, similarity


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_all_pairs_equal_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(similarity, "HELD_BYTES", 8 * 6 * 40)
    monkeypatch.setattr(similarity, "TILE", (16, 32))
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(230, 6)).astype(np.float32).astype(float)
    x[100:120] = x[100]  # equal rows, in order of id
    x[200:210] *= 2.0**40  # single precision can't tell the others apart beside these
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = x / np.sqrt((x * x).sum(1, keepdims=True)) if metric == "cosine" else x
    near = (y[:, None] * y[None]).sum(-1) if metric == "cosine" else -np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    np.fill_diagonal(near, -np.inf)
    found = similarity.knn(df, None, 4, metric)
    got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in found.collect()}
    assert got == {(q, r + 1): int(j) for q in range(230) for r, j in enumerate(np.argsort(-near[q], kind="stable")[:4])}


def test_a_list_leaves_a_part_once_and_few_pairs_are_compared(monkeypatch):
    compared, scores = [], similarity._scores
    monkeypatch.setattr(similarity, "_scores", lambda q, x, i, j, metric: compared.append(len(i)) or scores(q, x, i, j, metric))
    x = np.random.default_rng(1).normal(size=(6144, 16))
    lists = similarity._Lists(np.arange(1024), x[:1024], 15, "euclidean")
    for at in range(0, 6144, 2048):
        lists.meet(np.arange(at, at + 2048), x[at : at + 2048])
    lists.settle()
    assert len(lists.best[0]) == 1024 * 15 and sum(compared) < 0.02 * 1024 * 6144


def test_clusters_that_end_where_they_begin(spark):
    """Runs of equally spaced points, of which those that touch are joined last, at the same distance."""
    x, at = {}, 0
    sizes = [6, 7, 9, 10, 11, 13, 14]
    low, high = 0, 1000
    for size in sizes:
        for k in range(size):
            key, low, high = (high, low, high + 1) if k in (0, size - 1) else (low, low + 1, high)
            x[key], at = at * 49.0, at + 1
    x = np.array([[x[key]] for key in sorted(x)])
    want = plain_clusters(x, 5, 1)
    assert len({c for c, _ in want} - {-1}) > 1
    agree(clusters_of(spark, x, 5, 1), want)


def test_without_broadcasts_the_same(spark, monkeypatch):
    monkeypatch.setattr(_tables, "HOT_ROWS", 2)
    monkeypatch.setattr(_tables, "BROADCAST_BYTES", -1)
    x = nested(90)
    agree(clusters_of(spark, x, clusters_at_once=0, neighbours=5), plain_clusters(x))
