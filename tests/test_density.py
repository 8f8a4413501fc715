"""The hierarchy of density clusters against a plain version: Kruskal's tree, a top-down condensed tree, excess of mass."""

import numpy as np
import pytest

from quarry.operators import _tables, density
from quarry.plans import map_queries


def plain_clusters(x, size=5, samples=5):
    """[(label by size and first point, probability)] of the rows of x."""
    n = len(x)
    if n < size:
        return [(-1, 0.0)] * n
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    i, j = np.triu_indices(n, 1)
    top, edges = list(range(n)), []

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for k in np.lexsort((j, i, d[i, j])):
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            top[a] = b
            edges.append((d[i[k], j[k]], int(i[k]), int(j[k])))
    kids, count, top = {}, dict.fromkeys(range(n), 1), list(range(n))

    for k, (w, a, b) in enumerate(edges):
        a, b = find(a), find(b)
        top.append(n + k)
        top[a] = top[b] = n + k
        kids[n + k], count[n + k] = (a, b, w), count[a] + count[b]

    def below(a):
        out, todo = [], [a]
        while todo:
            b = todo.pop()
            out += [b] if b < n else []
            todo += kids[b][:2] if b >= n else ()
        return out

    density_of = lambda w: 1 / max(w, 1e-12)
    born, parent, rows, todo, names = {0: 0.0}, {0: None}, [], [(2 * n - 2, 0)], 1
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        a, b, w = kids[node]
        for part in (a, b):
            if count[part] < size:
                rows += [(c, p, density_of(w), 1) for p in below(part)]
            elif min(count[a], count[b]) >= size:
                born[names], parent[names] = density_of(w), c
                rows.append((c, ("cluster", names), density_of(w), count[part]))
                todo.append((part, names))
                names += 1
            else:
                todo.append((part, c))
    mass = {c: sum((lam - born[c]) * z for p, _, lam, z in rows if p == c) for c in born}
    value, chosen = {}, set()
    for c in sorted(born, reverse=True):
        under = sum(value[k] for k in parent if parent[k] == c)
        if c and mass[c] >= under:
            chosen.add(c)
        value[c] = max(mass[c], under)
    label, prob = {}, {}
    most = {c: max(lam for p, _, lam, _ in rows if p == c) for c in born}
    for c, p, lam, _ in rows:
        if not isinstance(p, tuple):
            path, a = [], c
            while a is not None:
                path.append(a)
                a = parent[a]
            own = [a for a in reversed(path) if a in chosen]
            label[p] = own[0] if own else -1
            prob[p] = min(lam, most[own[0]]) / most[own[0]] if own else 0.0
    groups = {c: sorted(p for p in label if label[p] == c) for c in set(label.values()) - {-1}}
    numbers = {c: k for k, (c, _) in enumerate(sorted(groups.items(), key=lambda g: (-len(g[1]), g[1][0])))}
    return [(numbers.get(label[p], -1), prob[p]) for p in range(n)]


def clusters_of(spark, x, *args, **how):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    return [(r["cluster"], r["cluster_probability"]) for r in sorted(density.hdbscan(df, *args, **how).collect(), key=lambda r: r["vec_id"])]


def agree(got, want):
    assert [c for c, _ in got] == [c for c, _ in want]
    np.testing.assert_allclose([p for _, p in got], [p for _, p in want], atol=1e-9)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_plain_version(spark, sf):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect())
    want = plain_clusters(np.array([v for _, v in rows], dtype=np.float64))
    got = [(r.cluster, r.cluster_probability) for r in sorted(map_queries.hdbscan(spark, f"/root/testdata/{sf}").collect(), key=lambda r: r.vec_id)]
    assert [c for c, _ in got] == [c for c, _ in want]
    np.testing.assert_allclose([p for _, p in got], [p for _, p in want], atol=1e-6)
    assert len({c for c, _ in got}) > 2


def nested(n=150):
    """Clusters in clusters of unlike density, a chain, and scattered points."""
    rng = np.random.default_rng(8)
    parts = [rng.normal(c, s, (n // 6, 2)) for c, s in (((0, 0), 0.1), ((1, 0), 0.1), ((0.5, 3), 0.6), ((9, 9), 0.05))]
    line = np.stack([np.linspace(20, 30, n // 6), np.zeros(n // 6)], axis=1) + rng.normal(0, 0.02, (n // 6, 2))
    return np.concatenate([*parts, line, rng.uniform(-20, 40, (n // 6, 2))])


@pytest.mark.parametrize(("size", "samples"), [(3, 1), (12, 4)])
def test_nested_clusters(spark, size, samples):
    x = nested()
    agree(clusters_of(spark, x, size, samples, neighbours=4), plain_clusters(x, size, samples))


def test_rounds_and_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(_tables, "HOT_ROWS", 2)
    x = nested(90)
    want = plain_clusters(x)
    agree(clusters_of(spark, x, clusters_at_once=0, neighbours=5), want)


def test_few_points_and_odd_rows(spark):
    x = nested(60)
    assert clusters_of(spark, x[:4]) == [(-1, 0.0)] * 4
    assert clusters_of(spark, x[:0]) == [] and clusters_of(spark, x[:1]) == [(-1, 0.0)]
    schema = "vec_id long, embedding array<double>, cluster string"
    rows = [(k, v.tolist(), "a") for k, v in enumerate(x)] + [(None, [0.0, 0.0], None), (99, None, "b"), (5, x[5].tolist(), None)]
    got = sorted((r["vec_id"], r["cluster"]) for r in density.hdbscan(spark.createDataFrame(rows, schema)).collect())
    assert got == [(k, c) for k, (c, _) in enumerate(plain_clusters(x))]
    same = density.hdbscan(spark.createDataFrame([(k, [float(k >= 10), 0.0]) for k in range(20)], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] // 10: r["cluster"] for r in same} == {0: 0, 1: 1} and {r["cluster_probability"] for r in same} == {1.0}
