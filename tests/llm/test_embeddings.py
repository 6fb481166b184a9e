"""The forest: against brute force with leaves split on, recall on planted pairs, double vectors."""

import numpy as np
import pytest

from logmill.llm import embedding_dedup as ed


def brute(vectors, threshold=0.95):
    good = {i: np.array(v, "f8") for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    good = {i: v / np.abs(v).max() for i, v in good.items()}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    near = {i: [j for j in good if i in good and j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold] for i in range(len(vectors))}
    head = {}
    for i in near:  # ascending, so that the first to reach a vector is the least
        todo = [i]
        while todo:
            if (j := todo.pop()) not in head:
                head[j] = i
                todo += near[j]
    return {i: (len(near[i]), head[i], head[i] == i) for i in near}


def got(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_vectors(df, **options).collect()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_edge_cases_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 8)).astype("f4").astype("f8")
    near = (x[:10] + 0.05 * rng.standard_normal((10, 8))).astype("f4").astype("f8")
    vectors = [*x.tolist(), *near.tolist(), x[3].tolist(), None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [1.0, None], [1.0, 2.0], [2.0, 4.0], [float("inf"), 1.0], [-0.0, 1.0], [0.0, 1.0]]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, key string, leaf int")
    assert got(df) == brute(vectors)
    assert ed.near_vectors(df.limit(0)).count() == 0
    twice = ed.near_vectors(df.where("vec_id = 3").union(df.where("vec_id = 3")).selectExpr("if(rand(1) > 2, 1L, null) as vec_id", "embedding")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in twice] == [(None, 1, None, False)] * 2


def test_doubles_are_compared_as_doubles(spark):
    """Two vectors whose cosine is 0.95 only as doubles, and sizes whose squares no double holds."""
    a, c = 1.0, np.sqrt(1 / 0.95**2 - 1)
    vectors = [[a, 0.0], [1.0, float(c) * (1 - 1e-12)], [1.0, float(c) * (1 + 1e-9)], [1e200, 1e200], [3e-200, 3e-200]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    out = got(df)
    assert out == brute(vectors) and out[0][0] == 1 and out[3][0] == 1


def planted(rng, n, dim, pairs):
    """Unit vectors, and to the first `pairs` of them others at a cosine of 0.95 to 0.96."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    y -= (y * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.9501, 0.96, (pairs, 1))
    return np.concatenate([x, cos * x[:pairs] + np.sqrt(1 - cos**2) * y])


def test_recall_on_planted_pairs(spark):
    """20,000 vectors and 2,000 more near them, through deep trees: leaves of 250, fitted on 2,000, so that leaves are split on."""
    x = planted(np.random.default_rng(1), 20_000, 64, 2000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    for options in ({}, {"leaf": 100, "sample": 2000}):
        rows = {r.vec_id: r for r in ed.near_vectors(df, **options).collect()}
        found = sum(rows[i].n_links == 1 and rows[20_000 + i].component_id == i and not rows[20_000 + i].kept for i in range(2000))
        assert found >= 0.98 * 2000
        assert sum(r.n_links for r in rows.values()) <= 4000  # none below the threshold


def test_leaves_stay_small(spark):
    """However many vectors, a leaf that can be split holds MOST times LEAF at most; one spot can't be split."""
    rng = np.random.default_rng(2)
    spot = np.ones((300, 16)) + 1e-3 * rng.standard_normal((300, 16))
    x = np.concatenate([rng.standard_normal((3000, 16)), spot])
    raw = [(16, f"{i:05d}", v.astype("<f8").tobytes()) for i, v in enumerate(x)]
    classes = spark.createDataFrame(raw, "dim int, key string, raw binary")
    placed = ed.place(classes, "<f8", trees=2, bound=0.02, sample=200, leaf=40, seed=1)
    rows = placed.collect()
    sizes = {}
    for r in rows:
        assert len(r.leaves) >= 2 and r.leaves == sorted(r.leaves)
        for n in r.leaves:
            sizes.setdefault(n, []).append(int(r.key))
    assert len(rows) == 3300
    assert all(len(v) <= ed.MOST * 40 or sum(i >= 3000 for i in v) > 0.5 * len(v) for v in sizes.values())


def test_leaves_split_on_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 12))
    x = centres[rng.integers(0, 60, 1500)] + 0.12 * rng.standard_normal((1500, 12))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    want, have = brute(x.tolist()), got(df, leaf=60, sample=300, margin=0.5)
    assert sum(want[i][0] for i in want) > 5000 and sum(want[i] == have[i] for i in want) >= 0.99 * len(want)
