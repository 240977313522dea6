"""k-means of several starts in one pass against a plain computation."""

import numpy as np

from millrace.operators import vectors


def plain(x, c, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.allclose(moved, c, atol=1e-13, rtol=0):
            break
        c = moved
    return c, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_starts_run_together_as_they_run_alone(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.4, (60, 3)) for m in ((0, 0, 0), (3, 0, 0), (0, 4, 1))])
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), (x[0].tolist(),)], "embedding array<double>").repartition(3)
    every = np.concatenate([x, x[:1]])
    starts = vectors.seeded_starts(df, 4, [0, 1, 2])
    assert starts.shape == (3, 4, 3) and all(len(np.unique(s, axis=0)) == 4 for s in starts)
    assert np.array_equal(starts, vectors.seeded_starts(df.repartition(5), 4, [0, 1, 2]))
    starts[2, 3] = 99.0  # no vector is near it: it stays
    for rounds in (0, 1, 30):
        centroids, costs = vectors.lloyd_fits(df, starts, rounds=rounds)
        for s in range(3):
            c, cost = plain(every, starts[s], rounds)
            assert np.allclose(centroids[s], c, atol=1e-9) and np.isclose(costs[s], cost)
    best = vectors.fit_centroids(df, k=4, tries=3, rounds=30)
    assert np.allclose(best, min((plain(every, s, 30) for s in vectors.seeded_starts(df, 4, [0, 1, 2])), key=lambda f: f[1])[0], atol=1e-9)
