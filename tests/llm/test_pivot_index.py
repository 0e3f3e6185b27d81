"""The pivot index against all pairs: planted clusters of several widths, copies, edges; recall at the threshold."""

import numpy as np
import pytest

from farewright.llm import pivot_index
from tests.llm.test_corpus_operators import groups


def brute(rows, cosine=0.95):
    """(n_links, component, kept) of each row."""
    sound = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {i: pivot_index.unit(np.array([rows[i][1]], float))[0] for i in sound}
    near = lambda i, j: i in u and j in u and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= cosine
    links = [sum(near(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    of = groups(len(rows), near)
    least = {}
    for i, g in enumerate(of):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted(((r[0], n, least.get(g), r[0] == least.get(g)) for r, n, g in zip(rows, links, of)), key=repr)


def run(spark, rows, **kw):
    got = pivot_index.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int"), **kw).collect()
    return sorted((tuple(r) for r in got), key=repr)


def planted(spread, size, dim=32, lone=150, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((3, dim))
    members = [c + r.standard_normal((size, dim)) * spread for c in centres]
    vectors = np.vstack([*members, r.standard_normal((lone, dim))]).astype(np.float32)
    return [(int(i), [float(x) for x in v]) for i, v in zip(r.permutation(len(vectors)), vectors)]


@pytest.mark.parametrize("crowd", [8, 10**9])
@pytest.mark.parametrize("spread", [0.01, 0.12, 0.2])
def test_clusters(spark, spread, crowd, monkeypatch):
    """Tight groups (one ball), and wide ones whose members are only partly linked: balls give the same links as none."""
    monkeypatch.setattr(pivot_index, "CROWD", crowd)
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rows = planted(spread, 60)
    want, got = brute(rows), run(spark, rows)
    missed = sum(w[1] for w in want) - sum(g[1] for g in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and missed <= 0.03 * sum(w[1] for w in want)
    if spread < 0.2:
        assert [g[2:] for g in got] == [w[2:] for w in want]


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(3)
    x = pivot_index.unit(r.standard_normal((400, 64)))
    w = r.standard_normal((400, 64))
    w = pivot_index.unit(w - (w * x).sum(axis=1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * w
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, y]))]
    got = run(spark, rows)
    assert sum(n == 1 for _, n, _, _ in got) >= 0.95 * 800 and all(c in (i, i - 400) for i, _, c, _ in got)


def test_edges(spark):
    a, b = [1.0, 2.0, 3.0], [-3.0, 0.5, 1.0]
    rows = [(1, a), (2, a), (3, [2.0, 4.0, 6.0]), (4, b), (None, b), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 3.0]), (9, [float("nan"), 1.0, 1.0]),
            (10, [float("inf"), 1.0, 1.0]), (11, [1.0, 2.0, 3.0, 0.0]), (12, [1e-30, 0.0, 0.0]), (12, [1e30, 0.0, 0.0]), (None, [0.0, 0.0, -1.0]), (13, [5.0])]
    want = [(v, n, c, k or (v is None and c is None)) for v, n, c, k in brute([r for r in rows])]
    want = [(v, n, v if v in (5, 6, 7, 8, 9, 10) else c, k) for v, n, c, k in want]
    assert run(spark, rows) == sorted(want, key=repr)
    assert run(spark, []) == []


def test_many_copies(spark):
    """A third of all rows one vector, another third within one ball: no pairs, whole counts."""
    r = np.random.default_rng(5)
    hot = r.standard_normal(64)
    vectors = [hot] * 500 + list(hot + r.standard_normal((500, 64)) * 0.02) + list(r.standard_normal((500, 64)))
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    assert all((n, c) == ((999, 0) if i < 1000 else (0, i)) and k == (i == c) for i, n, c, k in got)
