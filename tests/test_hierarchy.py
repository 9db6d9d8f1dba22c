"""The density hierarchy against a direct computation on the whole matrix of distances."""

import numpy as np
import pytest

from quillgraph.operators import cluster, hierarchy

SCHEMA = "vec_id long, embedding array<double>, cluster string, weight int"


def direct(x, least=6, neighbours=2):
    """Labels by recursion downwards: at each weight the components of the edges below it; stability by the sums of its definition."""
    n = len(x)
    square = (x * x).sum(1)
    d = np.maximum(np.round(np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0)), hierarchy.DIGITS), hierarchy.LEAST)
    inf = d + np.diag(np.full(n, np.inf))
    core = np.sort(inf, axis=1)[:, neighbours - 1]
    m = np.maximum(d, np.maximum(core[:, None], core))

    def parts(of, under):
        left, out = set(of), []
        while left:
            front, seen = [min(left)], set()
            while front:
                i = front.pop()
                if i in seen:
                    continue
                seen.add(i)
                front += [j for j in left if j not in seen and j != i and m[i, j] < under]
            left -= seen
            out.append(sorted(seen))
        return out

    def grow(of, birth):
        """(stability or best below, choice of sets) of the cluster that is born with these points."""
        total, now = 0.0, of
        while True:
            weights = sorted({m[i, j] for i in now for j in now if i < j}, reverse=True)
            split = None
            for w in weights:
                found = parts(now, w)
                if len(found) > 1:
                    split = (w, found)
                    break
            w, found = split
            large = [p for p in found if len(p) >= least]
            if len(large) == 1:
                total += (len(now) - len(large[0])) * (1 / w - birth)
                now = large[0]
                continue
            total += len(now) * (1 / w - birth)
            kids = [grow(p, 1 / w) for p in large]
            below = sum(k[0] for k in kids)
            if total >= below:
                return total, [of]
            return below, [c for k in kids for c in k[1]]

    now, chosen = list(range(n)), []
    while True:  # the root is no cluster: go down to its first real split
        weights = sorted({m[i, j] for i in now for j in now if i < j}, reverse=True)
        w, found = next((w, f) for w in weights if len(f := parts(now, w)) > 1)
        large = [p for p in found if len(p) >= least]
        if len(large) == 1:
            now = large[0]
            continue
        chosen = [c for p in large for c in grow(p, 1 / w)[1]]
        break
    labels = np.full(n, -1)
    for c in chosen:
        labels[c] = min(c)
    return labels


def planted(rng, sizes, spread, noise, d=8):
    centres = rng.normal(size=(len(sizes), d)) * 4
    rows = [c + s * rng.normal(size=(k, d)) for c, k, s in zip(centres, sizes, spread)]
    return np.vstack([*rows, rng.normal(size=(noise, d)) * 4])


def run(spark, x, **kw):
    df = spark.createDataFrame([(i, v.tolist(), "c", 1) for i, v in enumerate(x)], SCHEMA)
    got = dict(hierarchy.density_hierarchy(df, x.shape[1], **kw).collect())
    return np.array([got[i] for i in range(len(x))])


def reduced(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = x - x.mean(0)
    return c @ np.linalg.svd(c, full_matrices=False)[2][:k].T


def same_groups(a, b):
    return {tuple(np.flatnonzero(a == k)) for k in set(a) - {-1}} == {tuple(np.flatnonzero(b == k)) for k in set(b) - {-1}}


@pytest.mark.parametrize("seed", [1])
def test_equal_to_the_direct_hierarchy(spark, seed):
    x = planted(np.random.default_rng(seed), [25, 15, 20], [0.2, 0.6, 0.05], 15)
    labels = run(spark, x, components=6)
    assert same_groups(labels, direct(reduced(x, 6)))
    for k in range(3):  # clusters of different density are found whole
        of = labels[[0, 25, 40][k] : [25, 40, 60][k]]
        assert len(set(of) - {-1}) == 1 and (of != -1).mean() >= 0.9


def test_many_bands_give_the_same(spark, monkeypatch):
    x = planted(np.random.default_rng(3), [20, 20, 14], [0.3, 0.1, 0.5], 10)
    want = run(spark, x)
    monkeypatch.setattr(hierarchy, "BAND", 15)
    assert (run(spark, x) == want).all()


def test_many_cells_find_the_members(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = planted(rng, [120, 80, 100], [0.3, 0.1, 0.5], 20)
    want = run(spark, x)
    monkeypatch.setattr(cluster, "LARGEST", 100)
    monkeypatch.setattr(cluster, "ROOM", 40)
    got = run(spark, x)
    for k in set(want) - {-1}:
        of = want == k
        best = max((got[of] == c).sum() for c in set(got[of]) - {-1})
        assert best >= 0.9 * of.sum()


def test_spanning_forest(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 9, 150))]
    got = [tuple(r) for r in hierarchy.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()]
    up = list(range(40))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    total = links = 0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if root(a) != root(b):
            up[root(a)] = root(b)
            total, links = total + w, links + 1
    assert (len(got), sum(w for _, _, w in got)) == (links, total)


def test_awkward_vectors(spark):
    blob = [(i, [1.0, 0.01 * (i % 4)], "c", 1) for i in range(12)] + [(20 + i, [-1.0, 0.01 * (i % 5)], "c", 1) for i in range(12)]
    odd = [(50, None, "c", 1), (51, [], "c", 1), (52, [0.0, 0.0], "c", 1), (53, [float("nan"), 1.0], "c", 1), (None, [1.0, 0.0], "c", 1), (54, [1.0, None], "c", 1)]
    got = [tuple(r) for r in hierarchy.density_hierarchy(spark.createDataFrame(blob + odd, SCHEMA), 2).collect()]
    assert sorted(c for i, c in got if i is not None and i < 40) == [0] * 12 + [20] * 12
    assert {c for i, c in got if i is None or i >= 50} == {-1} and len(got) == 30
    for few in ([], odd, blob[:1], blob[:3]):
        assert {r.cluster for r in hierarchy.density_hierarchy(spark.createDataFrame(few, SCHEMA), 2).collect()} <= {-1}
