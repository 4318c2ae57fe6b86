import math
import random

import numpy as np
import pytest

from tessella.llm import centroids, whitening
from tessella.llm.centroids import Bounds, cluster, digest
from tessella.llm.whitening import Summary, merged, summaries, whiten

VECTORS = "vec_id long, embedding array<float>, id string, x int, dims string, cluster string, n string, row string, rest int"


def frame(spark, rows, parts=5):
    """Other columns have the names that the operators use themselves."""
    return spark.createDataFrame([(i, v, "q", 7, "d", "c", "n", "r", 1) for i, v in rows], VECTORS).repartition(parts)


def integers(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


ODD = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 0.0, 0.0])]


def normal(seed, n, dims, scale=1.0):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(dims, dims))
    return [(i, [float(c) for c in v]) for i, v in enumerate((r.normal(size=(n, dims)) @ mixed * scale).astype(np.float32))]


# -- whitening


def check_whitened(got, rows):
    rows = [(i, integers(v)) for i, v in rows if good(v)]
    assert sorted((-1 if r.id is None else r.id) for r in got) == sorted((-1 if i is None else i) for i, _ in rows)
    spaces = {}
    for _, x in rows:
        spaces.setdefault(len(x), set()).add(tuple(x))
    by = {}
    for i, x in rows:
        by.setdefault((i, len(x)), []).append(x)
    for dims, distinct in spaces.items():
        fit = np.array(sorted(distinct), dtype=np.int64)
        n, s = len(fit), [sum(c) for c in zip(*sorted(distinct), strict=True)]
        mean = np.array([v / n for v in s])
        e, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
        e, axes = e[::-1], axes[:, ::-1].T
        own = [r for r in got if r.dims == dims]
        assert {r.n for r in own} == {n}
        assert {len(r.components) for r in own} == {min(4, dims)}
        sure = [k for k in range(min(4, dims)) if e[k] > 1e-9 * max(e[0], 1e-300)]
        assert all((r.identity_error is None) if not sure else r.identity_error < 1e-9 for r in own)
        sign = {}
        for r in sorted(own, key=lambda r: str(r.id)):
            options = by[(r.id, dims)]
            assert r.deviation in {sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for x in options}
            for k, c in enumerate(r.components):
                assert c.component == k + 1
                if k not in sure:
                    assert c.whitened is None and c.explained == 0
                    continue
                assert c.explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
                if len(options) == 1:
                    want = float((np.array(options[0]) - mean) @ axes[k] / e[k] ** 0.5)
                    if abs(want) > 1e-6:
                        sign.setdefault(k, math.copysign(1, want * c.whitened))
                        assert c.whitened * sign[k] == pytest.approx(want, rel=1e-6, abs=1e-8)


def test_whitening_is_brute_force(spark):
    rows = normal(1, 400, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(5, rows[7][1]), (None, rows[8][1])] + ODD
    check_whitened(whiten(frame(spark, rows)).collect(), rows)


def test_lengths_are_spaces_of_their_own(spark, monkeypatch):
    rows = normal(2, 60, 5) + [(500 + i, v) for i, v in normal(3, 40, 3)] + [(700, [1.0]), (701, [2.0]), (702, [2.0]), (800, [1.0, 2.0])] + ODD
    monkeypatch.setattr(whitening, "TASK_BYTES", 1)  # tasks hand in a summary after each batch, trees have two branches
    want = whiten(frame(spark, rows, 7)).collect()
    check_whitened(want, rows)
    monkeypatch.setattr(whitening, "BROADCAST_BYTES", 0)  # the model comes by a join
    again = whiten(frame(spark, rows, 3)).collect()
    assert sorted((r.id, r.deviation) for r in again) == sorted((r.id, r.deviation) for r in want)
    check_whitened(again, rows)


def test_few_constant_and_extreme_vectors(spark):
    for rows in ([(1, [0.5, 0.5, 0.25])], [(1, [0.5, 1.0, 3.0]), (2, [0.5, 2.0, 1.0])], [(i, [float(i), 1.0, 0.0]) for i in range(9)]):
        check_whitened(whiten(frame(spark, rows, 2)).collect(), rows)
    got = whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1.0, 1.0])], 2)).collect()
    assert {r.id: r.deviation for r in got} == {1: None, 2: None, 3: 513**2 + 256**2}
    assert all(math.isfinite(r.components[0].whitened) for r in got)
    assert whiten(frame(spark, ODD, 1)).count() == 0
    assert whiten(frame(spark, []).limit(0)).count() == 0


def test_merges_lose_nothing(spark):
    rows = np.array([v for _, v in normal(4, 500, 8)])
    whole = np.cov(rows.T, bias=True)
    one = Summary.of(rows[:3])
    for at in range(3, 500, 71):
        one = one.merged(Summary.of(rows[at : at + 71]))
    assert one.n == 500 and np.allclose(one.mean, rows.mean(0)) and np.allclose(one.root.T @ one.root / 500, whole, rtol=1e-12)
    assert len(one.root) == 8
    data = spark.createDataFrame([(8, [int(c * 256) for c in v]) for v in rows.tolist()], "dims int, x array<bigint>").repartition(9)
    found = merged(summaries(data)).collect()
    exact = (rows * 256).astype(int)
    assert len(found) == 1 and found[0].n == 500 and [int(v) for v in found[0].sums] == exact.sum(0).tolist()
    root = np.frombuffer(found[0].root).reshape(-1, 8)
    assert np.allclose(root.T @ root / 500, np.cov(exact.T, bias=True), rtol=1e-12)


# -- centroids


def plain(rows, k, rounds, dims):
    import hashlib

    rows = [(i, integers(v)) for i, v in rows if good(v) and len(v) == dims]
    rows.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [x for _, x in rows[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = {}
        for _, x in rows:
            own.setdefault(nearest(x)[1], []).append(x)
        cents = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(cents)]
    out = [(i, *nearest(x)[::-1]) for i, x in rows]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((-1 if i is None else i), j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), digest(cents[j])) for i, j, d in out)


def clustered(spark, rows, parts=4, **options):
    got = cluster(frame(spark, rows, parts), **options).collect()
    return sorted((-1 if r.id is None else r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, digest(r.centroid)) for r in got)


@pytest.mark.parametrize("scale,k", [(0.4, 12), (0.004, 9)])  # the small scale makes ties and equal vectors
def test_centroids_are_the_plain_rounds(spark, scale, k):
    rows = normal(5, 500, 4, scale)
    rows += [(2000 + i, rows[3][1]) for i in range(150)] + [(7, rows[9][1]), (None, rows[1][1]), (None, rows[2][1])] + ODD + [(950, [1.0] * 5)]
    options = {"k": k, "rounds": 5, "dims": 4}
    assert clustered(spark, rows, **options) == plain(rows, k, 5, 4)


def test_centroids_of_odd_tables(spark):
    few = normal(6, 3, 4)
    assert clustered(spark, few, dims=4) == plain(few, 40, 5, 4)
    assert clustered(spark, few[:1] * 3, dims=4, k=2) == plain(few[:1] * 3, 2, 5, 4)
    assert clustered(spark, few, dims=4, k=1, rounds=0) == plain(few, 1, 0, 4)
    large = few + [(50, [1e5, -2e5, 3.0, 4.0]), (51, [1e30, 0.0, 0.0, 0.0])]
    got, want = clustered(spark, large[:4], dims=4, k=2), plain(large[:4], 2, 3, 4)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert len(clustered(spark, large, dims=4, k=2)) == 5
    assert clustered(spark, ODD, dims=4) == []
    assert cluster(frame(spark, []).limit(0)).count() == 0


def test_bounds_hold_and_spare_work():
    r = np.random.default_rng(7)
    middle = r.integers(-3000, 3000, (24, 6))
    x = middle[r.integers(0, 24, 4000)] + r.integers(-90, 90, (4000, 6))
    c = x[:24].copy()
    b = 6
    state = Bounds.scanned(x, c, b)
    scans = 0
    for _ in range(8):
        new = np.array([x[state.cluster == j].sum(0) // max(1, (state.cluster == j).sum()) if (state.cluster == j).any() else c[j] for j in range(24)])
        moves = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        c = new
        state.moved(moves, b)
        b = max(3, b - 1) if b > 4 else b
        state.near, state.lower = state.near[:, :], state.lower[:, :]
        scans += state.settle(x, c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (state.cluster == d.argmin(1)).all()
        true = np.sqrt(d.astype(float))
        assert (state.upper >= true[np.arange(4000), state.cluster] * (1 - 1e-12)).all()
        assert (state.lower <= np.take_along_axis(true, state.near, 1) * (1 + 1e-12)).all()
        other = true.copy()
        other[np.arange(4000), state.cluster] = np.inf
        np.put_along_axis(other, state.near.astype(int), np.inf, 1)
        assert (state.rest <= other.min(1) * (1 + 1e-12)).all()
    assert scans < 8 * 4000 / 3


def test_distances_are_exact_at_any_size():
    r = random.Random(8)
    for top in (100, 1 << 21, 1 << 40, (1 << 63) - 1):
        x = [[r.randint(-top, top) for _ in range(5)] for _ in range(6)]
        c = [[r.randint(-top, top) for _ in range(5)] for _ in range(3)]
        want = [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
        got = centroids.squared(np.array(x), np.array(c))
        assert [[int(v) for v in row] for row in got] == want
        assert [int(v) for v in centroids.squared_each(np.array(x[:3]), np.array(c))] == [want[i][i] for i in range(3)]
