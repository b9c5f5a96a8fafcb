"""Operators 11 and 13 against brute force and exact arithmetic."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from zonewright.llm import clustering as C
from zonewright.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


def brute_clusters(rows, k=40, rounds=5, dim=64, scale=256):
    ok = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c * scale) for c in v)]
    h = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(ok, key=lambda r: (r[0] is None, h(r[0]), r[1]))[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v):
        return min((d2(v, c), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in ok:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    got = [(i, *nearest(v)) for i, v in ok]
    most = (1 << 63) - 1
    per = {}
    for _, d, c in got:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, most), min(per[c], most), min(sum(per.values()), most), sha[c]) for i, d, c in got), key=repr)


def clusters(df, **kw):
    return sorted((tuple(r) for r in C.clustered(df, **kw).collect()), key=repr)


def test_op11_sql(agrees):
    agrees(C.op11_centroid_clustering, C.OP11_SQL)


def test_op11_odd_rows(spark, duck):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(7, 64))
    rows = [(i, (middles[i % 7] + 0.1 * rng.normal(size=64)).tolist(), "a", 1) for i in range(300)]
    hot = rows[0][1]
    rows += [(1000 + i, hot, "a", 1) for i in range(700)]
    rows += [rows[3], rows[3], (None, hot, None, None), (None, rows[5][1], None, None)]
    odd = [(5000, None, "n", 1), (5001, [1.0] * 63, "n", 1), (5002, [1.0] * 63 + [None], "n", 1), (5003, [float("nan")] + [0.0] * 63, "n", 1), (5004, [float("inf")] + [0.0] * 63, "n", 1), (5005, [], "n", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    want = brute_clusters([r[:2] for r in rows + odd])
    assert clusters(df, block=16) == want
    assert len(want) == len(rows)
    con = duck.cursor()
    import pandas as pd

    held = pd.DataFrame([r[:2] for r in rows + odd], columns=["vec_id", "embedding"])  # noqa: F841
    con.execute("CREATE TEMP TABLE embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM held")
    assert sorted(con.execute(C.OP11_SQL).fetchall(), key=repr) == want


def test_op11_huge_and_few(spark):
    rows = [(i, [(-1) ** i * 2.0 ** (20 * i % 300) * (j + 1) for j in range(4)], "a", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clusters(df, k=3, rounds=3, dim=4, block=4) == brute_clusters([r[:2] for r in rows], 3, 3, 4)
    few = spark.createDataFrame(rows[:2], SCHEMA)
    assert clusters(few, dim=4) == brute_clusters([r[:2] for r in rows[:2]], dim=4)
    assert clusters(spark.createDataFrame([], SCHEMA)) == []


def test_hilbert_visits_neighbours():
    places = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    along = C.hilbert(places, 3)
    assert sorted(along.tolist()) == list(range(512))
    path = places[np.argsort(along)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_zone_maps_prune_and_keep_the_nearest():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(40, 64)).round(2) * 256
    pruned = 0
    for _ in range(50):
        v = np.floor(c[rng.integers(40)] + rng.normal(size=(30, 64)) * 12)
        near = C.candidates(v.min(0), v.max(0), c)
        best = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
        assert set(best.tolist()) <= set(near.tolist())
        pruned += 40 - len(near)
    assert pruned > 50 * 20


def exact_whitening(rows, scale=64, offset=1_000_000):
    xs = [(i, tuple(math.floor(scale * c) + offset for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, dim = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit, strict=True)]
    cov = [[sum((Fraction(x[a]) - Fraction(s[a], n)) * (Fraction(x[b]) - Fraction(s[b], n)) for x in fit) / n for b in range(dim)] for a in range(dim)]
    return xs, fit, n, s, cov


def test_op13_against_exact_covariance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 6)) * np.array([3, 1, 0.5, 0.2, 0.1, 0.05])[:, None]
    rows = [(i, (rng.normal(size=6) @ base).tolist(), "a", 1) for i in range(120)]
    rows += [rows[0]] * 50 + [(None, rows[1][1], None, None)]
    odd = [(900, None, "n", 1), (901, [1.0, None] + [0.0] * 4, "n", 1), (902, [float("nan")] * 6, "n", 1), (903, [1.0], "n", 1), (904, [], "n", 1)]
    got = W.whitened(spark.createDataFrame(rows + odd, SCHEMA).repartition(4), parts=4).collect()
    xs, fit, n, s, cov = exact_whitening([r[:2] for r in rows])
    assert len(got) == 4 * len(rows)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(cov[i][i] for i in range(6)))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), r)
    sign = {}
    for i, x in xs:
        y = np.array([float(Fraction(c) - Fraction(t, n)) for c, t in zip(x, s, strict=True)])
        for k in range(4):
            r = by[i, k + 1]
            assert (r.n, r.deviation) == (n, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)))
            want = float(y @ vectors[:, k]) / math.sqrt(values[k])
            sign.setdefault(k, 1 if want * r.whitened > 0 else -1)
            assert r.whitened * sign[k] == pytest.approx(want, abs=1e-9)
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-10)
            assert r.identity_error < 1e-9


def test_op13_degenerate(spark):
    one = W.whitened(spark.createDataFrame([(1, [0.5, 1.0], "a", 1), (2, [0.5, 1.0], "a", 1)], SCHEMA)).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)}
    # All variance along one direction, entries that leave no room in 62 bits, and a deviation outside 64 bits.
    rows = [(i, [float(i), float(i)], "a", 1) for i in range(5)] + [(9, [1e300, 1e300], "a", 1)]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert {r.deviation for r in got} == {(1 << 63) - 1}
    assert W.whitened(spark.createDataFrame([], SCHEMA)).collect() == []


def test_eigen_solver_on_clusters():
    rng = np.random.default_rng(4)
    for values in ([5.0] * 4 + [1.0] * 20, [3, 3 - 1e-12, 3 - 2e-12, 2, 1e-3] + [1e-6] * 10, [1.0], [2.0, 2.0], np.linspace(1, 9, 64)):
        q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
        a = (q * np.array(values)) @ q.T
        a = (a + a.T) / 2
        e, v = W.leading(a, 16)
        k = min(16, len(values))
        assert np.allclose(e, sorted(values)[::-1][:k], rtol=1e-12, atol=1e-13)
        assert np.abs(v.T @ v - np.eye(k)).max() < 1e-12
        assert np.abs(a @ v - v * e).max() < 1e-12 * max(values)


def test_op13_on_the_table(spark, sf_dir):
    got = W.op13_whitening(spark, sf_dir).toPandas()
    assert got.groupby("vec_id").size().eq(16).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    assert (got.groupby("component")["explained"].first().diff().dropna() <= 0).all()
