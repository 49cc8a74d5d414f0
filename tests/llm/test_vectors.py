"""The vector operators against plain numpy: awkward rows, copies, near copies, small tiles and blocks."""

import hashlib
import math

import numpy as np
import pytest

from bibloom.llm import hadamard_clusters, pca_tiles, segment_negatives, vectors

from .. import conftest

NAMES = "id label2 v row fit h1 h2 node n d tile lead pair side rid x stored anchor p q w found score cell component least".split()
SCHEMA = "vec_id long, embedding array<float>, label int"


def awkward(seed=1, n=260, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(4, d)) / 8
    for i in range(n):
        kind = i % 5
        v = rng.normal(size=d) / 8 if kind < 2 else centres[i % 4] + rng.normal(size=d) * (0.004 if kind < 4 else 0.016)
        rows.append((i, [float(x) for x in np.float32(v)], i % 3))
    some = rows[7][1]
    rows += [(300 + i, some, 1) for i in range(40)]  # a hot copy
    rows += [(400 + i, [x * 3 for x in rows[2][1]], 2) for i in range(3)]  # the same direction
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * d, 1), (503, [float("nan")] * d, 1), (504, [float("inf")] + [0.0] * (d - 1), 1), (505, [None] * d, 1)]
    rows += [(506, some, None), (507, [1.0, 2.0, 3.0], 1), (508, [2.0, 4.0, 6.0], 1), (509, [-0.0] + [1.0] * (d - 1), 0), (510, [0.0] + [1.0] * (d - 1), 0)]
    rows += [(None, some, 1), (None, rows[0][1], 0), (3, rows[3][1], 0), (3, rows[3][1], 0), (50, rows[50][1], 2), (350, some, 1)]
    return rows


def frame(spark, rows, names=NAMES):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("vec_id", *[F.lit(n).alias(n) for n in names], "embedding", "label")


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_components(rows, t=0.98):
    n = len(rows)
    fit = [good(v) and lab is not None and any(x != 0 for x in v) for _, v, lab in rows]
    unit = [np.float64(v) / np.linalg.norm(np.float64(v)) if f else None for (_, v, _), f in zip(rows, fit)]
    peers = [[j for j in range(n) if j != i and fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in peers[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(peers[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


@pytest.mark.parametrize("tile", [16, 2048])
def test_components_of_awkward_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(pca_tiles, "TILE", tile)
    rows = awkward()
    got = [tuple(r) for r in pca_tiles.vector_components(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain_components(rows), key=str)
    assert max(r[1] for r in got) > 40


def test_deduplicate_keeps_rows_with_their_columns(spark):
    rows = awkward()
    df = frame(spark, rows)
    got = pca_tiles.deduplicate(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert all(r[n] == n for r in kept for n in NAMES)
    fit = [good(v) and lab is not None and any(v) for _, v, lab in rows]
    want = [r[0] for r, f in zip(plain_components(rows), fit) if not f] + sorted({r[2] for r, f in zip(plain_components(rows), fit) if f})
    assert sorted(r["vec_id"] for r in kept if r["vec_id"] is not None) == sorted(want)


def test_pruning_loses_no_pair_and_compares_few():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 64))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 64)) * 0.2])
    u = vectors.unit(x)
    axes = {64: np.linalg.eigh(u.T @ u)[1][:, ::-1]}
    for own in (axes, {}):
        found = {(i, j) for a, b in pca_tiles.pairs_of(x, x, own, 0.97) for i, j in zip(a, b)}
        assert found == set(zip(*np.nonzero(u @ u.T >= 0.97)))
    short = x[:, :5]  # fewer dimensions than the first checkpoint
    us = vectors.unit(short)
    assert {(i, j) for a, b in pca_tiles.pairs_of(short, short, {}, 0.97) for i, j in zip(a, b)} == set(zip(*np.nonzero(us @ us.T >= 0.97)))


def test_vector_operators_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    for module in (pca_tiles, hadamard_clusters, segment_negatives):
        assert module.query(spark, str(tmp_path)).collect() == []


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if good(v) and len(v) == 64]
    key = lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            group = [v for (_, v), o in zip(kept, own) if o == n]
            if group:
                centroids[n] = [sum(c) // len(group) for c in zip(*group)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    by = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    return [(i, n, d, by[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found]


def test_clusters_of_awkward_vectors(spark):
    rows = awkward()
    got = [tuple(r) for r in hadamard_clusters.clusters(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain_clusters(rows), key=str)
    few = rows[:5]
    assert sorted(map(tuple, hadamard_clusters.clusters(frame(spark, few)).collect())) == sorted(plain_clusters(few))
    large = [(i, [x * 5000 for x in v], lab) for i, v, lab in rows[:60]]  # beyond what doubles sum exactly
    assert sorted(map(tuple, hadamard_clusters.clusters(frame(spark, large)).collect())) == sorted(plain_clusters(large))


def test_progressive_search_is_exact_with_ties_and_any_length():
    rng = np.random.default_rng(5)
    for d in (1, 5, 64, 100):
        x, c = rng.integers(-40, 40, (400, d)), rng.integers(-40, 40, (9, d))
        c[6] = c[2]
        x[:9] = c
        want = ((x[:, None] - c) ** 2).sum(axis=2)
        number, distance = hadamard_clusters.nearest(x, c)
        assert (number == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    with pytest.raises(ArithmeticError):
        hadamard_clusters.whole(np.full((1, 64), 1e9), 1024)
    h = hadamard_clusters.walsh(64)
    assert (h.T @ h == 64 * np.eye(64)).all() and [int((np.diff(h[:, k]) != 0).sum()) for k in range(64)] == list(range(64))


def plain_negatives(rows):
    v = []
    for i, e, lab in rows:
        if lab is not None and good(e):
            moved = (lab + 1) % 10 if i is not None and i % 7 == 0 else lab
            v.append((i, [math.floor(256 * float(np.float32(x))) for x in e], moved))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, x, lab) in enumerate(v):
        if i is None or i % 50:
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), j, m, b) for b, (j, y, m) in enumerate(v) if b != a and len(y) == len(x)]
        scores.sort(key=lambda s: (-s[0], last(s[1])))
        for ps, p, _, _ in [s for s in scores if s[2] == lab][:5]:
            fits = [s for s in scores if s[2] != lab and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(i, p, r + 1, s[1], ps, s[0]) for r, s in enumerate(fits)]
    return out


@pytest.mark.parametrize("size", [16, 4096])
def test_negatives_of_awkward_vectors(spark, monkeypatch, tmp_path, size):
    monkeypatch.setattr(segment_negatives, "ROWS", size)
    monkeypatch.setattr(segment_negatives, "ANCHORS", max(4, size // 4))
    rows = awkward()
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in segment_negatives.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain_negatives(rows), key=str) and len(got) > 20


def test_negatives_of_large_numbers_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-(2**40), 2**40, 6)], i % 2) for i in range(60)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large|overflow|Overflow"):
        segment_negatives.mine(df, F.col("vec_id") % 50 == 0, scale=256).collect()
    small = [(i, [float(x) for x in rng.integers(-(2**27), 2**27, 6)], i % 2) for i in range(60)]
    got = segment_negatives.mine(spark.createDataFrame(small, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, scale=1)
    x = {i: [int(c) for c in v] for i, v, _ in small}
    score = lambda i: sum(a * b for a, b in zip(x[0], x[i]))
    assert all(r["negative_score"] == score(r["negative_id"]) and r["positive_score"] == score(r["positive_id"]) for r in got.collect())


def test_segment_bounds_hold_at_every_level():
    rng = np.random.default_rng(2)
    for d in (0, 3, 16, 64, 100):
        x, y = rng.integers(-99, 99, (50, d)).astype(float), rng.integers(-99, 99, (60, d)).astype(float)
        exact, width = x @ y.T, None
        for (ma, sa), (mb, sb) in zip(segment_negatives.levels(segment_negatives.summary(x), d), segment_negatives.levels(segment_negatives.summary(y), d)):
            mid, dev = ma @ mb.T, sa @ sb.T
            assert (exact <= mid + dev + 1e-6).all() and (exact >= mid - dev - 1e-6).all()
            assert width is None or dev.sum() <= width + 1e-6
            width = dev.sum()


def test_given_vectors_against_plain_python(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in vectors.embeddings(spark, conftest.SF).collect()]
    assert sorted(map(tuple, pca_tiles.query(spark, conftest.SF).collect())) == sorted(plain_components(rows))
    assert sorted(map(tuple, hadamard_clusters.query(spark, conftest.SF).collect())) == sorted(plain_clusters(rows))
    assert sorted(map(tuple, segment_negatives.query(spark, conftest.SF).collect())) == sorted(plain_negatives(rows))
