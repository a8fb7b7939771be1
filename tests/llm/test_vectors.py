"""Hard negatives and whitening against brute force."""

from fractions import Fraction

import numpy as np
import pytest

from braidflow.llm import hard_negatives, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, id string, list int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "i", 7) for r in rows], VECTORS)


def some(seed, n, dim, labels=3, hot=0):
    """Rows with repeated vectors, unusable ones and, if asked, many copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dim))
    rows = []
    for i in range(n):
        v = (centres[rng.integers(4)] + rng.normal(0, 0.4, dim)).astype(np.float32).tolist()
        if i < hot:
            v = centres[0].astype(np.float32).tolist()
        rows.append((i, v, int(rng.integers(labels))))
    rows[3] = (3, None, 1)
    rows[5] = (5, [*rows[5][1][:-1], float("nan")], 1)
    rows[6] = (6, [*rows[6][1][:-1], None], 1)
    rows[8] = (8, [*rows[8][1][:-1], float("inf")], 1)
    rows[9] = (9, rows[9][1], None)
    return rows


def usable(rows):
    return [(i, np.array(v, np.float64), y) for i, v, y in rows if v is not None and None not in v and np.isfinite(v).all()]


# ---------------------------------------------------------------- integers


@pytest.mark.parametrize("most", [3, 1 << 20, (1 << 20) - 1, 1 << 21, 1 << 41, 1 << 51])
def test_limbs_and_products_are_exact(most):
    rng = np.random.default_rng(most % 97)
    x = rng.integers(-most, most, (50, 7), endpoint=True)
    x[0], x[1] = most, -most
    parts = vectors.limbs(x, vectors.limb_count(most))
    assert all(np.abs(p).max() <= 1 << 20 for p in parts)
    whole = sum(p.astype(object).astype(int).astype(object) << (21 * k) for k, p in enumerate(parts))
    assert (whole == x).all()
    gram = vectors.Gram(7, most)
    gram.add(x)
    gram.add(x[:3])
    want = x.astype(object).T @ x.astype(object) + x[:3].astype(object).T @ x[:3].astype(object)
    got = [sum(vectors.Gram.whole(p, int(gram.low[p, k]), int(gram.high[p, k])) for p in range(len(gram.low))) for k in range(28)]
    assert got == want[np.triu_indices(7)].tolist()
    if most < 1 << 29:
        assert (vectors.exact_products(x, x, most) == x @ x.T).all()


def test_products_that_do_not_fit_are_an_error():
    x = np.full((1, 4), 1 << 31)
    with pytest.raises(OverflowError):
        vectors.exact_products(x, x, 1 << 31)


# ---------------------------------------------------------------- hard negatives


def mined(rows, every, positives=5, negatives=10):
    rows = [(i, np.floor(256 * v).astype(np.int64), y) for i, v, y in usable(rows) if y is not None]
    out = []
    for a, q, label in rows:
        if a % every:
            continue
        scored = sorted((-int(q @ v), i, y) for i, v, y in rows if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(n, i) for n, i, y in scored if y != label and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(a, pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(hard)]
    return sorted(out)


def found(df, every):
    from pyspark.sql import functions as F

    return sorted(map(tuple, hard_negatives.mine(hard_negatives.embeddings(df, F.col("vec_id") % every == 0)).collect()))


@pytest.mark.parametrize("seed,waves,scale", [(1, False, 1), (2, True, 1), (3, True, 3000)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, seed, waves, scale):
    """In one wave and in two, in few large blocks and in many small ones, and where products
    need float64."""
    if waves:
        for name, value in (("SEGMENT_ROWS", 30), ("BLOCK_ROWS", 8), ("PACK_ROWS", 5), ("ANCHOR_ROWS", 40), ("WAVES_FROM", 4)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c * scale)) for c in v], y) for i, v, y in some(seed, 400, 6, hot=130 if waves else 0)]
    got = found(table(spark, rows), 3)
    assert got == mined(rows, 3)
    assert len(got) > 500


def test_scores_beyond_doubles(spark):
    rows = [(i, [float((i * 37 % 11 - 5) * 2**20), float((i * 53 % 13 - 6) * 2**20 + i)], i % 2) for i in range(40)]
    assert found(table(spark, rows), 2) == mined(rows, 2)


def test_few_rows_none_and_repeated_ones(spark):
    rows = some(4, 30, 5)
    assert found(table(spark, rows[:1]), 1) == []
    assert found(table(spark, []), 1) == []
    assert found(table(spark, rows).where("label = 1"), 1) == []
    twice = found(table(spark, rows[10:20] + rows[10:11]), 100)
    assert twice == [] and found(table(spark, [(None, [1.0], 1), (0, [1.0], 1), (2, [0.5], 2), (4, [1.0], 1)]), 100) == [(0, 4, 1, 2, 65536, 32768)]
    # Ties by id; an anchor that stands twice is asked twice; its copy is no positive of it.
    tied = [(0, [1.0], 1), (0, [1.0], 1), (7, [1.0], 1), (5, [0.5], 2), (3, [0.5], 2)]
    assert found(table(spark, tied), 100) == sorted([(0, 7, 1, 3, 65536, 32768), (0, 7, 2, 5, 65536, 32768)] * 2)


def test_bounds_let_blocks_be_skipped():
    """Blocks out of a window, or below the kth score, are never multiplied."""
    shape = hard_negatives.Shape(300, 1, 2, 300)
    segment = hard_negatives.Segment(shape, np.array([[200.0, 0.0], [0.0, 200.0], [-200.0, 0.0]]))
    rng = np.random.default_rng(0)
    for k, c in enumerate(segment.centroids):
        m = (c + rng.integers(-3, 4, (100, 2))).astype(np.int16)
        segment.hold(k, float(np.linalg.norm(m - c, axis=1).max()), np.arange(k * 100, k * 100 + 100).tobytes(), np.full(100, k).tobytes(), m.tobytes())
    calls = []
    inner = segment._scores
    segment._scores = lambda q, m, bound: calls.append(len(m)) or inner(q, m, bound)
    one = lambda v: np.array([[v]], np.int64)
    best = segment.search(np.array([900]), np.array([9]), np.array([[200, 0]], np.int16), False, one(-(1 << 60)), one(1 << 60), one(-(1 << 60)), 5)
    assert len(calls) == 1 and (best.ids < 100).all()
    calls.clear()
    best = segment.search(np.array([900]), np.array([9]), np.array([[200, 0]], np.int16), False, one(-3000), one(3000), one(-(1 << 60)), 5)
    assert len(calls) == 1 and ((best.ids >= 100) & (best.ids < 200)).all()


# ---------------------------------------------------------------- whitening


def exact_covariance(x):
    n, x = len(x), x.astype(object)
    mean = [Fraction(int(s), n) for s in x.sum(axis=0)]
    y = [[Fraction(int(v)) - m for v, m in zip(row, mean)] for row in x]
    d = x.shape[1]
    return np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])


@pytest.mark.parametrize("scale", [1, 1e5])
def test_whitened_rows(spark, scale):
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c * scale)) for c in v], y) for i, v, y in some(7, 150, 10)]
    rows[20] = (None, rows[20][1], 1)
    rows.append(rows[30])
    got = whitening.whiten(table(spark, rows).repartition(3))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.array([np.floor(1024 * v) + 100_000 for _, v, _ in usable(rows)]).astype(np.int64)
    ids = [i for i, _, _ in usable(rows)]
    n = len(x)
    v = exact_covariance(x)
    e, c = np.linalg.eigh(v)
    e, c = e[::-1], c[:, ::-1]
    want = (x - x.mean(axis=0)) @ c[:, :8] / np.sqrt(e[:8])
    y = n * x.astype(object) - x.astype(object).sum(axis=0)
    deviation = (y * y).sum(axis=1)
    out = got.collect()
    assert len(out) == 8 * n
    by_id = {}
    for r in out:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(8):
        sign = None
        for i, w, dev in zip(ids, want[:, k], deviation):
            r = by_id[i, k + 1][0]
            assert len(by_id[i, k + 1]) == ids.count(i) and r.n == n
            assert r.deviation == (int(dev) if dev < 1 << 63 else None)
            sign = sign or np.sign(r.whitened * w)
            assert abs(r.whitened - sign * w) < 1e-8
            assert abs(r.explained - e[k] / np.trace(v)) < 1e-12
            assert r.identity_error < 1e-9


def test_covariance_is_rounded_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 4) + 5e4).tolist(), 0) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = whitening.integers(df)
    n, sums, most = whitening.totals(x)
    assert (whitening.covariance(x, n, sums, most) == exact_covariance(np.array([np.floor(1024 * np.array(v)) + 100_000 for _, v, _ in rows]).astype(np.int64))).all()


def test_whitening_of_few_rows_and_none(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None, 1), (2, [float("nan")], 1)])).collect() == []
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    short = whitening.whiten(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [0.0, 0.0], 1)])).collect()
    assert len(short) == 6 and {r.n for r in short} == {3}
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [1e30], 1)]))
    with pytest.raises(ValueError):
        found(table(spark, [(0, [-1e30], 1), (1, [1.0], 1)]), 1)
