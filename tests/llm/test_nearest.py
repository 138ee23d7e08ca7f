"""One-bit codes: recall against brute force, ties, copies and vectors that take no part."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import rotated_codes


def nearest(df, **options):
    got = defaultdict(list)
    for r in sorted(rotated_codes.nearest(df, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return got


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.5) for i, v in rows], "vec_id long, embedding array<float>, score double")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 32))
    data = (centres[rng.integers(0, 6, 700)] + 0.4 * rng.normal(size=(700, 32))).astype(np.float32)
    data[300:380] = data[300]  # copies: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(1_000, None), (1_020, [0.0] * 32), (1_040, [float("nan")] + [1.0] * 31), (1_060, [None] + [1.0] * 31),
           (1_080, [1.0, 2.0]), (None, data[0].tolist()), (1_100, [float("inf")] * 32), (7, data[7].tolist())]
    got = nearest(vectors(spark, rows + odd))
    exact = data.astype(np.float64)
    hits = 0
    for q in range(0, 700, 20):
        distance = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(700), distance)) if i != q][:10]
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        found = [i for _, i, _ in got[q]]
        hits += len(set(found) & set(order))
        assert np.allclose([s for _, _, s in got[q]], distance[found], rtol=1e-12)
        assert [(s, i) for _, i, s in got[q]] == sorted((s, i) for _, i, s in got[q])
    assert hits >= 0.99 * 35 * 10 and set(got) == set(range(0, 700, 20))
    assert [i for _, i, _ in got[300]] == [i for i in range(301, 311)]


def test_few_and_no_vectors(spark):
    got = nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 0.0])]))
    assert [(i, s) for _, i, s in got[0]] == [(20, 0.0), (1, np.sqrt(2.0))]
    assert [i for _, i, _ in got[20]] == [0, 1]
    assert nearest(vectors(spark, [(0, [1.0, 0.0])])) == {}
    assert nearest(vectors(spark, [(1, [1.0])]).limit(0)) == {}


def test_bounds_hold_for_nearly_all():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(400, 64))
    turn = rotated_codes.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    import pyarrow as pa

    batch = lambda: pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(data.tolist())], names=["i", "v"])
    (codes,) = rotated_codes._codes(iter([batch()]), np.zeros(64), turn)
    (turned,) = rotated_codes._turned(iter([batch().slice(0, 20)]), np.zeros(64), turn)
    row = {"entries": codes.column(0), "bits": codes.column(1), "length": codes.column(2), "own": codes.column(3), "queries": turned.column(0), "turned": turned.column(1)}
    met = pa.RecordBatch.from_arrays([pa.array([c.to_pylist()]) for c in row.values()], names=list(row))
    (out,) = rotated_codes._bounds(iter([met]), 64, 399, 3.0)
    squares = ((data[np.asarray(out.column("query_id"))] - data[np.asarray(out.column("entry"))]) ** 2).sum(1)
    inside = (squares >= np.asarray(out.column("lower"))) & (squares <= np.asarray(out.column("upper")))
    assert len(squares) == 20 * 400 and inside.mean() > 0.99
