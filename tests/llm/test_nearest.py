import numpy as np
import pytest
from llm_rows import SF

from lexaspark.llm import nearest


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string")


def brute(queries, rows, k):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in usable if i in queries}:
        near = {(float(np.sqrt(((np.array(x) - v) ** 2).sum())), i) for i, v in usable if i != q and len(v) == len(x)}
        out += [(q, r + 1, i, pytest.approx(d, rel=1e-12)) for r, (d, i) in enumerate(sorted(near)[:k])]
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e15])
def test_against_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12).astype(np.float32) * scale).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # copies: ties go to the smaller id
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [float("nan")] * 12), (2004, [None] + [1.0] * 11), (2005, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (2006, [1.0, 2.0]), rows[5], rows[5]]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = vectors(spark, rows)
    got = nearest.nearest(df.where("vec_id % 50 = 0"), df, 5).collect()
    asked = {i for i, _ in rows if i is not None and i % 50 == 0}
    assert sorted(map(tuple, got)) == brute(asked, rows, 5)


def test_few_and_none(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [tuple(r)[:3] for r in nearest.nearest(df.where("vec_id = 0"), df).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest.nearest(vectors(spark, []), df).count() == nearest.nearest(df, vectors(spark, [])).count() == 0


def test_the_bounds_spare_exact_work():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 32))
    block = lambda v, at: (np.arange(len(v)) + at, np.arange(len(v)) + at, *nearest.coded(v))
    cell = nearest.Cell(10)
    for at in range(0, 2000, 500):
        cell.add(block(x[:50], 10_000), block(x[at : at + 500], at))
    left = [b for b in cell.left()]
    pairs = {(q, c) for b in left for q, c in zip(b["q_row"].to_pylist(), b["c_row"].to_pylist())}
    assert 500 <= len(pairs) < 0.05 * 50 * 2000
    near, far = nearest.bounds(block(x[:50], 10_000), block(x, 0))
    true = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(axis=2))
    assert (near <= true).all() and (true <= far).all()
    for q in range(50):
        assert all((10_000 + q, c) in pairs for c in np.argsort(true[q], kind="stable")[:10])


def test_many_copies_and_small_blocks(spark, monkeypatch):
    """Ties over many blocks and cells: one vector under many ids, and equal rows of one id."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(120)] + [(500, [1.0, 2.0, 3.5])] * 60 + [(600 + i, rng.integers(0, 3, 3).astype(float).tolist()) for i in range(80)]
    df = vectors(spark, rows)
    got = nearest.nearest(df.where("vec_id % 20 = 0"), df, 7).collect()
    assert sorted(map(tuple, got)) == brute({i for i, _ in rows if i % 20 == 0}, rows, 7)


def test_wide_vectors_stay_exact():
    a = np.full((2, 3000), 127, np.int8)
    assert (nearest._product(a, a) == 3000 * 127 * 127).all()


def test_sf(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = nearest.op1_nearest_neighbours(spark, SF).collect()
    assert sorted(map(tuple, got)) == brute({i for i, _ in rows if i % 100 == 0}, rows, 10)
