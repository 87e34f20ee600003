import numpy as np
from pyspark.sql import functions as F

from pairworks.llm import blocks, exact_topk, one_bit_index

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block int"


def rows(n, d, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    v = centres[rng.integers(0, 8, n)] + 0.6 * rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4")


def awkward(v):
    out = [(i, [float(x) for x in row], 1, 0.0, 0) for i, row in enumerate(v)]
    d = v.shape[1]
    out += [(1000, None, 1, 0.0, 0), (1050, [float("nan")] * d, 1, 0.0, 0), (1100, [1.0] * (d - 1) + [None], 1, 0.0, 0), (1150, [], 1, 0.0, 0),
            (1200, [1.0] * (d + 1), 1, 0.0, 0), (1250, [float("inf")] + [0.0] * (d - 1), 1, 0.0, 0), (None, [1.0] * d, 1, 0.0, 0)]
    # Ties and repeated rows.
    return out + [(2000, [float(x) for x in v[0]], 1, 0.0, 0), (2001, [float(x) for x in v[0]], 1, 0.0, 0), (2001, [float(x) for x in v[0]], 1, 0.0, 0)]


def brute(entries, is_query, k):
    out = []
    for q, v in entries:
        if is_query(q):
            found = sorted((-float(np.dot(w, v)), i) for i, w in entries if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_exact_top_k_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", ((), 70, 3))
    v = rows(300, 20)
    table = spark.createDataFrame(awkward(v), SCHEMA)
    got = sorted(map(tuple, exact_topk.top_k(table, F.col("vec_id") % 50 == 0).collect()))
    entries = [(r[0], np.floor(256 * np.array(r[1], float))) for r in awkward(v)
               if r[0] is not None and r[1] and len(r[1]) == 20 and all(x is not None and np.isfinite(x) for x in r[1])]
    assert got == brute(entries, lambda i: i % 50 == 0, 5)


def test_exact_top_k_with_large_numbers_few_rows_and_none(spark):
    big = [(0, [3e9, -1.0], 1, 0.0, 0), (1, [3e9, 2.0], 1, 0.0, 0), (2, [0.0, 0.0], 1, 0.0, 0)]
    got = sorted(map(tuple, exact_topk.top_k(spark.createDataFrame(big, SCHEMA), F.col("vec_id") == 0).collect()))
    x = [int(np.floor(256 * float(np.float32(3e9)))), -256]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2)] and got[1][3] == 0 and got[0][3] == min(x[0] * x[0] - 256 * 512, (1 << 63) - 1)
    assert exact_topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_index_finds_nine_of_ten_and_scores_exactly(spark):
    v = rows(1500, 32, 5)
    table = spark.createDataFrame(awkward(v) + [(3000, [0.0] * 32, 1, 0.0, 0)], SCHEMA)
    got = [tuple(r) for r in one_bit_index.nearest(table, F.col("vec_id") % 20 == 0).collect()]
    entries = [(r[0], np.array(r[1], float)) for r in awkward(v)
               if r[0] is not None and r[1] and len(r[1]) == 32 and all(x is not None and np.isfinite(x) for x in r[1])]
    want = brute(entries, lambda i: i % 20 == 0, 20)
    vector = dict(entries)
    assert all(abs(s - float(vector[q] @ vector[i])) < 1e-12 for q, _, i, s in got)
    assert len(got) == len(want) and len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len({(q, i) for q, _, i, _ in want})
    assert one_bit_index.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_rotation_is_orthogonal_and_the_same_each_time():
    m = one_bit_index.rotation(16)
    np.testing.assert_allclose(m @ m.T, np.eye(16), atol=1e-12)
    assert (m == one_bit_index.rotation(16)).all()
