import numpy as np
import pytest
from pyspark.sql import functions as F

from floeberg.operators import solve as V, sparse as M


def _ones(spark, n):
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))


def _mat(spark, a):
    return spark.createDataFrame([(i, j, float(a[i][j])) for i in range(len(a)) for j in range(len(a[0])) if a[i][j]], "i long, j long, v double")


def _dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_algebra_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-3, 4, (5, 4)), rng.integers(-3, 4, (4, 6))
    da, db = _mat(spark, a.tolist()), _mat(spark, b.tolist())
    assert (_dense(M.multiply(da, db), 5, 6) == a @ b).all()
    assert (_dense(M.block_multiply(da, db, 2), 5, 6) == a @ b).all()
    assert (_dense(M.add(da, M.scale(da, 2.0)), 5, 4) == 3 * a).all()
    assert (_dense(M.transpose(da), 4, 5) == a.T).all()
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "i long, x double")
    assert {r.i: r.y for r in M.spmv(da, x).collect()} == {i: v for i, v in enumerate(a @ np.arange(1, 5)) if a[i].any()}
    norms = M.matrix_norms(da).first()
    assert norms.frobenius == pytest.approx(np.linalg.norm(a)) and norms.infinity == np.abs(a).sum(1).max()


@pytest.mark.parametrize("n,nnz", [(3, 33), (4, 64)])
def test_laplacian(spark, n, nnz):
    a = M.laplace_5pt(spark, n)
    assert a.count() == nnz and M.asymmetric_entries(a).first()[0] == 0
    assert M.triangle(a, strict=True).count() == (nnz - n * n) // 2


def test_levels_and_triangular_solve(spark):
    a = M.laplace_5pt(spark, 3)
    assert [r["size"] for r in M.level_stats(M.level_sets(a)).orderBy("level").collect()] == [1, 2, 3, 2, 1]
    x = V.triangular_solve(M.triangle(a), _ones(spark, 9))
    assert tuple(x.agg(F.sum("x"), F.max_by("x", "i")).first()) == pytest.approx((3.271484375, 0.466796875))


def test_jacobi_residuals(spark):
    a, b = M.laplace_5pt(spark, 3), _ones(spark, 9)
    for k, want in ((1, 0.6871842709), (5, 0.1717960677)):
        assert V.relative_residual(a, V.jacobi(a, b, k), b).first()[0] == pytest.approx(want, abs=1e-9)


def test_block_gauss_seidel_has_the_same_fixed_point(spark):
    a, b = M.laplace_5pt(spark, 3), _ones(spark, 9)
    x = {r.i: r.x for r in V.block_gauss_seidel(a, b, 3, 25).collect()}
    want = np.linalg.solve(_dense(a, 9, 9), np.ones(9))
    assert [x[i] for i in range(9)] == pytest.approx(want.tolist(), abs=1e-3)


def test_conjugate_gradient(spark):
    d = spark.createDataFrame([(i, i, v) for i, v in enumerate((1000.0, 3.0, 3.0, 3.0, 7.0))], "i long, j long, v double")
    x = [r.x for r in V.conjugate_gradient(d, _ones(spark, 5), refresh=2).orderBy("i").collect()]
    assert x == pytest.approx([0.001, 1 / 3, 1 / 3, 1 / 3, 1 / 7], abs=1e-7)


def test_dense_factors():
    a = np.array([[2.0, -1, -2], [-4, 6, 3], [-4, -2, 8]])
    low, up = V.lu(a)
    assert low.tolist() == [[1, 0, 0], [-2, 1, 0], [-2, -1, 1]] and up.tolist() == [[2, -1, -2], [0, 4, -1], [0, 0, 3]]
    with pytest.raises(ZeroDivisionError):
        V.lu(np.array([[0.0, 1], [1, 0]]))
    s = a @ a.T
    r = V.cholesky(s)
    assert np.allclose(r.T @ r, s)
    x, steps = V.refine(s, s @ np.ones(3), np.float32, symmetric=True)
    assert np.allclose(x, 1, atol=1e-9) and steps < 50


def test_scalings(spark):
    a = _mat(spark, [[4, 2], [1, 8]])
    assert M.equilibrate(a).agg(F.max(F.abs("v"))).first()[0] == pytest.approx(1)
    s = M.equilibrate_symmetric(_mat(spark, [[4, 2], [2, 8]]), 6)
    assert [r.m for r in s.groupBy("i").agg(F.max(F.abs("v")).alias("m")).collect()] == pytest.approx([1, 1], abs=1e-3)
    starts = M.row_starts(a.where("i = 1"), spark.range(3).withColumnRenamed("id", "i"))
    assert [(r.i, r.start, r.nnz) for r in starts.orderBy("i").collect()] == [(0, 0, 0), (1, 0, 2), (2, 2, 0)]
    assert M.random_matrix(spark, 20, 4, "lower").where("i < j").count() == 0
