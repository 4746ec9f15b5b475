"""Solvers: sparse ones as driver loops over joins, small dense ones in one task.

Iterates are checkpointed every step.  Dense factorisations take a matrix that
fits one task and run per group, so many systems are solved in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.quire import exact_dots
from ..plans.iterate import cut, discard, new_folder
from .graph import Linked, few, link
from .sparse import inner_product, level_sets, spmv, spmv_exact, triangle


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x): b - A x."""
    ax = spmv(a, x)
    return b.join(ax, "i", "left").select("i", (F.col("x") - F.coalesce("y", F.lit(0.0))).alias("x"))


def relative_residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    r = residual(a, x, b).withColumnRenamed("x", "r").join(b, "i")
    return r.agg((F.sqrt(F.sum(F.col("r") ** 2)) / F.sqrt(F.sum(F.col("x") ** 2))).alias("res"))


def _by_column(a: DataFrame) -> Linked:
    """A laid out for a loop: each column's entries where the row of that number lies."""
    edges = a.select(F.col("j").alias("src"), F.col("i").alias("dst"), F.col("v").alias("w"))
    if hasattr(a, "_written"):
        edges._written = a._written
    return link(edges)


def _with_diagonal(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.select(F.col("i").alias("id"), F.col("x").alias("b")).join(a.where("i = j").select(F.col("i").alias("id"), F.col("v").alias("d")), "id")


def jacobi(a: DataFrame, b: DataFrame, iterations: int = 200) -> DataFrame:
    """x <- x + (b - A x) / d, all rows at once, from x = 0.  The entries of A stay where they lie."""
    a = a if hasattr(a, "_written") else cut(a)
    linked = _by_column(a)
    state, _ = linked.write(_with_diagonal(a, b).repartition(linked.buckets, "id").withColumn("x", F.lit(0.0)))
    for _ in range(iterations):
        ax, before = linked.inflow(state, "x"), state
        new = state.where("part = 0").join(few(ax), "id", "left")
        state, _ = linked.write(new.select("id", "b", "d", (F.col("x") + (F.col("b") - F.coalesce("_in", F.lit(0.0))) / F.col("d")).alias("x")))
        discard(before)
    return state.where("part = 0").select(F.col("id").alias("i"), "x")


def relax(a: DataFrame, b: DataFrame, bound: float = 1e-12, most: int = 10_000, trace: list | None = None) -> DataFrame:
    """(i, x) by residual-driven relaxation, from x = 0.

    A row whose correction r / d is over ``bound`` takes it and sends it to the rows of
    its column, which change their residuals; all others keep what they have, stale or not.
    Ends when no row has anything to send (or after ``most`` rounds), at the fixed point
    of Jacobi's iteration.  ``trace`` takes the number of rows that sent in each round."""
    a = a if hasattr(a, "_written") else cut(a)
    linked = _by_column(a)
    send = F.abs(F.col("r") / F.col("d")) > bound
    step = F.when(send, F.col("r") / F.col("d")).otherwise(0.0)
    count = {"sending": F.count_if(F.col("_once") & send)}
    state, seen = linked.write(_with_diagonal(a, b).repartition(linked.buckets, "id").select("id", "d", F.lit(0.0).alias("x"), F.col("b").alias("r")), **count)
    for _ in range(most):
        if trace is not None:
            trace.append(seen["sending"])
        if not seen["sending"]:
            break
        before = state
        change = linked.inflow(state.where(send).withColumn("dx", F.col("r") / F.col("d")), "dx")
        new = state.where("part = 0").join(few(change), "id", "left")
        state, seen = linked.write(new.select("id", "d", (F.col("x") + step).alias("x"), (F.col("r") - F.coalesce("_in", F.lit(0.0))).alias("r")), **count)
        discard(before)
    return state.where("part = 0").select(F.col("id").alias("i"), "x")


def block_gauss_seidel(a: DataFrame, b: DataFrame, block: int, iterations: int = 200) -> DataFrame:
    """Gauss-Seidel inside row blocks, Jacobi between them: the asynchronous
    solvers' fixed point, with every block's update one group of rows."""
    a = cut(a.withColumn("_b", F.floor(F.col("i") / block)))
    x = cut(b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("b")))
    own = F.floor(F.col("j") / block) == F.col("_b")

    def relax(part: pd.DataFrame) -> pd.DataFrame:
        value = dict(zip(part.i[part.kind == 0], part.v[part.kind == 0], strict=True))
        rhs = dict(zip(part.i[part.kind == 1], part.v[part.kind == 1], strict=True))
        rows: dict = {}
        for r in part[part.kind == 2].itertuples():
            rows.setdefault(r.i, []).append((r.j, r.v))
        for i in sorted(value):
            diag = sum(v for j, v in rows.get(i, []) if j == i)
            value[i] = (rhs[i] - sum(v * value[j] for j, v in rows.get(i, []) if j != i)) / diag
        return pd.DataFrame({"i": list(value), "x": list(value.values())})

    for _ in range(iterations):
        outer = a.where(~own).join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
        rhs = x.join(outer, "i", "left").select("i", "x", (F.col("b") - F.coalesce("y", F.lit(0.0))).alias("r"), "b")
        blk = F.floor(F.col("i") / block).alias("_b")
        zero = F.lit(0).cast("long").alias("j")
        rows = rhs.select(blk, "i", zero, F.col("x").alias("v"), F.lit(0).alias("kind")).unionByName(rhs.select(blk, "i", zero, F.col("r").alias("v"), F.lit(1).alias("kind")))
        rows = rows.unionByName(a.where(own).select("_b", "i", "j", "v", F.lit(2).alias("kind")))
        x = cut(rows.groupBy("_b").applyInPandas(relax, "i long, x double").join(x.select("i", "b"), "i"))
    return x.select("i", "x")


def triangular_solve(a: DataFrame, b: DataFrame, lower: bool = True) -> DataFrame:
    """x with A x = b, level by level: all rows of a level at once."""
    levels = cut(level_sets(a, lower))
    top = levels.agg(F.max("level")).first()[0]
    if top is None:
        return b.limit(0)
    a = cut(triangle(a, lower))
    spark, folder = a.sparkSession, new_folder(a.sparkSession)
    # Entries lie in a folder for each level, and each level's solution is added to
    # those before: a level reads its own entries only, and nothing is written twice.
    off = a.where("i <> j").join(levels, "i")
    off.write.partitionBy("level").parquet(f"{folder}/entries")
    kept = spark.read.schema(off.select("i", "j", "v", "level").schema).parquet(f"{folder}/entries")
    base = cut(b.withColumnRenamed("x", "b").join(a.where("i = j").select("i", F.col("v").alias("d")), "i").join(levels, "i"))
    found = base.select("i", F.lit(0.0).alias("x")).schema
    for k in range(top + 1):
        rows = base.where(F.col("level") == k)
        if k:
            x = spark.read.schema(found).parquet(f"{folder}/x")
            known = kept.where(F.col("level") == k).join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
            rows = rows.join(known, "i", "left")
        else:
            rows = rows.withColumn("y", F.lit(0.0))
        rows.select("i", ((F.col("b") - F.coalesce("y", F.lit(0.0))) / F.col("d")).alias("x")).write.mode("append").parquet(f"{folder}/x")
    return spark.read.schema(found).parquet(f"{folder}/x")


def conjugate_gradient(a: DataFrame, b: DataFrame, tolerance: float = 1e-5, most: int = 5000, refresh: int = 0, exact: bool = False, trace: list | None = None) -> DataFrame:
    """(i, x) for symmetric positive definite A; ``refresh``: recompute b - A x every so many steps.

    ``exact``: inner products and row sums are exact and rounded once.  ``trace``
    takes (step, residual norm) of every step."""
    times = spmv_exact if exact else spmv

    def product(df: DataFrame, u: str, v: str) -> float:
        if exact:
            got = exact_dots(df.select(F.lit(0).alias("_k"), u, F.col(v).alias("_v")), ["_k"], u, "_v").select("dot").first()
        else:
            got = df.agg(F.sum(F.col(u) * F.col(v))).first()
        return (got[0] if got else None) or 0.0

    a = cut(a)
    state = cut(b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.col("x").alias("p"), F.col("x").alias("b")))
    rr, passed = product(state, "r", "r"), state
    for k in range(most):
        if trace is not None:
            trace.append((k, math.sqrt(rr)))
        if math.sqrt(rr) <= tolerance:
            break
        ap = times(a, state.select("i", F.col("p").alias("x"))).withColumnRenamed("y", "ap")
        with_ap = cut(state.join(ap, "i", "left").fillna(0.0, ["ap"]))
        pap = product(with_ap, "p", "ap")
        step = rr / pap
        state = with_ap.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "p", "b")
        if refresh and (k + 1) % refresh == 0:
            fresh = residual(a, state.select("i", "x"), state.select("i", F.col("b").alias("x"))).withColumnRenamed("x", "r")
            state = state.drop("r").join(fresh, "i")
        new = product(state, "r", "r")
        state = cut(state.withColumn("p", F.col("r") + (new / rr) * F.col("p")))
        discard(with_ap, passed)
        rr, passed = new, state
    return state.select("i", "x")


# ------------------------------------------------- small dense systems, per group


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doolittle without pivoting: unit lower L and upper U."""
    n = len(a)
    low, up = np.eye(n, dtype=a.dtype), a.copy()
    for k in range(n - 1):
        if up[k, k] == 0:
            raise ZeroDivisionError(f"zero pivot in row {k}")
        low[k + 1 :, k] = up[k + 1 :, k] / up[k, k]
        up[k + 1 :] -= np.outer(low[k + 1 :, k], up[k])
    return low, np.triu(up)


def cholesky(a: np.ndarray) -> np.ndarray:
    """Upper R with A = R'R."""
    return np.linalg.cholesky(a).T


def determinant(a: np.ndarray) -> float:
    return float(np.linalg.det(a))


def solve_triangle(a: np.ndarray, b: np.ndarray, lower: bool) -> np.ndarray:
    x = np.zeros_like(b)
    for k in range(len(b)) if lower else range(len(b) - 1, -1, -1):
        x[k] = (b[k] - a[k] @ x) / a[k, k]
    return x


def refine(a: np.ndarray, b: np.ndarray, low=np.float32, high=np.float64, symmetric: bool = False, tolerance: float = 1e-12, most: int = 1000) -> tuple[np.ndarray, int]:
    """Factor in low precision, correct with residuals in high precision."""
    if symmetric:
        up = cholesky(a.astype(low))
        solve = lambda v: solve_triangle(up, solve_triangle(up.T, v.astype(low), True), False)
    else:
        lo, up = lu(a.astype(low))
        solve = lambda v: solve_triangle(up, solve_triangle(lo, v.astype(low), True), False)
    x, a, b = solve(b).astype(np.float64), a.astype(high), b.astype(high)
    size = np.abs(a).sum(1).max()
    for k in range(most):
        r = b - a @ x.astype(high)
        if np.abs(r).max() <= tolerance * (size * np.abs(x).max() + np.abs(b).max()):
            return x, k
        x = x + solve(r).astype(np.float64)
    return x, most


def _dense(part: pd.DataFrame) -> np.ndarray:
    n = int(max(part.i.max(), part.j.max())) + 1
    out = np.zeros((n, n))
    out[part.i, part.j] = part.v
    return out


def factor(systems: DataFrame, how: str = "lu") -> DataFrame:
    """(g, name, i, j, v): the factors of every group's matrix (g, i, j, v)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        a = _dense(part)
        named = {"lu": lambda: dict(zip("LU", lu(a), strict=True)), "cholesky": lambda: {"R": cholesky(a)}}[how]()
        rows = [(part.g.iloc[0], name, int(i), int(j), float(m[i, j])) for name, m in named.items() for i, j in zip(*np.nonzero(m), strict=True)]
        return pd.DataFrame(rows, columns=["g", "name", "i", "j", "v"])

    return systems.groupBy("g").applyInPandas(one, "g long, name string, i long, j long, v double")


def positive_definite(systems: DataFrame) -> DataFrame:
    """(g, spd): whether every group's matrix is symmetric with no negative pivot."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        a = _dense(part)
        try:
            good = bool((a == a.T).all() and (np.diag(lu(a)[1]) >= 0).all())
        except ZeroDivisionError:
            good = False
        return pd.DataFrame({"g": [part.g.iloc[0]], "spd": [good]})

    return systems.groupBy("g").applyInPandas(one, "g long, spd boolean")


def solve(systems: DataFrame, rhs: DataFrame, how: str = "lu", low: str = "float64", high: str = "float64") -> DataFrame:
    """(g, i, x, steps) for every group's A (g, i, j, v) and b (g, i, x).

    how: lu or cholesky; low and high: the numpy types of the factors and of the
    residuals (mixed and three-precision refinement when they differ)."""

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m, v = _dense(a), b.sort_values("i").x.to_numpy()
        x, steps = refine(m, v, np.dtype(low).type, np.dtype(high).type, how == "cholesky")
        return pd.DataFrame({"g": a.g.iloc[0], "i": np.arange(len(x)), "x": x, "steps": steps})

    return systems.groupBy("g").cogroup(rhs.groupBy("g")).applyInPandas(one, "g long, i long, x double, steps int")


def dot(x: DataFrame, y: DataFrame) -> float:
    return inner_product(x, y).first()[0]
