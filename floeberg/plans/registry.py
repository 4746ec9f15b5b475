"""Registered queries of the graph, matrix, number-format and signal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import posit as P, signal as S
from ..functions.quire import exact_sums as exact_sums_of
from ..operators import communities as C, graph as G, infomap as I, solve as V, sparse as M
from ..plans.iterate import bucketed, cut
from ..streaming import queues as Q
from .tables import EDGES, PARTS, TWO_WAY, by_tens, counts, entries, flow, flow_sql, laplace_sql, quantities, rank_sql, ranked, raw_edges, table, two_way

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r(c, digits: int):
    """Rounded, and never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# -------------------------------------------------------------- counts and matrices


@query("SELECT l_partkey AS bin, count(*) AS cnt FROM lineitem GROUP BY 1")
def histogram_partkey(spark, sf):
    return M.histogram(table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT p_partkey AS bin, count(l_partkey) AS cnt FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def histogram_zero_filled(spark, sf):
    return M.histogram(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").select(F.col("p_partkey").alias("bin")))


@query("SELECT l_suppkey AS i, round(sum(l_quantity * p_retailprice), 2) + 0.0 AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def spmv(spark, sf):
    mat = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return M.spmv(mat, table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))).select("i", r("y", 2).alias("y"))


@query("SELECT l_partkey AS i, round(sum(l_quantity * s_acctbal), 2) + 0.0 AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def spmv_transpose(spark, sf):
    mat = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return M.spmv_transpose(mat, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))).select("i", r("y", 2).alias("y"))


_COUNTS = "c AS MATERIALIZED (SELECT l_suppkey AS i, l_partkey AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"
_QTY = "q AS MATERIALIZED (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_COUNTS} SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.j GROUP BY 1, 2")
def matmul_coo(spark, sf):
    return M.gram(entries(spark, sf, F.lit(1.0)))


@query(f"WITH {_COUNTS} SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.j GROUP BY 1, 2")
def matmul_blocked(spark, sf):
    return M.block_gram(entries(spark, sf, F.lit(1.0)), 256)


@query(f"WITH {_COUNTS} SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM c UNION ALL SELECT j, i, v FROM c) GROUP BY 1, 2")
def transpose_sum(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.lit(1.0).alias("v"))
    c = cut(M.spread(li, li.count()).groupBy("i", "j").agg(F.sum("v").alias("v")))
    return M.add(c, M.transpose(c), 2 * c.count())


@query(f"WITH {_COUNTS}, {_QTY} SELECT i, j, sum(v) AS v FROM (SELECT * FROM c UNION ALL SELECT i, j, v * 2 FROM q) GROUP BY 1, 2")
def mat_add(spark, sf):
    return M.add(counts(spark, sf), M.scale(quantities(spark, sf), 2.0))


@query(f"WITH {_QTY} SELECT round(sqrt(sum(s)), 6) + 0.0 AS frobenius, max(r) AS infinity FROM (SELECT i, sum(v * v) AS s, sum(abs(v)) AS r FROM q GROUP BY i)")
def mat_norms(spark, sf):
    return M.matrix_norms(quantities(spark, sf)).select(r("frobenius", 6).alias("frobenius"), "infinity")


@query("SELECT round(sqrt(sum(s_acctbal * s_acctbal)), 6) + 0.0 AS two, round(sum(abs(s_acctbal)), 4) + 0.0 AS one, max(abs(s_acctbal)) AS inf FROM supplier")
def vector_norms(spark, sf):
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    return M.vector_norms(x).select(r("two", 6).alias("two"), r("one", 4).alias("one"), "inf")


@query(f"WITH {_COUNTS} SELECT count(*) AS n FROM c a FULL JOIN c b ON a.i = b.j AND a.j = b.i WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)")
def is_symmetric(spark, sf):
    return M.asymmetric_entries(counts(spark, sf))


@query(f"WITH {_QTY} SELECT max(CASE WHEN i > j THEN 1 ELSE 0 END) = 0 AS upper, max(CASE WHEN i < j THEN 1 ELSE 0 END) = 0 AS lower FROM q WHERE v <> 0")
def shape_flags(spark, sf):
    return M.shape_flags(quantities(spark, sf))


@query(f"WITH {_QTY} SELECT min(v) AS least, max(v) AS greatest FROM q")
def extreme_entries(spark, sf):
    return M.extreme_entries(quantities(spark, sf))


@query(f"WITH {_QTY}, a AS (SELECT i, j, v / max(abs(v)) OVER (PARTITION BY i) AS v FROM q) SELECT i, j, round(v / max(abs(v)) OVER (PARTITION BY j), 9) + 0.0 AS v FROM a")
def row_equilibrate(spark, sf):
    return M.equilibrate(quantities(spark, sf)).select("i", "j", r("v", 9).alias("v"))


@query(f"WITH {_QTY} SELECT i, j, v / pow(2.0, round(log2((SELECT avg(v) FROM (SELECT v FROM q WHERE i = j))))) AS v FROM q")
def diag_scale(spark, sf):
    return M.scale_by_diagonal(quantities(spark, sf), "mean")


@query(f"WITH {_QTY} SELECT i - 2 AS i, j - 20 AS j, v FROM q WHERE i BETWEEN 2 AND 59 AND j BETWEEN 20 AND 219")
def sub_matrix(spark, sf):
    return M.rectangle(quantities(spark, sf), 2, 59, 20, 219)


@query("SELECT s_suppkey AS i, CAST(sum(nnz) OVER (ORDER BY s_suppkey) - nnz AS BIGINT) AS start, nnz FROM (SELECT s_suppkey, count(l_suppkey) AS nnz FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)")
def csr_offsets(spark, sf):
    mat = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"))
    return M.row_starts(mat, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i")))


@query("SELECT o_orderkey AS key, o_orderkey % 16 AS part, o_orderkey // 16 AS local FROM orders")
def round_robin_partition(spark, sf):
    return M.round_robin(table(spark, sf, "orders"), "o_orderkey", 16)


# ------------------------------------------------------------------------- graphs


@query("SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2")
def edge_dedup(spark, sf):
    return G.combine_edges(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w")))


@query("""WITH p AS (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey * 10 + l_linenumber AS line FROM lineitem)
SELECT src, dst, 1.0::DOUBLE AS w FROM p QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY line, src, dst) = 1""")
def undirected_dedup(spark, sf):
    li = table(spark, sf, "lineitem")
    return G.undirected_first_seen(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")))


@query("SELECT o_custkey AS old_id, row_number() OVER (ORDER BY o_custkey) - 1 AS new_id FROM (SELECT DISTINCT o_custkey FROM orders)")
def dense_renumber(spark, sf):
    return G.renumber(table(spark, sf, "orders"), "o_custkey")


@query(f"WITH {TWO_WAY} SELECT DISTINCT dst AS id FROM e1 WHERE dst NOT IN (SELECT src FROM e1)")
def dangling_nodes(spark, sf):
    e = two_way(spark, sf)
    return G.dangling(G.vertices(e), e)


@query(f"WITH {EDGES} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 12) + 0.0 AS w FROM e0")
def normalize_out_weights(spark, sf):
    return G.normalise(raw_edges(spark, sf)).select("src", "dst", r("w", 12).alias("w"))


@query("WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 1.0 END AS w FROM customer) SELECT id, round(w / (SELECT sum(w) FROM c) * 1e6, 6) + 0.0 AS tau FROM c")
def teleport_weights(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("node_weight"))
    return G.teleport_weights(c).select("id", r(F.col("tau") * 1e6, 6).alias("tau"))


@query(f"WITH {rank_sql(10, False)} SELECT id, round(p * 1e6, 6) + 0.0 AS p FROM p")
def pagerank_10(spark, sf):
    return ranked(spark, sf, 10, both=False)[0].select("id", r(F.col("p") * 1e6, 6).alias("p"))


@query(f"WITH {flow_sql()} SELECT src, dst, round(f * 1e6, 6) + 0.0 AS f FROM f")
def edge_flow(spark, sf):
    return flow(spark, sf).flows.select("src", "dst", r(F.col("f") * 1e6, 6).alias("f"))


@query(f"WITH {flow_sql()} SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 9) + 0.0 AS h FROM p")
def node_entropy(spark, sf):
    return G.node_entropy(flow(spark, sf).nodes).select(r("h", 9).alias("h"))


_PLOGP = "CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END"


def _pl(x: str) -> str:
    return _PLOGP.format(x)


@query(f"""WITH {flow_sql()}, s AS (SELECT sum(ex) AS q, sum({_pl("ex")}) AS a, sum({_pl("ex + p")}) AS b FROM m)
SELECT round(({_pl("q")} - 2 * a + b - (SELECT sum({_pl("p")}) FROM p)) / ln(2), 9) + 0.0 AS code_length FROM s""")
def code_length_fixed(spark, sf):
    fl = flow(spark, sf)
    return G.code_length(fl, by_tens(fl.nodes)).select(r("code_length", 9).alias("code_length"))


@query(f"WITH {flow_sql()} SELECT mod, round(ex, 9) + 0.0 AS exit, round(ex + p, 9) + 0.0 AS stay FROM m")
def module_exit(spark, sf):
    fl = flow(spark, sf)
    return G.modules(fl, by_tens(fl.nodes)).select("mod", r("exit", 9).alias("exit"), r("stay", 9).alias("stay"))


@query(f"""WITH {flow_sql()},
 sx AS MATERIALIZED (SELECT id, 0.15 * (1 - tau) * p + 0.85 * (coalesce(o, 0) + (1 - tau) * d) AS q FROM fn LEFT JOIN (SELECT src, sum(f) AS o FROM f WHERE src <> dst GROUP BY src) ON src = id),
 lk AS MATERIALIZED (SELECT id, mod, sum(fo) AS fo, sum(fi) AS fi FROM (SELECT src AS id, m2 AS mod, f AS fo, 0 AS fi FROM f UNION ALL SELECT dst, m1, 0, f FROM f) GROUP BY 1, 2),
 mv AS MATERIALIZED (SELECT fn.id, fn.mod AS old, lk.mod AS new, fn.p, fn.tau, fn.d, sx.q, o.p AS po, o.tau AS tao, o.d AS do_, o.ex AS qo, n.p AS pn, n.tau AS tn, n.d AS dn, n.ex AS qn,
   coalesce(lo.fo, 0) AS oo, coalesce(lo.fi, 0) AS oi, lk.fo, lk.fi FROM fn JOIN sx USING (id) JOIN lk ON lk.id = fn.id AND lk.mod <> fn.mod JOIN m o ON o.mod = fn.mod JOIN m n ON n.mod = lk.mod LEFT JOIN lk lo ON lo.id = fn.id AND lo.mod = fn.mod),
 g AS MATERIALIZED (SELECT *, (SELECT sum(ex) FROM m) AS qt, qo - q + 0.85 * oo + (0.15 * p + 0.85 * d) * (tao - tau) + 0.85 * oi + (0.15 * (po - p) + 0.85 * (do_ - d)) * tau AS q1,
   qn + q - 0.85 * fo - (0.15 * p + 0.85 * d) * tn - 0.85 * fi - (0.15 * pn + 0.85 * dn) * tau AS q2 FROM mv),
 h AS MATERIALIZED (SELECT id, new, ({_pl("qt + q1 + q2 - qo - qn")} - {_pl("qt")} - 2 * ({_pl("q1")} + {_pl("q2")} - {_pl("qo")} - {_pl("qn")}) + {_pl("q1 + po - p")} + {_pl("q2 + pn + p")} - {_pl("qo + po")} - {_pl("qn + pn")}) / ln(2) AS dl FROM g)
SELECT id, new AS best_mod, round(dl, 9) + 0.0 AS dl FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(dl, 12), new) = 1""")
def infomap_one_sweep(spark, sf):
    fl = flow(spark, sf)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fl.nodes, fl.flows = bucketed(fl.nodes, ["id"], parts), bucketed(fl.flows, ["src"], parts)
    best = I.best_moves(I.move_gains(fl, by_tens(fl.nodes)))
    return best.select("id", F.col("new_mod").alias("best_mod"), r("dl", 9).alias("dl"))


@query()
def infomap_communities(spark, sf):
    """The whole search on the supplier-part graph, with rates taken to their end: nodes, super-nodes, coarse and fine tuning, until no move gains."""
    got = C.find_communities(flow(spark, sf, iterations=200))
    return got.partition.select("id", "mod", r(F.lit(got.code_length), 9).alias("code_length"))


@query(f"WITH {flow_sql()} SELECT m1 AS src, m2 AS dst, round(sum(f), 9) + 0.0 AS f FROM f WHERE m1 <> m2 GROUP BY 1, 2")
def contract_graph(spark, sf):
    fl = flow(spark, sf)
    return G.contract(fl, by_tens(fl.nodes))[0].flows.select("src", "dst", r("f", 9).alias("f"))


_LAB = f"l AS MATERIALIZED (SELECT src % {PARTS} AS m1, dst % {PARTS} AS m2 FROM e1)"


@query(f"WITH {TWO_WAY}, {_LAB}, a AS (SELECT m2, count(*) AS a, sum(CASE WHEN m1 = m2 THEN 1 ELSE 0 END) AS e FROM l GROUP BY 1) SELECT round(sum(e / n - (a / n) * (a / n)), 9) + 0.0 AS q FROM a, (SELECT CAST(count(*) AS DOUBLE) AS n FROM l)")
def modularity(spark, sf):
    e = two_way(spark, sf)
    return G.modularity(e, by_tens(G.vertices(e))).select(r("q", 9).alias("q"))


@query(f"WITH {TWO_WAY}, {_LAB} SELECT round(avg(CASE WHEN m1 <> m2 THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS c FROM l")
def conductance(spark, sf):
    e = two_way(spark, sf)
    return G.conductance(e, by_tens(G.vertices(e))).select(r("c", 9).alias("c"))


@query(f"WITH {TWO_WAY}, {_LAB} SELECT mod, round(avg(CASE WHEN m1 <> m2 THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS c FROM (SELECT m1 AS mod, m1, m2 FROM l UNION ALL SELECT m2, m1, m2 FROM l) GROUP BY 1")
def conductance_per_module(spark, sf):
    e = two_way(spark, sf)
    return G.conductance_per_module(e, by_tens(G.vertices(e))).select("mod", r("c", 9).alias("c"))


@query(f"WITH {rank_sql(3)} SELECT id % {PARTS} + 1 AS mod, row_number() OVER (PARTITION BY id % {PARTS} ORDER BY id) AS rank, id, round(p * 1e6, 6) + 0.0 AS p FROM p")
def tree_output(spark, sf):
    rates = cut(ranked(spark, sf, 3)[0])
    return G.tree_ranks(by_tens(rates), rates).select("mod", F.col("rank").cast("long").alias("rank"), "id", r(F.col("p") * 1e6, 6).alias("p"))


@query(f"WITH {TWO_WAY} SELECT id % {PARTS} AS mod, count(*) AS members, count(*) <= 10000 AS small FROM (SELECT src AS id FROM e1 UNION SELECT dst FROM e1) GROUP BY 1")
def module_members(spark, sf):
    return G.members(by_tens(G.vertices(two_way(spark, sf))))


@query(f"WITH {TWO_WAY}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM e1 UNION SELECT dst FROM e1) WHERE id % {PARTS} = 4) SELECT a.k AS src, b.k AS dst, w FROM e1 JOIN n a ON a.id = src JOIN n b ON b.id = dst")
def induced_subgraph(spark, sf):
    e = two_way(spark, sf)
    return G.induced_subgraph(e, by_tens(G.vertices(e)), 4)


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) * 7 // count(*) OVER () AS part FROM customer")
def block_split(spark, sf):
    return G.block_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 7).select("c_custkey", F.col("part").cast("long").alias("part"))


# ------------------------------------------------------------------ grids and solvers


@query(f"WITH {laplace_sql(30)} SELECT * FROM a")
def laplace_5pt(spark, sf):
    return M.laplace_5pt(spark, 30)


@query("SELECT CAST(k AS BIGINT) AS i, CAST(k % 10 + k // 10 AS BIGINT) AS level FROM range(100) r(k)")
def level_sets_5pt(spark, sf):
    return M.level_sets(M.laplace_5pt(spark, 10)).select("i", F.col("level").cast("long").alias("level"))


@query("WITH l AS (SELECT CAST(k % 10 + k // 10 AS BIGINT) AS level, count(*) AS size FROM range(100) r(k) GROUP BY 1) SELECT level, size, CAST(sum(size) OVER (ORDER BY level) - size AS BIGINT) AS start FROM l")
def level_stats(spark, sf):
    return M.level_stats(M.level_sets(M.laplace_5pt(spark, 10))).select(F.col("level").cast("long").alias("level"), "size", "start")


def _jacobi_sql(n: int, steps: int) -> str:
    out = [laplace_sql(n), f"x0 AS MATERIALIZED (SELECT CAST(k AS BIGINT) AS i, 0.0::DOUBLE AS x FROM range({n * n}) r(k))"]
    for k in range(1, steps + 1):
        out.append(f"x{k} AS MATERIALIZED (SELECT x.i, x.x + (1 - s) / 4 AS x FROM x{k - 1} x JOIN (SELECT a.i, sum(v * y.x) AS s FROM a JOIN x{k - 1} y ON y.i = j GROUP BY a.i) z ON z.i = x.i)")
    return ", ".join(out)


def _ones(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))


@query(f"WITH {_jacobi_sql(10, 20)} SELECT i, round(x, 9) + 0.0 AS x FROM x20")
def jacobi_5pt_20(spark, sf):
    return V.jacobi(M.laplace_5pt(spark, 10), _ones(spark, 100), 20).select("i", r("x", 9).alias("x"))


@query(f"WITH {_jacobi_sql(10, 5)} SELECT round(sqrt(sum((1 - s) * (1 - s))) / 10, 9) + 0.0 AS res FROM (SELECT a.i, sum(v * x) AS s FROM a JOIN x5 ON x5.i = j GROUP BY a.i)")
def jacobi_residual(spark, sf):
    a, b = M.laplace_5pt(spark, 10), _ones(spark, 100)
    return V.relative_residual(a, V.jacobi(a, b, 5), b).select(r("res", 9).alias("res"))


def _levels_sql(n: int) -> str:
    out, done = [laplace_sql(n)], None
    for k in range(2 * n - 1):
        here = f"(SELECT CAST(k AS BIGINT) AS i FROM range({n * n}) r(k) WHERE k % {n} + k // {n} = {k})"
        known = f"LEFT JOIN (SELECT a.i, sum(v * x) AS s FROM a JOIN y{k - 1} y ON y.i = j WHERE a.j < a.i GROUP BY a.i) z USING (i)" if done else ""
        new = f"SELECT i, (1 - {'coalesce(s, 0)' if done else '0'}) / 4.0 AS x FROM {here} h {known}"
        out.append(f"y{k} AS MATERIALIZED ({new}{f' UNION ALL SELECT i, x FROM y{k - 1}' if done else ''})")
        done = True
    return ", ".join(out)


@query(f"WITH {_levels_sql(5)} SELECT i, round(x, 12) + 0.0 AS x FROM y8")
def trisolve_5pt(spark, sf):
    return V.triangular_solve(M.laplace_5pt(spark, 5, "lower"), _ones(spark, 25)).select("i", r("x", 12).alias("x"))


def _cg_sql(n: int, steps: int) -> str:
    out = [laplace_sql(n), f"c0 AS MATERIALIZED (SELECT CAST(k AS BIGINT) AS i, 0.0::DOUBLE AS x, 1.0::DOUBLE AS r, 1.0::DOUBLE AS p FROM range({n * n}) t(k))"]
    for k in range(1, steps + 1):
        a = f"c{k - 1}"
        out.append(f"m{k} AS MATERIALIZED (SELECT c.i, x, r, p, ap FROM {a} c JOIN (SELECT a.i, sum(v * p) AS ap FROM a JOIN {a} b ON b.i = j GROUP BY a.i) z ON z.i = c.i)")
        out.append(f"s{k} AS MATERIALIZED (SELECT sum(r * r) / sum(p * ap) AS al, sum(r * r) AS rr FROM m{k})")
        out.append(f"n{k} AS MATERIALIZED (SELECT i, x + al * p AS x, r - al * ap AS r, p FROM m{k}, s{k})")
        out.append(f"c{k} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM n{k}) / rr * p AS p FROM n{k}, s{k})")
    return ", ".join(out)


@query(f"WITH {_cg_sql(10, 10)} SELECT i, round(x, 7) + 0.0 AS x FROM c10")
def cg_5pt_10(spark, sf):
    return V.conjugate_gradient(M.laplace_5pt(spark, 10), _ones(spark, 100), 0.0, 10).select("i", r("x", 7).alias("x"))


_SMALL = [[2, -1, -2], [-4, 6, 3], [-4, -2, 8]]


def _system(spark, rows) -> DataFrame:
    return spark.createDataFrame([(0, i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)], "g long, i long, j long, v double")


@query("SELECT name, i, j, v FROM (VALUES ('L',0,0,1),('L',1,0,-2),('L',1,1,1),('L',2,0,-2),('L',2,1,-1),('L',2,2,1),('U',0,0,2),('U',0,1,-1),('U',0,2,-2),('U',1,1,4),('U',1,2,-1),('U',2,2,3)) t(name, a, b, c), LATERAL (SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, CAST(c AS DOUBLE) AS v)")
def lu_small(spark, sf):
    return V.factor(_system(spark, _SMALL)).select("name", "i", "j", (r("v", 9)).alias("v"))


@query("SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, CAST(c AS DOUBLE) AS v FROM (VALUES (0,0,2),(0,1,1),(0,2,3),(1,1,3),(1,2,1),(2,2,2)) t(a, b, c)")
def cholesky_small(spark, sf):
    return V.factor(_system(spark, [[4, 2, 6], [2, 10, 6], [6, 6, 14]]), "cholesky").select("i", "j", r("v", 9).alias("v"))


@query("SELECT CAST(a AS BIGINT) AS i, CAST(b AS DOUBLE) AS x FROM (VALUES (0, 1), (1, 2), (2, 3)) t(a, b)")
def trisolve_refine(spark, sf):
    rhs = spark.createDataFrame([(0, i, float(sum(a * b for a, b in zip(row, (1, 2, 3), strict=True)))) for i, row in enumerate(_SMALL)], "g long, i long, x double")
    return V.solve(_system(spark, _SMALL), rhs, low="float32").select("i", r("x", 9).alias("x"))


# ------------------------------------------------------------------- number formats


def _fields_sql(bits: str, width: int, es: int) -> str:
    """A SELECT list of fields of a posit in DuckDB, from a column of patterns."""
    half, full = 1 << (width - 1), 1 << width
    return f"""SELECT *, (1 + frac / pow(2.0, nf)) * pow(2.0, k * {1 << es} + ex) AS mag FROM (
 SELECT *, CAST(CASE WHEN {es} = 0 THEN 0 WHEN le >= {es} THEN floor((body % CAST(pow(2, le) AS BIGINT)) / pow(2.0, le - {es})) ELSE (body % CAST(pow(2, le) AS BIGINT)) * pow(2.0, {es} - le) END AS INTEGER) AS ex, body % CAST(pow(2, nf) AS BIGINT) AS frac FROM (
 SELECT *, greatest({width - 2} - run, 0) AS le, greatest({width - 2} - run - {es}, 0) AS nf, CASE WHEN body >= {half // 2} THEN run - 1 ELSE -run END AS k FROM (
 SELECT *, CAST(CASE WHEN fl = 0 THEN {width - 1} ELSE {width - 1} - length(bin(fl)) END AS INTEGER) AS run FROM (
 SELECT *, CASE WHEN body >= {half // 2} THEN {half - 1} - body ELSE body END AS fl FROM (
 SELECT b, CASE WHEN b >= {half} THEN {full} - b ELSE b END % {half} AS body FROM {bits})))))"""


_ALL16 = "(SELECT CAST(k AS BIGINT) AS b FROM range(65536) t(k))"


@query(f"SELECT b AS bits, CASE WHEN b = 0 THEN 0.0 WHEN b = 32768 THEN NULL WHEN b > 32768 THEN -mag ELSE mag END::DOUBLE AS value FROM ({_fields_sql(_ALL16, 16, 1)})")
def posit16_decode(spark, sf):
    return spark.range(1 << 16).select(F.col("id").alias("bits"), P.decode(F.col("id"), 16).alias("value"))


@query(f"SELECT b AS bits, k AS regime, ex AS exponent, nf AS fraction_bits, frac AS fraction FROM ({_fields_sql(_ALL16, 16, 1)}) WHERE b <> 0 AND b <> 32768")
def posit16_fields(spark, sf):
    b = F.col("id")
    return spark.range(1 << 16).where("id <> 0 and id <> 32768").select(b.alias("bits"), P.regime(b, 16).cast("int").alias("regime"), P.exponent(b, 16, 1).alias("exponent"), P.fraction_bits(b, 16, 1).cast("int").alias("fraction_bits"), P.fraction(b, 16, 1).alias("fraction"))


@query("WITH t AS (SELECT CAST(x AS BIGINT) AS a, CAST(y AS BIGINT) AS b, CASE WHEN x > 127 THEN x - 256 ELSE x END AS sa, CASE WHEN y > 127 THEN y - 256 ELSE y END AS sb FROM range(256) p(x), range(256) q(y)) SELECT a, b, sa < sb AS lt, sa <= sb AS le, sa = sb AS eq FROM t")
def posit_compare(spark, sf):
    pair = spark.range(1 << 16).select(F.shiftright("id", 8).alias("a"), F.col("id").bitwiseAND(255).alias("b"))
    a, b = F.col("a"), F.col("b")
    return pair.select("a", "b", P.less(a, b, 8).alias("lt"), P.less_equal(a, b, 8).alias("le"), P.equal(a, b).alias("eq"))


def _table8_sql(op: str) -> str:
    """All pairs: the exact double result, rounded by the 9-bit patterns between posits."""
    return f"""WITH v AS MATERIALIZED (SELECT b, CASE WHEN b = 0 THEN 0.0 WHEN b > 128 THEN -mag ELSE mag END AS x FROM ({_fields_sql("(SELECT CAST(k AS BIGINT) AS b FROM range(256) t(k))", 8, 0)}) WHERE b <> 128),
 e AS MATERIALIZED (SELECT b // 2 AS k, mag AS edge FROM ({_fields_sql("(SELECT CAST(2 * k + 1 AS BIGINT) AS b FROM range(1, 127) t(k))", 9, 0)})),
 r AS MATERIALIZED (SELECT p.b AS a, q.b AS b, p.x {op} q.x AS y FROM v p, v q),
 d AS MATERIALIZED (SELECT DISTINCT abs(y) AS y FROM r WHERE y <> 0),
 c AS MATERIALIZED (SELECT y, 1 + count(k) AS bits FROM d LEFT JOIN e ON edge < y OR (edge = y AND k % 2 = 1) GROUP BY y)
 SELECT r.a, r.b, CAST(CASE WHEN r.y = 0 THEN 0 WHEN r.y < 0 THEN 256 - bits ELSE bits END AS BIGINT) AS bits FROM r LEFT JOIN c ON c.y = abs(r.y)
 UNION ALL SELECT CAST(x AS BIGINT), CAST(z AS BIGINT), 128 FROM range(256) p(x), range(256) q(z) WHERE x = 128 OR z = 128"""


def _table8(spark, op: str) -> DataFrame:
    pair = spark.range(1 << 16).select(F.shiftright("id", 8).alias("a"), F.col("id").bitwiseAND(255).alias("b"))
    return pair.select("a", "b", P.column(op, 8)("a", "b").alias("bits"))


@query(_table8_sql("+"))
def posit8_add_table(spark, sf):
    return _table8(spark, "add")


@query(_table8_sql("-"))
def posit8_sub_table(spark, sf):
    return _table8(spark, "subtract")


@query(_table8_sql("*"))
def posit8_mul_table(spark, sf):
    return _table8(spark, "multiply")


@query(_table8_sql("/").replace("FROM v p, v q)", "FROM v p, v q WHERE q.x <> 0)").replace("WHERE x = 128 OR z = 128", "WHERE x = 128 OR z = 128 OR z = 0"))
def posit8_div_table(spark, sf):
    return _table8(spark, "divide")


@query("""WITH a AS (SELECT DISTINCT l_extendedprice AS x, CAST(floor(log2(l_extendedprice)) AS INTEGER) AS s FROM lineitem),
 b AS (SELECT x, s, s // 4 AS k, s % 4 AS e, 27 - s // 4 AS nf FROM a), c AS (SELECT *, CAST(round_even((x / pow(2.0, s) - 1) * pow(2.0, nf), 0) AS BIGINT) AS f FROM b)
SELECT x AS l_extendedprice, ((CAST(pow(2, k + 1) AS BIGINT) - 1) * 8 + e) * CAST(pow(2, nf) AS BIGINT) + f AS bits, (1 + f / pow(2.0, nf)) * pow(2.0, s) AS value FROM c""")
def posit32_encode(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice").distinct()
    # Marked so that the planner does not copy it into the many places that decode it: each copy sends the price to Python again.
    encode = P.column("from_double", 32).asNondeterministic()
    encoded = li.withColumn("bits", encode("l_extendedprice"))
    return encoded.withColumn("value", P.decode(F.col("bits"), 32))


@query("""WITH a AS (SELECT 5 - least(CASE WHEN k >= 0 THEN k + 2 ELSE 1 - k END, 31) AS adv FROM (SELECT floor(log2(abs(l_extendedprice)) / 4) AS k FROM lineitem WHERE l_extendedprice <> 0))
SELECT CAST(adv AS INTEGER) AS adv, round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM a GROUP BY adv""")
def posit_advantage(spark, sf):
    per = table(spark, sf, "lineitem").select(P.advantage(F.col("l_extendedprice")).alias("adv")).where("adv is not null").groupBy("adv").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("adv", r(100.0 * F.col("n") / F.col("t"), 6).alias("share"))


@query("SELECT l_suppkey AS k, CAST(sum(CAST(round(l_quantity) AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS dot FROM lineitem GROUP BY 1")
def quire_dot(spark, sf):
    """Exact products on scaled integers, summed as decimals: no rounding at all."""
    li = table(spark, sf, "lineitem")
    a, b = F.round("l_quantity").cast("decimal(12,0)"), F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    return li.groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(a * b).cast("long").alias("dot"))


@query("SELECT event_id, CASE WHEN value = 0 THEN 0.0 ELSE round_even(value / pow(2.0, floor(log2(abs(value))) - 7), 0) * pow(2.0, floor(log2(abs(value))) - 7) END AS b FROM events")
def bfloat16_round(spark, sf):
    return table(spark, sf, "events").select("event_id", P.bfloat16(F.col("value")).alias("b"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 9) + 0.0 AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_dot(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pair = e.select(F.col("vec_id").alias("a"), "x").join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("x").alias("y")), "a")
    dot = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pair.select("a", "b", r(dot, 9).alias("dot"))


@query("SELECT a.vec_id AS a, round(list_avg(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2))), 9) + 0.0 AS mse FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_mse(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pair = e.select(F.col("vec_id").alias("a"), "x").join(e.select((F.col("vec_id") - 1).alias("a"), F.col("x").alias("y")), "a")
    total = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pair.select("a", r(total / F.size("x"), 9).alias("mse"))


@query("WITH a AS (SELECT CASE WHEN k >= 0 THEN k + 2 ELSE 1 - k END AS bits FROM (SELECT floor(log2(abs(value)) / 4) AS k FROM events WHERE value <> 0)) SELECT CAST(least(bits, 31) AS INTEGER) AS bits, count(*) AS n FROM a GROUP BY 1")
def posit_traffic(spark, sf):
    return table(spark, sf, "events").select(P.regime_traffic(F.col("value")).alias("bits")).where("bits is not null").groupBy("bits").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(i - 30 AS BIGINT) AS k, CAST(greatest(29 - CASE WHEN i >= 30 THEN i - 28 ELSE 31 - i END, 0) AS INTEGER) AS fraction_bits FROM range(61) t(i)")
def posit_envelope(spark, sf):
    return P.precision_envelope(spark)


@query("SELECT s_suppkey, pow(4.0, round_even(log2(abs(s_acctbal)) / 2, 0)) AS p FROM supplier WHERE s_acctbal <> 0")
def closest_power_four(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal <> 0").select("s_suppkey", P.nearest_power_of_four(F.col("s_acctbal")).alias("p"))


@query("SELECT event_id, CASE WHEN value = 0 THEN 0.0 ELSE round_even(value / pow(2.0, greatest(floor(log2(abs(value))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(value))), -14) - 10) END AS h FROM events")
def half_round(spark, sf):
    return table(spark, sf, "events").select("event_id", P.half(F.col("value")).alias("h"))


@query("SELECT user_id % 20 AS k, round(fsum(value), 6) + 0.0 AS s FROM events GROUP BY 1")
def exact_sums(spark, sf):
    return exact_sums_of(table(spark, sf, "events").select((F.col("user_id") % 20).alias("k"), "value"), ["k"], "value", "s").select("k", r("s", 6).alias("s"))


@query("SELECT CAST(24 AS DOUBLE) AS det")
def det_small(spark, sf):
    a = M.transpose(_system(spark, _SMALL).select("i", "j", "v"))
    lu_rows = V.factor(a.withColumn("g", F.lit(0).cast("long")).select("g", "i", "j", "v")).where("name = 'U' and i = j")
    return lu_rows.agg(r(F.product("v"), 9).alias("det"))


@query()
def random_lower_matrix(spark, sf):
    return M.random_matrix(spark, 1000, 10, "lower")


@query("SELECT CAST(k AS BIGINT) AS i, CAST((SELECT count(*) FROM (VALUES (k - 1, k % 30 > 0), (k - 30, k >= 30)) t(j, ok) WHERE ok) AS BIGINT) AS in_degree FROM range(1, 900) r(k)")
def dependency_counts(spark, sf):
    return M.dependency_counts(M.laplace_5pt(spark, 30))


@query("SELECT DISTINCT CAST(i // 4 AS BIGINT) AS i, CAST(j // 4 AS BIGINT) AS j, 1.0::DOUBLE AS v FROM (WITH " + laplace_sql(12) + " SELECT * FROM a)")
def block_pattern(spark, sf):
    return M.block_pattern(M.laplace_5pt(spark, 12), 4)


@query()
def sub_modules(spark, sf):
    """Coarse tuning: modules of the supplier-part graph searched on their own."""
    fl = flow(spark, sf)
    part = cut(by_tens(fl.nodes))
    found = C.sub_modules(cut(fl.nodes), fl.flows, part, most=10)
    return part.join(found.partition().withColumnRenamed("mod", "sub"), "id")


# ------------------------------------------------------------------ signals and codes

_BINS = "s AS MATERIALIZED (SELECT event_id % 64 AS t, sum(value) AS x FROM events GROUP BY 1)"


def _bins(spark, sf, n=64, name="t", value="x"):
    return table(spark, sf, "events").groupBy((F.col("event_id") % n).alias(name)).agg(F.sum("value").alias(value))


@query(f"WITH {_BINS} SELECT CAST(k AS INTEGER) AS k, round(sum(x * cos(-2 * pi() * (t * k % 64) / 64)), 4) + 0.0 AS re, round(sum(x * sin(-2 * pi() * (t * k % 64) / 64)), 4) + 0.0 AS im FROM s, range(64) q(k) GROUP BY k")
def dft_events(spark, sf):
    return S.dft(_bins(spark, sf), 64).select("k", r("re", 4).alias("re"), r("im", 4).alias("im"))


@query(f"WITH {_BINS} SELECT CAST(k AS BIGINT) AS k, round(sum(x * cos(-2 * pi() * (t * k % 64) / 64)), 4) + 0.0 AS re, round(sum(x * sin(-2 * pi() * (t * k % 64) / 64)), 4) + 0.0 AS im FROM s, range(64) q(k) GROUP BY k")
def fft_events(spark, sf):
    x = _bins(spark, sf).select(F.lit(0).cast("long").alias("g"), "t", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    return S.fft(x).select("k", r("re", 4).alias("re"), r("im", 4).alias("im"))


@query("WITH s AS (SELECT event_id % 32 AS k, count(*) AS v FROM events GROUP BY 1), b AS (SELECT * FROM (VALUES (0, 3), (1, -1), (5, 2)) t(j, w)) SELECT CAST((k + j) % 32 AS BIGINT) AS k, CAST(sum(v * w) AS BIGINT) AS v FROM s, b GROUP BY 1")
def circular_convolution(spark, sf):
    a = table(spark, sf, "events").groupBy((F.col("event_id") % 32).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    b = spark.createDataFrame([(0, 3), (1, -1), (5, 2)], "k long, v long")
    return S.convolve(a, b, 32)


@query("WITH s AS (SELECT event_id % 8 AS i, event_id // 8 % 8 AS j, count(*) AS v FROM events GROUP BY 1, 2), b AS (SELECT * FROM (VALUES (0, 0, 2), (1, 3, -1)) t(x, y, w)) SELECT CAST((i + x) % 8 AS BIGINT) AS i, CAST((j + y) % 8 AS BIGINT) AS j, CAST(sum(v * w) AS BIGINT) AS v FROM s, b GROUP BY 1, 2")
def circular_convolution_2d(spark, sf):
    e = table(spark, sf, "events")
    a = e.groupBy((F.col("event_id") % 8).alias("i"), (F.floor(F.col("event_id") / 8) % 8).alias("j")).agg(F.count(F.lit(1)).alias("v"))
    return S.convolve_2d(a, spark.createDataFrame([(0, 0, 2), (1, 3, -1)], "i long, j long, v long"), 8, 8)


@query("SELECT CAST(k AS BIGINT) AS n, CAST(xor(k, k >> 1) AS BIGINT) AS g, CAST(k AS BIGINT) AS back, lpad(bin(k), 10, '0') AS bits FROM range(1024) t(k)")
def gray_code(spark, sf):
    g = S.gray_encode(F.col("id"))
    return spark.range(1024).select(F.col("id").alias("n"), g.alias("g"), S.gray_decode(g).alias("back"), S.to_binary(F.col("id"), 10).alias("bits"))


@query()
def huffman_lengths(spark, sf):
    """Codes of quantities modulo 12; only the symbol counts reach the driver."""
    li = table(spark, sf, "lineitem").groupBy((F.col("l_quantity").cast("int") % 12).cast("string").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    codes = S.huffman_codes({x[0]: x[1] for x in li.collect()})
    return spark.createDataFrame([(s, len(c), c) for s, c in codes.items()], "sym string, len int, code string")


@query("WITH h AS (SELECT pi() / 10000 AS h), c AS (SELECT k, k * h AS x, h FROM range(10001) t(k), h), f AS (SELECT k, h, x" + "".join(f" + sin({1 << k} * x) / {1 << k}" for k in range(1, 11)) + " AS y FROM c), d AS (SELECT h, y - lag(y) OVER (ORDER BY k) AS dy FROM f) SELECT round(sum(sqrt(h * h + dy * dy)), 9) + 0.0 AS s FROM d WHERE dy IS NOT NULL")
def arc_length(spark, sf):
    return S.arc_length(spark, 10_000).select(r("s", 9).alias("s"))


# --------------------------------------------------------------------------- messages


@query("SELECT user_id AS user, min_by(event_id, ts) AS first, count(*) AS n FROM (SELECT user_id, event_id, struct_pack(a := ts, b := event_id) AS ts FROM events) GROUP BY 1")
def message_fifo(spark, sf):
    e = table(spark, sf, "events").withColumn("seq", F.struct("ts", "event_id"))
    return Q.poll(e, "user_id", "seq", "event_id").withColumnRenamed("user_id", "user")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def message_order(spark, sf):
    return Q.receive(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id").withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id % 50 AS bin, count(*) AS cnt FROM events GROUP BY 1")
def streaming_histogram(spark, sf):
    """The events as a stream, tallied until everything was received."""
    import uuid

    cut(spark.range(1))  # sets the checkpoint folder where the session has none
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/") + f"/histogram-{uuid.uuid4().hex}"
    path = f"{sf}/events.parquet"
    # As a pattern the path may be a folder or a single file.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/[e]vents.parquet").withColumn("key", F.col("user_id") % 50)
    done: list[str] = []

    def keep(rows, number):
        rows.write.mode("overwrite").parquet(f"{base}/out/{number}")
        done.append(f"{base}/out/{number}")

    q = Q.streaming_histogram(stream, "key").writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(done[-1])


