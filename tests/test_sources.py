import pytest

from floeberg.operators import graph as G
from floeberg.sources import graphs as R, matrices as X
from floeberg.streaming import queues as Q


def test_pajek(spark, tmp_path):
    (tmp_path / "a.net").write_text('*Vertices 3\n1 "one" 1\n2 "two words" 2\n3 "three"\n*Arcs\n1 2 1.0\n1 3 1.7\n2 3 2.0\n3 2 1.2\n1 2\n')
    nodes, edges = R.read_pajek(spark, str(tmp_path / "a.net"))
    assert sorted(map(tuple, nodes.collect())) == [(1, "one", 1.0), (2, "two words", 2.0), (3, "three", 1.0)]
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 2.0), (1, 3, 1.7), (2, 3, 2.0), (3, 2, 1.2)]


def test_adjacency_and_links(spark, tmp_path):
    (tmp_path / "a.csr").write_text("3 2\n1 2\n0\n0\n")
    assert sorted(map(tuple, R.read_adjacency(spark, str(tmp_path / "a.csr")).collect())) == [(0, 1, 1.0), (0, 2, 1.0)]
    (tmp_path / "links").write_text("# c\n500 7 2\n7 900\n500 7 1\n")
    edges, names = R.read_link_list(spark, str(tmp_path / "links"))
    assert sorted(map(tuple, edges.collect())) == [(0, 2, 1.0), (1, 0, 3.0)] and names.count() == 3
    (tmp_path / "part").write_text("0 1\n1 0\n")
    assert sorted(map(tuple, R.read_partition(spark, str(tmp_path / "part")).collect())) == [(0, 1), (1, 0)]
    (tmp_path / "d.csv").write_text("1,0\n2,1\n0,2\n")
    assert R.read_dependency_csv(spark, str(tmp_path / "d.csv"), 3).count() == 5
    assert R.longest_line(spark, str(tmp_path / "d.csv")).first().fields == 2


def test_writers(spark, tmp_path):
    part = spark.createDataFrame([(0, 5), (1, 5), (2, 9)], "id long, mod long")
    rates = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25)], "id long, p double")
    R.write_tree(G.tree_ranks(part, rates), 1.5, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t/nodes")).collect()] == ['1:1 0.5 "0"', '1:2 0.25 "1"', '2:1 0.25 "2"']
    assert spark.read.text(str(tmp_path / "t/header")).first()[0] == "# Code length 1.5 in 2 modules."
    R.write_clusters(part, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c/header")).first()[0] == "*Vertices 3"


def test_matrix_market(spark, tmp_path):
    p = str(tmp_path / "a.mtx")
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 3\n1 1 2.5\n2 1 -1\n3 3 4\n")
    assert sorted(map(tuple, X.read_matrix_market(spark, p).collect())) == [(1, 1, 2.5), (1, 2, -1.0), (2, 1, -1.0), (3, 3, 4.0)]
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 1\n2 1\n")
    with pytest.raises(ValueError):
        X.read_matrix_market(spark, str(tmp_path / "b.mtx"))
    assert X.read_matrix_market(spark, str(tmp_path / "b.mtx"), pattern_ok=True).count() == 2
    for bad in ("%%MatrixMarket matrix array pattern general", "%%Other matrix coordinate real general", "%%MatrixMarket matrix coordinate real hermitian"):
        with pytest.raises(ValueError):
            X.parse_banner(bad)
    mat = X.read_matrix_market(spark, p)
    X.write_matrix_market(mat, str(tmp_path / "w"), 3, 3)
    assert spark.read.text(str(tmp_path / "w/b-entries")).first()[0] == "1 1 2.500000000000000e+00"


def test_binary_triplets(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(X.pack_triplets([(1, 1, 4.0), (2, 1, 0.0), (1, 2, 3.0)], 2))
    assert sorted(map(tuple, X.read_binary_triplets(spark, str(tmp_path / "m.bin")).collect())) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 1.0)]
    assert X.read_binary_triplets(spark, str(tmp_path / "m.bin"), "lower").collect() == [(2, 1, 1.0)]


def test_countdown_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, 2.0, 2), (2, 5.0, 1), (1, 3.0, 2), (3, 1.0, 4)]
    spark.createDataFrame(rows, "dst long, value double, deps int").write.parquet(src)
    stream = spark.readStream.schema("dst long, value double, deps int").parquet(src)
    q = Q.countdown(stream).writeStream.format("memory").queryName("countdown").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("countdown").collect())) == [(1, 5.0), (2, 5.0)]


def test_size_lines_are_told_by_their_place(spark, tmp_path):
    """Integer values above the entry count, entries equal to the size line, and array files."""
    head = "%%MatrixMarket matrix {} real general\n% a comment\n"
    (tmp_path / "a.mtx").write_text(head.format("coordinate") + "3 3 3\n1 1 4096\n2 2 4096\n3 3 4096\n")
    shares = {r.bits: r.share for r in X.directory_traffic(spark, str(tmp_path)).collect()}
    assert list(shares.values()) == [1.0]
    (tmp_path / "b.mtx").write_text(head.format("coordinate") + "3 3 3\n3 3 3\n1 1 3\n2 2 3\n")
    (tmp_path / "c.mtx").write_text(head.format("array") + "1 2\n4096\n4096\n")
    three = {r.bits: r.share for r in X.directory_traffic(spark, str(tmp_path)).collect()}
    (high,) = shares
    assert three[high] == pytest.approx(2 / 3) and sum(three.values()) == pytest.approx(1) and len(three) == 2
