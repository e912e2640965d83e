import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import G3, G6, graph

from lacewing import Graph
from lacewing import sources as S
from lacewing.operators import decompress, filter_rules, repair, sssp
from lacewing.streaming import keep_edges, streaming_degrees


def rows(g, n):
    out = [[] for _ in range(n)]
    order = ["src", "pos"] if "pos" in g.edges.columns else ["src", "dst"]
    for r in g.edges.orderBy(*order).collect():
        out[r["src"]].append(r["dst"])
    return out


def test_text_formats(spark, tmp_path):
    for head in ("", "src dst\n", "# comment\n"):
        p = tmp_path / "g.el"
        p.write_text(head + "0 1\n0 2\n2 0\n2 1\n")
        assert rows(S.load_graph(spark, str(p)), 3) == G3
    (tmp_path / "g.adj").write_text("AdjacencyGraph 3 4 0 2 2 1 2 0 1".replace(" ", "\n"))
    assert rows(S.load_graph(spark, str(tmp_path / "g.adj")), 3) == G3
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n3 3 4\n1 2\n1 3\n3 1\n3 2\n")
    assert rows(S.load_graph(spark, str(tmp_path / "g.mtx")), 3) == G3
    (tmp_path / "g.sep").write_text("3 4 1 2 3 4 0 1 5")
    g = S.read_separated(spark, str(tmp_path / "g.sep"))
    assert rows(g, 3) == G3
    assert g.meta.vertex_cnt == 3
    (tmp_path / "bad.adj").write_text("Graph 1 0 0")
    with pytest.raises(ValueError, match="AdjacencyGraph"):
        S.read_adjacency(spark, str(tmp_path / "bad.adj"))
    with pytest.raises(FileNotFoundError):
        S.read_edge_list(spark, str(tmp_path / "none.el"))


def test_round_trips(spark, tmp_path):
    g = graph(spark, G6)
    S.write_csr(g, str(tmp_path))
    S.write_degree(g, str(tmp_path / "degree.bin"))
    ints = lambda name: list(struct.unpack(f"={(tmp_path / name).stat().st_size // 4}i", (tmp_path / name).read_bytes()))
    assert ints("csr_vlist.bin") == [0, 4, 8, 11, 11, 12, 13]
    assert ints("degree.bin") == [4, 4, 3, 0, 1, 1]
    assert ints("info.bin") == [6, 0]
    assert rows(S.read_csr(spark, str(tmp_path / "csr_vlist.bin"), str(tmp_path / "csr_elist.bin")), 6) == G6
    S.write_adjacency(g, str(tmp_path / "a.adj"))
    assert rows(S.read_adjacency(spark, str(tmp_path / "a.adj")), 6) == G6
    S.write_matrix_market(g, str(tmp_path / "a.mtx"))
    assert rows(S.read_matrix_market(spark, str(tmp_path / "a.mtx")), 6) == G6
    S.write_edge_list(g, str(tmp_path / "a.el"))
    assert rows(S.read_edge_list(spark, str(tmp_path / "a.el")), 6) == G6
    c = repair(g, batch=1)
    S.write_order(c, str(tmp_path / "order.bin"))
    assert ints("order.bin") == [2, 1, 0]
    S.save_compressed(c, str(tmp_path / "c"))
    again = S.load_compressed(spark, str(tmp_path / "c"))
    assert again.meta == c.meta
    assert [r["dist"] for r in sssp(again, 0).orderBy("id").collect()] == [0, None, 1, 1, 1, 1]


def test_malformed_lines_raise(spark, tmp_path):
    for k, text in enumerate(("0 1\nfoo 3\n2 0\n", "src dst\nsrc dst\n0 1\n", "0 1\n2\n", "0 1\n2 x\n", "1x 2\n0 1\n")):
        p = tmp_path / f"{k}.el"
        p.write_text(text)
        with pytest.raises(ValueError, match="not edges"):
            S.read_edge_list(spark, str(p))
    (tmp_path / "w.el").write_text("# weighted\nfrom to weight\n0,1,2.5\n1 0 1\n")
    g = S.read_edge_list(spark, str(tmp_path / "w.el"))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 2.5), (1, 0, 1.0)]
    for name, text, why in (("a.mtx", "%%x\n2 2 2\n1 1\n", "2 entries"), ("b.mtx", "%%x\n", "dimensions")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=why):
            S.read_matrix_market(spark, str(tmp_path / name))
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(ValueError, match="4 each"):
        S.read_binary(spark, str(tmp_path / "odd.bin"))


@pytest.mark.parametrize("single", [True, False])
def test_sparse_ids_are_numbered_densely(spark, tmp_path, single):
    g = Graph.from_edges(spark.createDataFrame([(5, 900), (900, 70), (5, 70)], "src long, dst long"))
    want = [[1, 2], [], [1]]
    S.write_csr(g, str(tmp_path), single=single)
    assert rows(S.read_csr(spark, str(tmp_path / "csr_vlist.bin"), str(tmp_path / "csr_elist.bin")), 3) == want
    S.write_adjacency(g, str(tmp_path / "a.adj"), single=single)
    assert rows(S.read_adjacency(spark, str(tmp_path / "a.adj")), 3) == want
    S.write_matrix_market(g, str(tmp_path / "a.mtx"), single=single)
    assert rows(S.read_matrix_market(spark, str(tmp_path / "a.mtx")), 3) == want


@pytest.mark.parametrize("ids", [1, 7])
def test_grammars_go_through_all_formats(spark, tmp_path, ids):
    plain = graph(spark, G6)
    apart = lambda c: (F.col(c) * ids).alias(c)
    g = Graph(plain.edges.select(apart("src"), apart("dst"), "pos"), plain.vertices.select(apart("id")))
    c = repair(g, batch=1)
    S.write_csr(c, str(tmp_path))
    ints = lambda name: list(struct.unpack(f"={(tmp_path / name).stat().st_size // 4}i", (tmp_path / name).read_bytes()))
    assert ints("info.bin") == [6, 3]
    assert ints("csr_vlist.bin") == [0, 1, 2, 3, 3, 4, 5, 7, 9, 11]
    assert ints("csr_elist.bin") == [8, 8, 7, 5, 0, 3, 4, 6, 5, 2, 7]
    again = S.read_compressed_csr(spark, str(tmp_path))
    assert (again.meta.vertex_cnt, again.meta.rule_cnt) == (6, 3)
    assert rows(decompress(again), 6) == G6
    assert [r["dist"] for r in sssp(again, 0).orderBy("id").collect()] == [0, None, 1, 1, 1, 1]
    assert again.ratio() == pytest.approx(20 / 21)
    pruned = filter_rules(again, 0)
    assert rows(decompress(pruned), 6) == G6
    S.write_adjacency(c, str(tmp_path / "c.adj"))
    S.write_matrix_market(c, str(tmp_path / "c.mtx"))
    for kind in ("adj", "mtx"):
        back = S.load_graph(spark, str(tmp_path / f"c.{kind}"))
        want = [[8], [8], [7], [], [5], [0], [3, 4], [6, 5], [2, 7]]
        assert rows(back, 9) == (want if kind == "adj" else [sorted(r) for r in want])
    (tmp_path / "info.bin").write_bytes(struct.pack("=2i", 5, 3))
    with pytest.raises(ValueError, match="9 rows for 5 vertices"):
        S.read_compressed_csr(spark, str(tmp_path))


def test_a_large_file_is_read_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lacewing.sources.readers.BLOCK", 1 << 20)
    n = 2_000_000
    np.arange(n, dtype="=i4").tofile(tmp_path / "n.bin")
    df = S.read_binary(spark, str(tmp_path / "n.bin"))
    assert df.rdd.getNumPartitions() > 1
    assert df.agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_if(F.col("idx") != F.col("value"))).first()[:] == (n, 0, n - 1, 0)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    keep_edges(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = streaming_degrees(stream).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("degrees").collect()] == [(0, 2)]
