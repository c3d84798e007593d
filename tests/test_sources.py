import pytest
from pyspark.sql import functions as F

from driftrank.config import Slide
from driftrank.operators.edges import differing, encode
from driftrank.operators.scan import prefix_scan, with_position
from driftrank.plans import engine
from driftrank.plans.stream import EdgeStream
from driftrank.sources import binary, text
from driftrank.storage import shared_dir
from driftrank.streaming.sliding import SlidingPPR


def test_text_edge_list(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("# a comment\n7\t9\n\n9 12\n7 7")  # the last line has no end
    raw = text.read_edge_list(spark, str(path))
    assert [tuple(r) for r in raw.orderBy("pos").collect()] == [(0, 7, 9), (1, 9, 12), (2, 7, 7)]
    assert [tuple(r) for r in encode(raw).orderBy("pos").collect()] == [(0, 0, 2, 6), (1, 2, 5, 6), (2, 0, 0, 6)]


def test_edge_lists_in_several_files(spark, tmp_path):
    """Positions follow the paths, however large the files are, and lines within a file split in blocks."""
    (tmp_path / "a.txt").write_text("1 1")
    (tmp_path / "b.txt").write_text("\n".join(f"2 {i}" for i in range(500)))
    (tmp_path / "c.txt").write_text("3 3\n3 4\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = text.read_edge_list(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in rows] == [(i, *e) for i, e in enumerate([(1, 1), *((2, i) for i in range(500)), (3, 3), (3, 4)])]


def test_binary_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2), (1, 0, 0), (2, 2, 1)], "pos bigint, src bigint, dst bigint")
    path = str(tmp_path / binary.binary_name("a/b/g.txt"))
    binary.write_binary(edges, path, 3)
    assert path.endswith("g.bin") and binary.binary_name("g.txt", True) == "g_rev.bin"
    assert binary.read_header(spark, path) == 3
    for whole in (False, True):
        assert differing(edges, binary.read_binary(spark, path, whole)).isEmpty()
    many = spark.range(30_000).repartition(5).select(F.col("id").alias("pos"), (F.col("id") * 7 % 1000).alias("src"), (F.col("id") % 13).alias("dst"))
    binary.write_binary(many, "file://" + path, 1000)
    spark.dataSource.register(binary.EdgeStreamSource)
    assert differing(many, spark.read.format("edgestream").option("pairs", 4096).load(path)).isEmpty()
    with pytest.raises(Exception, match="31 bits"):
        binary.write_binary(edges.withColumn("src", F.lit(1 << 40)), path, 3)
    binary.write_binary(edges.limit(0), path, 0)
    assert binary.read_binary(spark, path).count() == 0


def test_vertex_list_and_logs(spark, tmp_path):
    text.write_vertices(spark.range(5), str(tmp_path / "v"))
    assert [r.target for r in text.read_vertices(spark, str(tmp_path / "v"), 1, 3).collect()] == [1, 2]
    text.write_vertices(spark.range(200).repartition(8).orderBy(F.desc("id")), str(tmp_path / "w"))
    assert sorted(r.target for r in text.read_vertices(spark, str(tmp_path / "w"), 10, 20).collect()) == list(range(180, 190))
    (tmp_path / "run.log").write_text("ppr_time 3\nppr_latency 1.5 ms\nother\nppr_latency 2.5 ms\n")
    found = {r.keyword: r.value for r in text.log_values(spark, str(tmp_path / "run.log"), ["ppr_time", "ppr_latency", "none"]).collect()}
    assert found == {"ppr_time": 3.0, "ppr_latency": 2.5}


def test_positions_and_scans(spark):
    df = spark.createDataFrame([(i * 7 % 10, i) for i in range(10)], "id bigint, v bigint")
    assert sorted((r.pos, r.id) for r in with_position(df, ["id"]).collect()) == [(i, i) for i in range(10)]
    rows = {r.id: r for r in prefix_scan(df, "id", "v").collect()}
    v = {r.id: r.v for r in df.collect()}
    for i in range(10):
        before, after = sum(v[k] for k in range(i)), sum(v[k] for k in range(i + 1, 10))
        assert (rows[i].exclusive, rows[i].inclusive, rows[i].back_exclusive, rows[i].back_inclusive) == (before, before + v[i], after, after + v[i])
    assert with_position(df.limit(0), ["id"]).count() == 0


def test_streaming_equals_batch(spark, tmp_path):
    edges = [(i, i * 3 % 4, i * 5 % 4) for i in range(12)]
    schema = "pos bigint, src bigint, dst bigint"
    slide, vertices = Slide(5, 2, 3), spark.range(4).select("id")
    for chunk, (a, b) in enumerate([(0, 3), (3, 8), (8, 12)]):
        spark.createDataFrame(edges[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job = SlidingPPR(vertices, [0], slide, str(tmp_path / "root"), epsilon=1e-6)
    job.start(str(tmp_path / "in"), str(tmp_path / "ckpt"), once=True).awaitTermination()
    assert job.done() == 3
    run = engine.PushEngine(EdgeStream(spark.createDataFrame(edges, schema), vertices, True), slide, [0], epsilon=1e-6)
    want = {r.id: r.p for r in run.run(3).collect()}
    got = {r.id: r.p for r in job.state(3).collect()}
    assert all(abs(got[i] - want[i]) <= 2e-6 for i in range(4))
    job.process(spark.createDataFrame(edges[8:12], schema), 2)  # a replay changes nothing
    assert job.done() == 3
    late = SlidingPPR(vertices, [0], slide, str(tmp_path / "late"), epsilon=1e-6)
    for chunk, (a, b, done) in enumerate([(6, 12, -1), (3, 6, -1), (0, 3, 3)]):  # nothing runs over a gap
        late.process(spark.createDataFrame(edges[a:b], schema), chunk)
        assert late.done() == done
    assert all(abs({r.id: r.p for r in late.state(3).collect()}[i] - want[i]) <= 2e-6 for i in range(4))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as Fake

    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://x:7077", False)):
        made = []
        fake = Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append))
        if fine:
            assert shared_dir(fake).startswith("file:///") and made
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared_dir(fake)
