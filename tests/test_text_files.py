"""Per-frame text that is read in pieces, and one file per structure."""

import os

import pytest
from pyspark.sql import functions as F

from tauframe.sources import readers, sinks


@pytest.fixture
def small_pieces(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_frames_keep_their_order_in_pieces(spark, tmp_path, small_pieces):
    rows = [(t, f, t + f / 7, -f * 1e-300) for t, n in ((0, 200), (3, 1), (12, 90)) for f in range(n)]
    df = spark.createDataFrame(rows, "traj_id bigint, frame bigint, a double, b double").repartition(6)
    for parts in (1, 5):
        path = sinks.write_frame_text(df, ["a", "b"], str(tmp_path / f"t{parts}"), parts=parts)
        back = readers.read_frame_text(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert sorted((r.traj_id, r.frame, *r.m) for r in back.collect()) == rows
    assert {r.traj_id for r in readers.list_trajectories(spark, path, "*.txt").collect()} == {0, 3, 12}
    with pytest.raises(Exception, match="NULL"):
        sinks.write_frame_text(df.selectExpr("traj_id", "frame", "nullif(a, 0) AS a"), ["a"], str(tmp_path / "bad"))


def text_files(path):
    return [f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".txt")]


def test_many_trajectories_need_few_files(spark, tmp_path, small_pieces):
    rows = [(t, f, t + f / 7) for t in range(-3, 400) for f in range(1 + t % 4)]
    df = spark.createDataFrame(rows, "traj_id bigint, frame bigint, a double").repartition(6)
    path = sinks.write_frame_text(df, ["a"], str(tmp_path / "t"), parts=3)
    assert len(text_files(path)) <= 3
    back = readers.read_frame_text(spark, path)
    assert "Broadcast" not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.traj_id, r.frame, *r.m) for r in back.collect()) == rows
    listed = readers.list_trajectories(spark, path, "*.txt").select("traj_id").distinct().collect()
    assert {r.traj_id for r in listed} == set(range(-3, 400))
    with pytest.raises(Exception, match="NULL"):
        sinks.write_frame_text(df.selectExpr("nullif(traj_id, 7) AS traj_id", "frame", "a"), ["a"], str(tmp_path / "bad"))


def test_files_do_not_grow_with_trajectories(spark, tmp_path):
    made = []
    for n in (20, 200):
        df = spark.range(n).selectExpr("id AS traj_id", "explode(sequence(0L, 1L)) AS frame").withColumn("psi", F.col("frame") / 3)
        path = sinks.write_frame_text(df, ["psi", "psi"], str(tmp_path / f"n{n}"), parts=7)
        made.append(len(text_files(path)))
        back = readers.read_frame_text(spark, path)
        assert sorted((r.traj_id, r.frame, *r.m) for r in back.collect()) == [(t, f, f / 3, f / 3) for t in range(n) for f in (0, 1)]
    assert max(made) <= 7


def test_a_folder_per_trajectory(spark, tmp_path, small_pieces):
    rows = [(t, f, t + f / 7) for t, n in ((0, 60), (3, 1), (12, 40)) for f in range(n)]
    df = spark.createDataFrame(rows, "traj_id bigint, frame bigint, a double")
    path = sinks.write_frame_text(df, ["a"], str(tmp_path / "t"), parts=2, folders=True)
    assert {f for f in os.listdir(path) if f.startswith("traj_id=")} == {"traj_id=0", "traj_id=3", "traj_id=12"}
    assert sorted((r.traj_id, r.frame, *r.m) for r in readers.read_frame_text(spark, path).collect()) == rows
    assert {r.traj_id for r in readers.list_trajectories(spark, path, "*.txt").collect()} == {0, 3, 12}


def test_lines_that_cannot_be_numbered_are_errors(spark, tmp_path):
    for name, lines, message in (("mixed", ["1: 0.5", "2: 0.5", "1: 0.25"], "mixed"), ("bare", ["1 0.5"], "name its")):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / name))
        with pytest.raises(Exception, match=message):
            readers.read_frame_text(spark, str(tmp_path / name)).collect()


def test_plain_files_are_numbered_by_name(spark, tmp_path, small_pieces):
    for n, lines in (("run2.txt", 120), ("run10.txt", 40)):
        (tmp_path / n).write_text("# psi phi\n" + "\n".join(f" {k}  {k / 2} " + ("\n" if k % 9 == 0 else "") for k in range(lines)))
    got = sorted((r.traj_id, r.frame, *r.m) for r in readers.read_frame_text(spark, str(tmp_path)).collect())
    assert got == [(2, k, k, k / 2) for k in range(120)] + [(10, k, k, k / 2) for k in range(40)]


def test_one_file_per_structure(spark, tmp_path):
    named = spark.createDataFrame([(f"m{k}.pdb", [float(k * 100 + c) for c in range(36)]) for k in range(5)],
                                  "output_filename string, xyz array<double>")
    topology = spark.createDataFrame([(s, f"A{s}", "MOL", 1) for s in range(1, 13)],
                                     "serial int, name string, resname string, resid int")
    path = sinks.write_structures(named, topology, str(tmp_path / "s"))
    folders = [f for f in os.listdir(path) if f.startswith("output_filename=")]
    assert len(folders) == 5
    for folder in folders:
        files = [f for f in os.listdir(f"{path}/{folder}") if f.endswith(".txt")]
        assert len(files) == 1
        with open(f"{path}/{folder}/{files[0]}") as text:
            assert [int(line[6:11]) for line in text] == list(range(1, 13))
    back = readers.read_topology(spark, path, ["output_filename"]).collect()
    assert {(r.output_filename, r.serial, r.x, r.y, r.z) for r in back} == {
        (f"m{k}.pdb", s + 1, *[float(k * 100 + 3 * s + c) for c in range(3)]) for k in range(5) for s in range(12)}
    with pytest.raises(Exception, match="exist"):
        sinks.write_structures(named, topology, path)
