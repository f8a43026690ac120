"""Readers and writers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauframe.functions import numbers
from tauframe.operators import series
from tauframe.session import scratch_path, shared_dir
from tauframe.sources import readers, sinks

# Two records of a published example topology, then things that are not atoms.
PDB = """TITLE     Protein
ATOM      1 1HH3 ACE     1      16.940  24.140  14.780  1.00  0.00
ATOM      2  CH3 ACE     1      15.960  24.600  14.910  1.00  0.00
TER
ENDMDL
"""


def test_index_list(spark, tmp_path):
    (tmp_path / "a.dat").write_text("2 5 6\n\n 5   11\n")
    rows = sorted(r.atom for r in readers.read_index_list(spark, str(tmp_path / "a.dat")).collect())
    assert rows == [1, 4, 5, 10]


def test_topology(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    rows = readers.read_topology(spark, str(tmp_path / "a.pdb")).orderBy("serial").collect()
    assert tuple(rows[1]) == (2, "CH3", "ACE", 1, 15.96, 24.6, 14.91) and len(rows) == 2


def test_trajectory_order_ignores_parent_folders(spark, tmp_path):
    folder = tmp_path / "run7"
    folder.mkdir()
    for k in (10, 9, 2):
        np.save(folder / f"traj{k}.npy", np.full((k, 2), k))
    rows = readers.list_trajectories(spark, str(folder), "*.npy").orderBy("traj_id").collect()
    assert [r.traj_id for r in rows] == [2, 9, 10]
    x = readers.read_arrays(spark, str(folder))
    assert x.count() == 21
    assert x.where("traj_id = 9 and frame = 8").first().x == [9.0, 9.0]


def test_matrix_text_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    m = rng.random((12, 9)) * 10.0 ** rng.integers(-12, 3, (12, 9))
    flat = spark.createDataFrame([(k, m[k].tolist()) for k in range(12)], "k int, m array<double>")
    path = sinks.write_matrix_text(flat, str(tmp_path / "m"))
    back = readers.read_matrix_series(spark, path).orderBy("k").collect()
    assert [r.k for r in back] == list(range(12))
    assert np.array_equal(np.array([r.m for r in back]), m)
    text = next((tmp_path / "m").glob("part*")).read_text().splitlines()
    assert np.array_equal(np.loadtxt(text), m)


def test_numpy_text_is_read(spark, tmp_path):
    m = np.arange(8.0).reshape(2, 4) / 3
    np.savetxt(tmp_path / "m.txt", m, header="a comment")
    back = readers.read_matrix_rows(spark, str(tmp_path / "m.txt")).orderBy("line").collect()
    assert np.array_equal(np.array([r.m for r in back]), m)


def test_ingest_checks(spark):
    flat = spark.createDataFrame([(k, [1.0, 0.0, 0.0, 1.0]) for k in range(5)], "k int, m array<double>")
    assert series.unflatten(readers.ingest_series(flat, 5, 2)).count() == 20
    with pytest.raises(TypeError):
        readers.ingest_series(np.eye(2), 5, 2)
    with pytest.raises(ValueError):
        readers.ingest_series(flat.withColumn("m", F.lit(1.0)), 5, 2)
    with pytest.raises(Exception, match="n_lags"):
        readers.ingest_series(flat, 6, 2).collect()
    with pytest.raises(Exception, match="dimension"):
        readers.ingest_series(flat, 5, 3).collect()


def test_write_new_refuses_existing(spark, tmp_path):
    path = sinks.write_new(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_new(spark.range(3), path)
    sinks.overwrite(spark.range(5), path)
    assert readers.read_rows(spark, path).count() == 5


def test_general_number(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1.0, -1.5, 100000.0, 999999.5, 1e6, 1234567.0, 0.0001, 0.00001234, -2e-10, 1e300,
              123456.789, 0.1 + 0.2, 99999.95, float("inf"), -float("inf"), float("nan"), None, 1.7976931348623157e308,
              5e-324, 1e-323, 2.5e-322, 2.225073858507201e-308, 2.2250738585072014e-308]
    values += (rng.normal(size=60) * 10.0 ** rng.integers(-9, 12, 60)).tolist()
    # ties of six digits by their shortest form, of every size, and exact ones
    values += [float(f"{k}5e{e}") for k, e in zip(rng.integers(10**5, 10**6, 300), rng.integers(-330, 300, 300))]
    values += [k + 0.5 for k in (100000, 100001, 123456, 999999)] + [k / 2**7 for k in rng.integers(1, 10**7, 60).tolist()]
    values += [k * 5e-324 for k in rng.integers(1, 2**50, 40).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", numbers.general("v").alias("s")).collect():
        assert r.s == (None if r.v is None else "%g" % r.v)
    assert "Python" not in df.select(numbers.general("v"))._jdf.queryExecution().toString()


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([(10, 1.23456789)], "lag_time int, timescale_0 double")
    sinks.write_tsv(df, str(tmp_path / "t"), general=True)
    text = {line for p in (tmp_path / "t").glob("part*") for line in p.read_text().splitlines()}
    assert text == {"lag_time\ttimescale_0", "10\t1.23457"}


def test_pdb_lines(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    top = readers.read_topology(spark, str(tmp_path / "a.pdb"))
    xyz = spark.createDataFrame([("m.pdb", [16.94, 24.14, 14.78, 15.96, 24.6, 14.91])],
                                "output_filename string, xyz array<double>")
    out = tmp_path / "b.pdb"
    lines = [r.line for r in sinks.pdb_lines(xyz, top).orderBy("serial").collect()]
    out.write_text("\n".join(lines))
    again = readers.read_topology(spark, str(out)).orderBy("serial").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in top.orderBy("serial").collect()]


def test_choices_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(b, t, 1) for b in range(3) for t in range(4)],
                               "boot_id int, traj_id int, weight bigint")
    sinks.write_choices(df, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("boot_id=*")) == [f"boot_id={b}" for b in range(3)]


def test_shared_dir_prefers_the_cluster_setting(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "/shared/x"}.get(key, default)

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "/shared/x"
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_text_writers_refuse_an_existing_target(spark, tmp_path):
    flat = spark.createDataFrame([(0, [1.0, 2.0])], "k int, m array<double>")
    draws = spark.createDataFrame([(0, 1, 1)], "boot_id int, traj_id int, weight bigint")
    for name, write, df in (("t", sinks.write_tsv, draws), ("m", sinks.write_matrix_text, flat),
                            ("c", sinks.write_choices, draws)):
        write(df, str(tmp_path / name))
        with pytest.raises(Exception, match="already exists"):
            write(df, str(tmp_path / name))
        write(df, str(tmp_path / name), mode="overwrite")
