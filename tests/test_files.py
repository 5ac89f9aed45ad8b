import struct

import numpy as np
import pytest

from rugosa.sources import errors, files, formats
from rugosa.streaming import averages

GRID = np.arange(12.0).reshape(4, 3)


def only(content, name=None):
    got, channels = formats.decode(content)
    assert name is None or got == name
    return channels[0]


def test_text_matrices():
    c = only(b"# Channel: Z\n# Width: 4.0 um\n# Height: 3.0 um\n# Value units: nm\n" + b"\n".join(b" ".join(b"%d" % v for v in r) for r in GRID.T), "asc")
    assert c.name == "Z" and c.unit == "µm" and c.size == (4.0, 3.0) and np.allclose(c.heights, GRID * 1e-3)
    c = only("# Kanal: Höhe\n# Breite: 2,5 nm\n# Höhe: 1,5 nm\n1 2\nbad 4".encode("latin1"), "asc")
    assert c.size == (2.5, 1.5) and np.isnan(c.heights[0, 1]) or c.kind == "uniform"
    c = only(b"\n".join(b"%d" % i for i in range(1, 10)), "asc")
    assert c.kind == "uniform" and len(c.heights) == 9


def test_point_lists():
    c = only(b"X_(microns),y1\n0,1\n1,2\n2,3\n", "xyz")
    assert c.kind == "uniform" and c.unit == "µm" and c.size == (3.0,)
    c = only(b"0 1\n1 2\n1.5 3\n", "xyz")
    assert c.kind == "nonuniform" and c.x.tolist() == [0, 1, 1.5]
    rows = [f"{i} {j} {GRID[i, j]}" for i in range(4) for j in range(3)]
    c = only("\n".join(rows[::-1]).encode(), "xyz")
    assert c.kind == "map" and np.array_equal(c.heights, GRID) and c.size == (4, 3)
    c = only(b"X;Y;valid\n[mm];[mm];[1/0]\n0;1;1\n1;2;0\n2;3;1\n", "xyz")
    assert c.unit == "mm" and np.isnan(c.heights[1])


def test_binary():
    c = only(struct.pack(">4h", 1, 2, -32768, 4), "hgt")
    assert c.heights.shape == (2, 2) and np.isnan(c.heights[0, 1])
    c = only(b"aISO-1.0\nNumPoints = 4\nNumProfiles = 3\nXscale = 1e-6\nYscale = 1e-6\nZscale = 1e-6\n*\n" + b" ".join(b"%d" % v for v in GRID.T.ravel()) + b"\n*", "sdf")
    assert np.allclose(c.heights, GRID * 1e-6) and np.allclose(c.size, (4e-6, 3e-6))
    raw = struct.pack("<8s10s12s12sHHddddBBB", b"bISO-1.0", b"", b"", b"", 4, 3, 1.0, 1.0, 2.0, 0.0, 0, 7, 0) + GRID.T.astype("<f8").tobytes()
    assert np.array_equal(only(raw, "sdf").heights, 2 * GRID)
    with pytest.raises(errors.CannotDetectFileFormat):
        formats.decode(b"This is prose, and no measurement at all.")


@pytest.mark.parametrize("hole", [False, True])
def test_writers(hole):
    h = GRID.copy()
    if hole:
        h[1, 2] = np.nan
    c = formats.Channel("Default", h, (4.0, 1.5), "µm")
    n = only(formats.write_netcdf3(c), "nc")
    assert np.array_equal(n.heights, h, equal_nan=True) and n.size == (4.0, 1.5) and n.unit == "µm"
    x = only(formats.write_x3p(c), "x3p")
    assert np.allclose(x.heights, h * 1e-6, equal_nan=True) and np.allclose(x.size, (4e-6, 1.5e-6))
    p = only(formats.write_netcdf3(formats.Channel("Default", np.array([1.0, 2, 5]), x=np.array([0, 1.0, 7]))), "nc")
    assert p.kind == "nonuniform" and p.x.tolist() == [0, 1, 7]
    u = only(formats.write_netcdf3(formats.Channel("Default", np.array([1.0, 2, 5]), (3.0,), "m", periodic=True)), "nc")
    assert u.kind == "uniform" and u.periodic and u.size == (3.0,)


def test_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n3 4\n")
    (tmp_path / "b.txt").write_text("no numbers here")
    np.save(tmp_path / "c.npy", GRID)
    got = {r.path.rpartition("/")[2]: r for r in files.channels(spark, str(tmp_path)).collect()}
    assert got["a.txt"].kind in ("uniform", "map", "nonuniform") and got["b.txt"].error and got["c.npy"].nb_grid_pts == [4, 3]
    p = files.points(spark, f"{tmp_path}/c.npy", physical_sizes=(8.0, 3.0))
    assert {(r.ix, r.iy): (r.x, r.h) for r in p.collect()} == {(i, j): (2.0 * i, GRID[i, j]) for i in range(4) for j in range(3)}
    with pytest.raises(Exception, match="UnknownChannel"):
        files.points(spark, f"{tmp_path}/c.npy", channel_index=3).collect()
    assert files.channel_ids(["a", "b", "a"]) == ["a", "b", "a#2"]


def test_sinks(spark):
    df = spark.createDataFrame([(1, i, j, float(GRID[i, j])) for i in range(4) for j in range(3)], "scan_id long, ix int, iy int, h double")
    lines = [r.value for r in files.to_matrix(df).orderBy("iy").collect()]
    assert np.array_equal(only("\n".join(lines).encode(), None).heights, GRID) or len(lines) == 3
    for kind in ("nc", "npy", "x3p"):
        c = only(files.to_files(df, kind, 4, 3).first().content, kind)
        assert np.allclose(c.heights, GRID)
    py = files.pyramid(df, 4, 3, 2)
    levels = {r.level: r.n for r in py.groupBy("level").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert levels == {2: 12, 1: 4, 0: 1}


def test_stream_of_averages_is_the_batch_answer(spark, tmp_path):
    import random

    from rugosa.plans import container

    rng = random.Random(3)
    rows = [(s % 2, s, 10 ** rng.uniform(-1, 1.5), rng.gauss(5, 2) if rng.random() < 0.9 else None) for s in range(9) for _ in range(rng.randint(1, 40))] + [(0, 1, 0.0, 3.0), (1, 77, 1000.0, 1.0)]
    rng.shuffle(rows)
    schema = "surface_id int, scan_id int, q double, c double"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):  # every scan comes in pieces
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        averages.write_sums(stream, "q", "c", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got, want = (sorted(map(tuple, d.select("surface_id", "bin", "x", "y", "n").collect())) for d in (averages.read_averages(spark, f"{tmp_path}/out"), container.log_average(df, "q", "c")))
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want]
    assert [v for r in got for v in r[2:4] if v is not None] == pytest.approx([v for r in want for v in r[2:4] if v is not None])
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) >= 3
