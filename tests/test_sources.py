import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from radonframe.operators import events as ev
from radonframe.plans import fixtures
from radonframe.sources import imaging, listmode, projections, ranges
from radonframe.streaming import listmode as stream

HEADER = {
    "model_name": None, "detectors": [{"id": k, "x": float(k), "y": 1.0, "z": -2.5} for k in range(3)], "tof_bin_edges": [-1.0, 0.0, 1.0], "tof_resolution": 0.5,
    "energy_bin_edges": [430.0, 650.0], "energy_resolution_at_511": 0.125, "block_duration_ms": 1000,
    "exam": {"subject_name": None, "subject_id": "a", "institution": "b", "address": "é", "protocol": "p", "start_ns": -5},
}


def test_varints():
    v = np.array([0, 1, 127, 128, 300, 2**31, 2**56 - 1, 2**63], np.uint64)
    assert (listmode.from_varints(listmode.to_varints(v)) == v).all()
    many = np.random.default_rng(0).integers(0, 2**40, 1000).astype(np.uint64)
    assert (listmode.from_varints(listmode.to_varints(many)) == many).all()


def test_listmode_binary_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame(rng.integers(0, 400, (500, 5)), columns=list(listmode.FIELDS)).assign(block=rng.integers(0, 7, 500), delayed=rng.random(500) < 0.2)
    events = spark.createDataFrame(rows)
    done = listmode.write_binary(events, f"file://{tmp_path}/bin", HEADER, "schema").collect()
    assert sum(r["events"] for r in done) == 500
    back = listmode.read_binary(spark, f"{tmp_path}/bin").drop("file").select(events.columns)
    assert back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0
    assert {r["block"] for r in listmode.read_binary(spark, f"{tmp_path}/bin", [2, 3]).select("block").distinct().collect()} == {2, 3}
    data = open(f"{tmp_path}/bin/{done[0]['file'].rsplit('/', 1)[1]}", "rb").read()
    assert listmode.opened(data)[0] == HEADER
    heads = listmode.read_headers(spark, f"{tmp_path}/bin").select("detector_id", "x", "bins").distinct().orderBy("detector_id").collect()
    assert [tuple(r) for r in heads] == [(0, 0.0, 2), (1, 1.0, 2), (2, 2.0, 2)]


def test_listmode_json_round_trip(spark, tmp_path):
    events = spark.createDataFrame([(1, False, 1, 2, 3, 4, 5), (1, True, 5, 4, 3, 2, 1), (2, False, 9, 9, 0, 0, 0)], "block long, delayed boolean, detector_1 long, detector_2 long, tof long, energy_1 long, energy_2 long")
    listmode.to_ndjson(events).write.text(f"{tmp_path}/json")
    assert sorted(listmode.read_ndjson(spark, f"{tmp_path}/json").collect()) == sorted(events.collect())


def test_raw_volume_round_trip(spark, tmp_path):
    v = np.arange(24, dtype="<f4").reshape(2, 3, 4)  # z, y, x
    (tmp_path / "v.raw").write_bytes(v.tobytes())
    rows = imaging.read_raw(spark, f"{tmp_path}/v.raw", (4, 3, 2))
    assert {(r["x"], r["y"], r["z"]): r["value"] for r in rows.collect()} == {(x, y, z): float(v[z, y, x]) for x in range(4) for y in range(3) for z in range(2)}
    files = {r["z"]: r["file"] for r in imaging.write_raw(rows, f"{tmp_path}/out", (4, 3, 2)).collect()}
    assert all((np.fromfile(files[z], "<f4").reshape(3, 4) == v[z]).all() for z in (0, 1))


def test_header_collimators_and_materials(spark, tmp_path):
    (tmp_path / "h").write_text("!INTERFILE :=\n!matrix size [1] := 128\n;scaling factor (mm/pixel) [1] := 4.8\nnothing here\n")
    head = imaging.read_header(spark, f"{tmp_path}/h")
    assert imaging.header_value(head, r"matrix size", "int").first()["values"] == [128]
    assert imaging.header_value(head, "absent").count() == 0
    (tmp_path / "c").write_text("text\n*ab-x 0.1 0.02 3.5 1\n*cd 0.2 0.03 4 1\n")
    assert imaging.read_collimators(spark, f"{tmp_path}/c", "ab").collect() == [("ab-x", 0.1, 0.02, 3.5)]
    (tmp_path / "m").write_text("2.0 density\n0.01 5 4\n0.1 0.5 0.4\n1 0.1 0.1\n")
    assert [(round(r["energy"], 6), r["mu"]) for r in imaging.read_material(spark, f"{tmp_path}/m").collect()] == [(100.0, 1.0)]


def test_stream_histogram_equals_batch(spark, sf_dir, tmp_path):
    rows = fixtures.listmode(spark, sf_dir)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    live = stream.stream_histogram(stream.stream_events(spark, f"{tmp_path}/in", rows.schema, 1), fixtures.SCANNER)
    got = stream.run_once(live, "running", f"{tmp_path}/checkpoint")
    want = ev.histogram(rows, fixtures.SCANNER).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_count_rates(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.write.parquet(f"{tmp_path}/in")
    got = stream.run_once(stream.count_rates(stream.stream_events(spark, f"{tmp_path}/in", rows.schema), "1 day", "2 days"), "rates", f"{tmp_path}/checkpoint")
    assert got.agg(F.sum("n")).first()[0] == rows.count()


def test_simulated_projections(spark, tmp_path):
    v = np.arange(2 * 3 * 4, dtype="<f4").reshape(2, 3, 4)  # image, row, column
    (tmp_path / "p.bin").write_bytes(v.tobytes())
    (tmp_path / "p.h").write_text(
        "!INTERFILE :=\n!name of data file := p.bin\n!matrix size [1] := 4\n!matrix size [2] := 3\n!total number of images := 2\n!number format := short float\n!number of bytes per pixel := 4\n"
        "!number of projections := 4\n!extent of rotation := 360\nstart angle := 30\n!direction of rotation := CW\n;Radius := 250\nenergy window lower level := 187.2\nenergy window upper level := 228.8\n"
    )
    rows = {(r["a"], r["r"], r["z"]): r["value"] for r in projections.read_simulated(spark, f"{tmp_path}/p.h").collect()}
    assert rows == {(a, r, z): float(v[a, 2 - z, r]) for a in range(2) for r in range(4) for z in range(3)}
    views = projections.simulated_views(spark, f"{tmp_path}/p.h", 0.1).orderBy("a").collect()
    assert [r["angle"] for r in views] == [30.0, 300.0, 210.0, 120.0] and {r["radius"] for r in views} == {25.0}
    window = projections.windows_of(imaging.read_header(spark, f"{tmp_path}/p.h")).first()
    assert (window["lower"], window["upper"]) == (187.2, 228.8) and abs(window["width"] - 41.6) < 1e-9


def test_simulated_attenuation(spark, tmp_path):
    v = np.random.default_rng(0).random((2, 3, 4)).astype("<f4")  # z, y, x
    (tmp_path / "m.bin").write_bytes(v.tobytes())
    (tmp_path / "m.h").write_text("!name of data file := m.bin\n!matrix size [1] := 4\n!matrix size [2] := 3\n!matrix size [3] := 2\n")
    for castor in (False, True):
        got = {(r["x"], r["y"], r["z"]): r["value"] for r in projections.read_simulated_attenuation(spark, f"{tmp_path}/m.h", castor).collect()}
        assert got == {(x, y, z): float(v[1 - z, 2 - y if castor else y, x]) for x in range(4) for y in range(3) for z in range(2)}


def test_ranges_of_a_raw_file_are_tasks(spark, tmp_path):
    v = np.arange(50 * 6, dtype="<i2").reshape(50, 2, 3)
    (tmp_path / "v.raw").write_bytes(b"head" + v.tobytes())
    rows = ranges.read_planes(spark, f"{tmp_path}/v.raw", 2, 3, "<i2", skip=4, range_bytes=40).collect()
    assert {(r["plane"], r["row"], r["column"]): r["value"] for r in rows} == {(p, y, x): float(v[p, y, x]) for p in range(50) for y in range(2) for x in range(3)}


def test_views_of_detectors_and_metadata(spark):
    rotations = spark.createDataFrame([(1, 3, 0.0, 60.0, "CW", [100.0, 110.0, 120.0], [1.0, 2.0, 3.0])], "detector int, views int, start double, step double, direction string, radial array<double>, offsets array<double>")
    rows = [(r["view"], r["a"], r["angle"], r["radius"]) for r in projections.views(rotations).orderBy("view").collect()]
    assert [r[:3] for r in rows] == [(0, 2, 180.0), (1, 1, 120.0), (2, 0, 60.0)] and np.allclose([r[3] for r in rows], [10.1, 11.2, 12.3])
    frames = spark.createDataFrame([(k, 0, 0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]) for k in range(3)], "frame int, window int, slot int, pixels array<array<double>>")
    meta = projections.metadata(frames, (4.8, 4.4)).first()
    assert (meta["nr"], meta["nz"], meta["nx"], meta["ny"]) == (3, 2, 3, 3) and np.allclose([meta["dr"], meta["dz"]], [0.48, 0.44])
    counts = projections.projections(frames, rotations)
    assert counts.filter("a = 0 and r = 2 and z = 0").first()["value"] == 6.0 and projections.chosen(counts, window=1).count() == 0


def test_binary_files_hold_whole_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(b), bool(rng.integers(2)), *map(int, rng.integers(0, 3, 5))) for b in range(12) for _ in range(int(rng.integers(1, 9)))]
    names = "block long, delayed boolean, detector_1 long, detector_2 long, tof long, energy_1 long, energy_2 long"
    events = spark.createDataFrame(rows, names).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    files = listmode.write_binary(events, f"{tmp_path}/out", HEADER, file_events=6).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(files) > 4 and sum(r["events"] for r in files) == len(rows)
    back = listmode.read_binary(spark, f"{tmp_path}/out")
    assert back.groupBy("block").agg(F.countDistinct("file").alias("n")).filter("n > 1").count() == 0
    assert sorted(map(tuple, back.drop("file").collect())) == sorted(rows)
