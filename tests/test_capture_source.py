"""The capture data source and the SQL functions."""

import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from waveledger.functions.register import register
from waveledger.plans import captures
from waveledger.sources import capture, dispatch, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All four formats, and files that are empty, cut, of another kind or without extension."""
    root = tmp_path_factory.mktemp("captures")
    for kind in (captures.scope_files(spark, SF, faulty=True), captures.wav_files(spark, SF),
                 captures.deep_memory_files(spark, SF), captures.csv_files(spark, SF)):
        files.write_contents(kind.select("path", F.col("content").cast("binary").alias("content")), str(root))
    (root / "odd").mkdir()
    with wave.open(str(root / "odd" / "stereo.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(np.arange(-1000, 1000, dtype="<i2").tobytes())
    data = (root / "odd" / "stereo.wav").read_bytes()
    (root / "odd" / "sniffed").write_bytes(data)
    (root / "odd" / "cut.wav").write_bytes(data[:-700])
    (root / "odd" / "empty.csv").write_bytes(b"")
    (root / "odd" / "empty.wfm").write_bytes(b"")
    (root / "odd" / "note.txt").write_text("hello")
    (root / "odd" / "fine.csv").write_text("CH1(V),CH2(V),t0 = 0s, tInc = 2ms\n" + "".join(f"{k},x\n" for k in range(50)))
    (root / "odd" / "screen.csv").write_text("Time(s),CH1(V)\n" + "".join(f"{k / 4},{k}\n" for k in range(20)) + "\n")
    return str(root)


def table(df):
    return sorted(((r.path, r.channel, r.start_sample, r.fs, None if r.samples is None else tuple(
        None if x is None else round(x, 6) for x in r.samples), r.error is not None) for r in df.collect()), key=str)


def source(spark, folder, **options):
    capture.register(spark)
    return spark.read.format("capture").options(**options).load(folder)


@pytest.mark.parametrize("span", [{}, {"offset_s": 1.0, "duration_s": 2.0}, {"offset_s": 3.0}])
def test_source_equals_the_readers(spark, folder, span):
    got = table(source(spark, folder, chunk=16, **span))
    want = table(dispatch.read_waveforms(files.listing(spark, folder), chunk=16, **span))
    assert got == want
    assert {r[0] for r in got} == {r.path for r in files.listing(spark, folder).collect()}


def test_large_files_are_read_in_parts(spark, folder):
    whole, parts = source(spark, folder, chunk=7), source(spark, folder, chunk=7, part_bytes=500)
    assert table(whole) == table(parts)
    assert parts.rdd.getNumPartitions() > whole.rdd.getNumPartitions()


def test_modes(spark, folder):
    df = source(spark, folder, mode="mono", chunk=1000).where("path like '%stereo.wav'")
    assert [(r.channel, len(r.samples)) for r in df.collect()] == [("mono", 1000)]


def test_pruned_files_are_not_opened(folder, monkeypatch):
    opened = []
    kept = capture.open_input
    monkeypatch.setattr(capture, "open_input", lambda p: opened.append(p) or kept(p))

    def read(*filters):
        opened.clear()
        reader = capture.CaptureReader({"path": folder})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # all are tested again
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return rows, set(opened)

    one = f"{folder}/odd/stereo.wav"
    for f in (EqualTo(("path",), one), In(("path",), (one, "elsewhere")), StringEndsWith(("path",), "odd/stereo.wav")):
        rows, seen = read(f)
        assert seen == {one} and {r["channel"] for r in rows} == {"ch0", "ch1"}
    rows, seen = read(StringStartsWith(("path",), f"{folder}/odd/"))
    assert len(seen) == 8 and all(p.startswith(f"{folder}/odd/") for p in seen)
    rows, _ = read(EqualTo(("path",), one), EqualTo(("channel",), "ch1"))
    assert {r["channel"] for r in rows} == {"ch1"}
    assert read(EqualTo(("path",), "nowhere")) == ([], set())


def test_filters_through_spark(spark, folder):
    df = source(spark, folder, chunk=64)
    every = table(df)
    assert table(df.where("channel = 'CH2(V)'")) == [r for r in every if r[1] == "CH2(V)"] != []
    assert table(df.where("error is not null")) == [r for r in every if r[5]]
    assert df.where("path = 'nowhere'").count() == 0


def test_sql_view(spark, folder):
    capture.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW caps USING capture OPTIONS (path '{folder}', duration_s '1')")
    got = spark.sql("SELECT count(*) AS n FROM caps WHERE channel = 'ch0' AND path LIKE '%stereo.wav' AND size(samples) = 100").first()
    assert got.n == 1


def test_folder_is_needed(spark):
    capture.register(spark)
    with pytest.raises(Exception, match="folder"):
        spark.read.format("capture").load().count()


def test_cut_capture_of_wider_samples(tmp_path, spark):
    """A bare scope file with a magic that is none."""
    (tmp_path / "x.bin").write_bytes(struct.pack("<4sii", b"none", 1, 1))
    assert [r.error for r in source(spark, str(tmp_path)).collect()] == ["not a scope capture"]


# ---- SQL functions

def test_windows_of(spark):
    register(spark)
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW arrays AS SELECT 1 AS id, array(1D, 2D, 3D, 4D, 5D) AS x
                 UNION ALL SELECT 2, array(1D) UNION ALL SELECT 3, NULL UNION ALL SELECT 4, array(0D, NULL, 2D)""")
    got = spark.sql("SELECT id, segment_index, start_sample, segment FROM arrays, LATERAL windows_of(x, 3, 2) ORDER BY id, 2").collect()
    assert [(r.id, r.segment_index, r.start_sample, r.segment) for r in got] == [
        (1, 0, 0, [1.0, 2.0, 3.0]), (1, 1, 2, [3.0, 4.0, 5.0]), (4, 0, 0, [0.0, None, 2.0])]


def test_lateral_features_run_no_python(spark):
    register(spark)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=40).tolist()) for k in range(20)] + [(99, [2.0] * 16)]
    spark.createDataFrame(rows, "id long, x array<double>").createOrReplaceTempView("many")
    df = spark.sql("SELECT id, segment_index, f.* FROM many, LATERAL windows_of(x, 16, 8) w, LATERAL window_features(w.segment) f")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
    values = dict(rows)
    for r in df.collect():
        x = np.array(values[r.id][r.segment_index * 8:r.segment_index * 8 + 16])
        d = x - x.mean()
        assert r.n == 16 and r.mean == pytest.approx(x.mean()) and r.rms == pytest.approx(x.std(), abs=1e-12)
        assert r.peak_to_peak == pytest.approx(np.ptp(x))
        if r.id == 99:
            assert r.crest is None and r.kurtosis is None
        else:
            assert r.crest == pytest.approx(np.abs(d).max() / d.std()) if abs(d.max()) >= abs(d.min()) else math.isfinite(r.crest)
            assert r.kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2)


@pytest.mark.parametrize("votes,want", [([2.0, 1.0, 2.0, 1.0, 3.0], 1.0), ([5.0], 5.0), ([None, 4.0, None], 4.0), ([], None), (None, None)])
def test_majority(spark, votes, want):
    register(spark)
    assert spark.createDataFrame([(votes,)], "v array<double>").selectExpr("majority(v) AS m").first().m == want
