"""Catalog, manifest, splits, votes, sources, sinks and streaming on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveledger import fixed_values as fv
from waveledger.functions import scalars as sc
from waveledger.operators import catalog, manifest, quality, readings, scaling, splits, voting, windows
from waveledger.plans import captures
from waveledger.sources import deep_memory, dispatch, files, scope_bin, scope_csv, tables, wav
from waveledger.streaming import rolling


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,slug", [
    ("  Нормална Работа ", "normalna_rabota"), ("щъркел-2", "shtarkel_2"), ("ь!", "unknown"),
    ("A  b__C", "a_b_c"), ("", "unknown")])
def test_slug(spark, text, slug):
    assert one(spark, sc.slugify(F.lit(text))) == slug


@pytest.mark.parametrize("value,unit,text", [
    (0.00125, "V", "1.25 mV"), (1e6, "Sa/s", "1 MSa/s"), (0.0, "V", "0 V"), (-2500.0, "", "-2.5 k"),
    (12345.0, "Hz", "12.35 kHz"), (1e-20, "s", "1e-05 fs"), (float("inf"), "V", "inf V")])
def test_si_format(spark, value, unit, text):
    assert one(spark, sc.si_format(F.lit(value), unit)) == text


@pytest.mark.parametrize("text,seconds", [
    ("-25s", -25.0), ("2e-06s", 2e-6), ("500ms", 0.5), ("2us", 2e-6), ("3", 3.0), ("bad", None)])
def test_si_parse(spark, text, seconds):
    assert one(spark, sc.si_parse_seconds(F.lit(text))) == (
        None if seconds is None else pytest.approx(seconds))


def test_match_is_three_valued(spark):
    n = F.lit(None).cast("double")
    assert one(spark, sc.match_within(F.lit(1.0), n)) is None
    assert one(spark, sc.match_within(F.lit(1.0), F.lit(float("nan")))) is None
    assert one(spark, sc.match_within(n, F.lit(1.0))) is False
    assert one(spark, sc.match_within(F.lit(1.00004), F.lit(1.0), fv.QC_DURATION_TOLERANCE_S)) is True


def test_names(spark):
    assert one(spark, sc.setpoint_from_name(F.lit("a/b/ 65 % x.wav"))) == 65
    assert one(spark, sc.setpoint_from_name(F.lit("a/5/x65.wav"))) is None
    assert one(spark, sc.recording_file_name(F.lit(5), F.lit("current"), F.lit(".bin"))) == "speed005_current.bin"
    assert one(spark, sc.segment_key(F.lit("g"), F.lit(7))) == "g__seg007"
    assert one(spark, sc.path_problem(F.lit("a/../b"))) == "escapes root"
    assert one(spark, sc.path_problem(F.lit("a/b.WAV"), [".wav"])) is None


META = "condition string, operation string, reversal string, speed_percent int, sensor string, new_path string, duration_s double"


def meta_rows(spark, drop=()):
    rows = []
    for c, op in (("normal_no_reversal", "normal"), ("loose_no_reversal", "loose")):
        for s in (1, 2, 5, 10, 20):
            for m in fv.MODALITIES:
                if (c, s, m) not in drop:
                    rows.append((c, op, "no", s, m, f"data/{c}/{m}/speed{s:03d}_{m}.wav", 20.0 + s))
    return spark.createDataFrame(rows, META)


def test_pairing_and_spans(spark):
    meta = meta_rows(spark, drop={("normal_no_reversal", 5, "current")})
    paired = manifest.pair(meta, path="new_path")
    done = manifest.complete_pairs(paired)
    assert paired.count() == 10 and done.count() == 9
    assert "normal_no_reversal__5" not in {r.group_id for r in done.collect()}
    span = manifest.with_common_span(done, min_duration_s=22.0)
    assert {r.speed_percent for r in span.collect()} == {2, 5, 10, 20}
    n = span.select(windows.common_window_count(F.least("common_duration_s", F.lit(20.0)), 2.0, 0.5)
                    .alias("c")).distinct().collect()
    assert [r.c for r in n] == [19]
    mask = {r.group_id: r.has_current for r in manifest.modality_mask(paired).collect()}
    assert mask["normal_no_reversal__5"] == 0


def test_expected_setpoints_two_rules(spark):
    cond = spark.createDataFrame([("a", "normal"), ("b", "suboptimal_control")], "condition string, operation string")
    per = manifest.expected_setpoints(cond, fv.SENSORS)
    qc = manifest.expected_setpoints(cond, fv.SENSORS, per_sensor=False)
    got = {(r.condition, r.sensor): 0 for r in per.collect()}
    for r in per.collect():
        got[(r.condition, r.sensor)] += 1
    assert got[("a", "current")] == 13 and got[("a", "vibration")] == 11
    assert got[("b", "current")] == 10 and got[("b", "vibration")] == 8
    assert qc.count() == 4 * 13 + 4 * 10
    assert qc.where("condition = 'b' AND sensor = 'current'").agg(F.max("speed_percent")).first()[0] == 65


def test_contract(spark):
    meta = meta_rows(spark)
    only = meta.where("sensor = 'current'")
    conds = ["normal_no_reversal", "loose_no_reversal"]
    rules = {r.rule: r.violations for r in catalog.contract_violations(only, conds, "new_path").collect()}
    assert set(rules.values()) == {0}
    twice = only.unionByName(only.limit(1))
    rules = {r.rule: r.violations for r in catalog.contract_violations(twice, conds, "new_path").collect()}
    assert rules["repeated operating point"] == 1 and rules["repeated path"] == 1
    lone = catalog.contract_violations(only.select("sensor"), conds, "new_path").collect()
    assert {r.rule for r in lone} == {"missing column: condition", "missing column: speed_percent",
                                      "missing column: new_path"}
    with pytest.raises(Exception, match="contract broken"):
        catalog.require(catalog.contract_violations(twice, conds, "new_path")).collect()


def test_metadata_csv_round_trip(spark, tmp_path):
    path = tmp_path / "metadata.csv"
    path.write_text(",".join(fv.METADATA_COLUMNS) + "\n"
                    "normal_no_reversal,normal,no,5,current,bin,1000000,20.0,,,80000164,data/a.bin,5.bin,x/5.bin\n"
                    ",,,,scope_setup,stp,,,,,10,scope_setup/a.stp,a.stp,a.stp\n")
    rows = catalog.read_metadata(spark, str(path)).collect()
    assert rows[0].speed_percent == 5 and rows[1].condition is None and rows[1].duration_s is None
    kept = catalog.of_sensors(catalog.read_metadata(spark, str(path)), fv.SENSORS)
    assert kept.count() == 1


def test_unlisted_files_are_added(spark):
    meta = spark.createDataFrame([("c", "current", 5, "data/c/current/speed005_current.bin")],
                                 "condition string, sensor string, speed_percent int, new_path string")
    disk = spark.createDataFrame([("data/c/current/speed005_current.bin",),
                                  ("data/c/vibration/speed010_vibration.xls",)], "new_path string")
    extra = catalog.add_unlisted(meta, disk).where("sensor = 'vibration'").first()
    assert (extra.condition, extra.speed_percent) == ("c", 10)


def test_tree_listing(spark, tmp_path):
    folder = tmp_path / "нормална работа" / "без реверсиране" / "ток"
    folder.mkdir(parents=True)
    (folder / "10 %.bin").write_bytes(b"abc")
    (folder / "20 %.bin.part").write_bytes(b"")
    rows = {r.original_name: r for r in catalog.catalog_tree(catalog.list_files(spark, str(tmp_path))).collect()}
    good = rows["10 %.bin"]
    assert good.new_path == "data/normal_no_reversal/current/speed010_current.bin"
    assert good.file_size_bytes == 3 and good.skipped is None
    assert rows["20 %.bin.part"].skipped == "incomplete download"


def groups(spark, classes=8, per=10):
    return spark.createDataFrame([(f"c{c}__{g}", f"c{c}") for c in range(classes) for g in range(per)],
                                 "group_id string, condition string")


def test_folds_are_disjoint_complete_and_even(spark):
    rows = splits.stratified_group_folds(groups(spark), "group_id", "condition", 5).collect()
    assert len(rows) == len({r.group_id for r in rows}) == 80
    for c in range(8):
        counts = np.bincount([r.fold for r in rows if r.condition == f"c{c}"], minlength=5)
        assert list(counts) == [2] * 5
    again = splits.stratified_group_folds(groups(spark).repartition(3), "group_id", "condition", 5).collect()
    assert sorted(again) == sorted(rows)


def test_published_split_sizes(spark):
    df = spark.range(98).select(F.col("id").cast("string").alias("g"))
    got = {r.split: r["count"] for r in splits.group_shuffle_split(df, "g", 0.25, 0.15)
           .groupBy("split").count().collect()}
    assert got == {"test": 25, "val": 11, "train": 62}


def test_weights_add_up(spark):
    rows = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "g string")
    out = splits.group_weights(rows, "g").groupBy("g").agg(F.sum("group_weight").alias("s")).collect()
    assert {r.g: r.s for r in out} == {"a": pytest.approx(4.0), "b": pytest.approx(4.0)}


def test_leakage_is_reported(spark):
    rows = spark.createDataFrame([(1, "g1"), (2, "g1"), (3, "g2")], "id int, g string")
    folds = spark.createDataFrame([("g1", 0), ("g2", 1)], "g string, fold bigint")
    member = splits.fold_membership(rows, folds, "g", 2)
    assert member.count() == 6 and splits.leaked_groups(member, "g").count() == 0
    bad = splits.fold_membership(rows, folds.unionByName(spark.createDataFrame(
        [("g1", 1)], "g string, fold bigint")), "g", 2)
    assert splits.leaked_groups(bad, "g").count() == 2


def test_votes(spark):
    rows = spark.createDataFrame([("r", p) for p in (2, 1, 2, 1)], "g string, p int")
    assert voting.majority_vote(rows, ["g"], "p").first().predicted == 1
    probs = spark.createDataFrame([("r", [0.2, 0.8]), ("r", [0.8, 0.2])], "g string, p array<double>")
    assert voting.soft_vote(probs, ["g"], "p", ["x", "y"]).first().predicted == "x"


def test_pooling_without_any_modality(spark):
    t = spark.createDataFrame([(1, "a", 5.0, False, [1.0]), (1, "b", 1.0, False, [2.0]),
                               (2, "a", 5.0, True, [1.0]), (2, "b", 9.0, False, [2.0])],
                              "id int, modality string, logit double, present boolean, vector array<double>")
    weights, pooled = voting.masked_softmax_pool(t, "id")
    assert {r.id: r.value for r in pooled.collect()} == {1: 0.0, 2: 1.0}
    assert sum(r.weight for r in weights.collect() if r.id == 2) == pytest.approx(1.0)


def test_train_stats_fall_back_when_all_absent(spark):
    rows = spark.createDataFrame([("train", False, [1.0]), ("train", False, [3.0]), ("test", True, [9.0])],
                                 "split string, present boolean, v array<double>")
    row = scaling.train_stats(rows, "v", present="present").first()
    assert row["mean"] == 2.0 and row["std"] == pytest.approx(1.0 + 1e-6)


def test_modality_dropout_never_hides_all(spark):
    m = spark.range(500).select("id", *[F.lit(1).alias(f"has_{x}") for x in "ab"])
    rows = splits.modality_dropout(m, "id", ["a", "b"], 0.6, 3).collect()
    assert all(r.kept_a + r.kept_b > 0 for r in rows) and any(r.kept_a == 0 for r in rows)


def test_readings(spark):
    r = spark.createDataFrame([("x", " Velocity ", "1.5"), ("x", "Velocity", "bad"), ("x", "Other", "2"),
                               ("x", "Acceleration", "-1")], "recording_id string, quantity string, value string")
    rows = readings.clean(r).collect()
    assert {(q.quantity, q.value) for q in rows} == {("Velocity", 1.5), ("Acceleration", -1.0)}
    assert {(q.quantity, q.problem) for q in readings.rejected(r).collect()} == {
        ("Velocity", "not a number"), ("Acceleration", "negative")}
    with pytest.raises(Exception, match="invalid spot reading"):
        readings.clean_strict(r).collect()
    stat = readings.stats(readings.clean(r), ["recording_id"]).where("quantity = 'Velocity'").first()
    assert stat.sample_sd is None and stat.unit == "mm/s"
    vec = readings.vector(readings.clean(r), ["recording_id"]).first()
    assert vec.Velocity_mean == 1.5 and vec.Displacement_mean == 0.0


def test_duplicate_peers_name_another_file(spark):
    h = spark.createDataFrame([(f"f{i}", "same") for i in range(5)] + [("z", "other")], "path string, sha256 string")
    rows = {r.path: (r.n_peers, r.peer) for r in quality.duplicate_peers(h).collect()}
    assert rows == {"f0": (4, "f4"), **{f"f{i}": (4, "f0") for i in range(1, 5)}}


def test_file_checksums(spark, tmp_path):
    import hashlib

    data = {"a.bin": b"x" * 3_000_000, "b.bin": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.checksums(
        files.listing(spark, str(tmp_path))).collect()}
    assert got == {n: hashlib.sha256(c).hexdigest() for n, c in data.items()}


def test_scope_files_from_storage(spark, tmp_path):
    x = np.sin(np.arange(1000)).astype("f4")
    (tmp_path / "a.bin").write_bytes(captures.scope_bytes(x, step=0.01, waveforms=2))
    (tmp_path / "b.bin").write_bytes(captures.scope_bytes(x, step=0.01, fault=2))
    listing = files.listing(spark, str(tmp_path), ".bin")
    chunks = scope_bin.read_chunks(listing, chunk=128)
    long = files.samples_long(chunks)
    got = {(r.channel, r.i): r.value for r in long.collect()}
    assert got == {(f"CH{c}(V)", i): float(x[i]) for c in (1, 2) for i in range(1000)}
    assert {r.error for r in chunks.where("error IS NOT NULL").collect()} == {"not a scope capture"}
    part = files.samples_long(scope_bin.read_chunks(listing, chunk=50, offset_s=2.0, duration_s=1.5))
    assert sorted({r.i for r in part.collect()}) == list(range(200, 350))
    whole = files.contents(spark, str(tmp_path), ".bin")
    ok = {r.path.rsplit("/", 1)[1]: r.ok for r in scope_bin.validate(whole).collect()}
    assert ok == {"a.bin": True, "b.bin": False}


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_scope_sample_widths(width):
    raw = np.arange(4).astype(fv.SCOPE_WIDTHS[width]).tobytes()
    assert list(scope_bin._samples(raw + b"\x00" * (width - 1), width)) == [0, 1, 2, 3]


def test_wav_files_from_storage(spark, tmp_path):
    left, right = np.arange(-50, 50), np.arange(100)
    (tmp_path / "a.wav").write_bytes(captures.wav_bytes([left, right], rate=10))
    (tmp_path / "cut.wav").write_bytes(captures.wav_bytes([left, right], rate=10, cut=40))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    listing = files.listing(spark, str(tmp_path), ".wav")
    good = listing.where(F.col("path").endswith("/a.wav"))
    rows = files.samples_long(wav.read_chunks(good, chunk=16, offset_s=2.0, duration_s=3.0)).collect()
    assert {(r.channel, r.i): r.value for r in rows} == {
        **{("ch0", i): left[i] / 32768 for i in range(20, 50)},
        **{("ch1", i): right[i] / 32768 for i in range(20, 50)}}
    mono = files.samples_long(wav.read_chunks(good, mode="mono")).collect()
    assert mono[0].channel == "mono" and len(mono) == 100
    errors = wav.read_chunks(listing).where("error IS NOT NULL").select("path", "error").distinct().collect()
    assert {r.path.rsplit("/", 1)[1] for r in errors} == {"bad.wav", "cut.wav"}


def test_pcm_widths():
    assert wav._pcm(bytes([0, 128, 255]), 1, 1).ravel().tolist() == [-1.0, 0.0, 127 / 128]
    assert wav._pcm(b"\x00\x00\x80\xff\xff\x7f", 3, 1).ravel().tolist() == [-1.0, (2 ** 23 - 1) / 2 ** 23]


def test_deep_memory_from_storage(spark, tmp_path):
    codes = np.arange(300) % 256
    (tmp_path / "a.wfm").write_bytes(captures.deep_memory_bytes(codes, lsb=0.05))
    chunks = deep_memory.read_chunks(files.listing(spark, str(tmp_path), ".wfm"), chunk=64)
    rows = deep_memory.codes_long(chunks).orderBy("i").collect()
    assert [int(r.value) for r in rows] == codes.tolist() and rows[10].volts == pytest.approx(0.5)
    assert rows[0].n == 300


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.wfm").write_bytes(captures.deep_memory_bytes([1, 2, 3]))
    (tmp_path / "b.wav").write_bytes(captures.wav_bytes([[1, 2]]))
    (tmp_path / "c.bin").write_bytes(captures.scope_bytes([1.0, 2.0, 3.0, 4.0]))
    (tmp_path / "d.m4a").write_bytes(b"x")
    (tmp_path / "e.csv").write_text("CH1(V),Start = 1s,Increment = 2ms\n1\n3\n5\n")
    (tmp_path / "f").write_bytes(captures.scope_bytes([1.0, 2.0]))
    out = dispatch.read_waveforms(files.listing(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: (r.error, None if r.samples is None else len(r.samples)) for r in out.collect()}
    assert got == {"a.wfm": (None, 3), "b.wav": (None, 2), "c.bin": (None, 4), "d.m4a": ("no reader", None),
                   "e.csv": (None, 3), "f": (None, 2)}


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_no_listed_file_is_lost(spark, tmp_path, offset):
    good = {"a.wfm": captures.deep_memory_bytes([1, 2, 3]), "b.wav": captures.wav_bytes([[1, 2]]),
            "c.bin": captures.scope_bytes([1.0, 2.0]), "e.csv": b"Time(s),CH1(V)\n0,1\n1,2\n"}
    for name, data in good.items():
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"short-{name}").write_bytes(data[:20])
        (tmp_path / f"empty-{name}").write_bytes(b"")
    (tmp_path / "none.wav").write_bytes(captures.wav_bytes([[]]))
    (tmp_path / "plain.txt").write_bytes(b"")
    got = {}
    for r in dispatch.read_waveforms(files.listing(spark, str(tmp_path)), offset_s=offset).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert set(got) == {p.name for p in tmp_path.iterdir()}
    for name, rows in got.items():
        assert all((r.error is None) != (r.samples is None) for r in rows)
        if offset and not name.endswith("txt"):
            assert all(r.error for r in rows), name
    if not offset:
        assert all(r.error is None for name in good for r in got[name])


def test_cut_recordings_keep_their_good_frames(spark, tmp_path):
    x = np.arange(100)
    (tmp_path / "cut.wav").write_bytes(captures.wav_bytes([x], rate=10, cut=60))
    rows = wav.read_chunks(files.listing(spark, str(tmp_path)), chunk=64).collect()
    kept = sorted((r.start_sample + k, v) for r in rows if r.samples for k, v in enumerate(r.samples))
    assert kept == [(i, x[i] / 32768) for i in range(len(kept))] and 64 < len(kept) < 100
    assert [r.error.startswith("payload ends") for r in rows if r.error] == [True]


def test_readers_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 4096)
    monkeypatch.setattr(files, "TASK_FILES", 1)
    x = np.arange(20_000, dtype="f4")
    (tmp_path / "a.bin").write_bytes(captures.scope_bytes(x, step=0.01))
    (tmp_path / "b.wfm").write_bytes(captures.deep_memory_bytes(np.arange(20_000) % 256))
    (tmp_path / "c.csv").write_text("CH1(V),Start = 0s,Increment = 1s\n" + "\n".join(map(str, range(5000))))
    listing = files.listing(spark, str(tmp_path))
    one = {n: listing.where(F.col("path").endswith(n)) for n in (".bin", ".wfm", ".csv")}
    for df in (scope_bin.read_chunks(one[".bin"], chunk=500), deep_memory.read_chunks(one[".wfm"], chunk=500),
               files.checksums(listing)):
        tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 2
    csv = scope_csv.read_chunks(one[".csv"], block=1000, chunk=100)
    got = sorted((r.start_sample + k, v) for r in csv.collect() for k, v in enumerate(r.samples))
    assert got == [(i, float(i)) for i in range(5000)]
    part = scope_csv.read_chunks(one[".csv"], block=777, offset_s=100.0, duration_s=50.0).collect()
    assert sorted(v for r in part for v in r.samples) == [float(i) for i in range(100, 150)]


def test_capture_time_starts_at_its_origin(spark, tmp_path):
    data = bytearray(captures.scope_bytes([1.0, 2.0, 3.0], step=0.5))
    data[fv.SCOPE_FILE_HEADER + 40:fv.SCOPE_FILE_HEADER + 48] = np.array([-2.0], "<f8").tobytes()
    (tmp_path / "a.bin").write_bytes(bytes(data))
    listing = files.listing(spark, str(tmp_path))
    timed = scope_bin.with_time(files.samples_long(scope_bin.read_chunks(listing)), scope_bin.probe(listing))
    assert sorted(r.t for r in timed.collect()) == [-2.0, -1.5, -1.0]


def test_staged_tables_are_removed(spark):
    from pathlib import Path

    kept = tables.staged(spark.range(3), "gone")
    folder = Path(tables._stage_dir(spark))
    assert kept.count() == 3 and any(folder.glob("gone-*"))
    tables.remove_staged(spark)
    assert not folder.exists()


def test_scope_csv_layouts(spark):
    df = spark.createDataFrame([
        ("old", "CH1(V),CH2(V),Start = 1s,Increment = 2ms\n1,2\n3,4\n"),
        ("bare", "X\n5\n6"), ("screen", "Time(s),CH1(V),CH2(V)\r\n0.5,1,x\r\n")], "path string, content string")
    got = {(r.path, r.channel, r.i): (round(r.t, 6), r.value) for r in scope_csv.samples(df).collect()}
    assert got[("old", "CH2(V)", 1)] == (1.002, 4.0) and got[("bare", "CH1(V)", 1)] == (1.0, 6.0)
    assert got[("screen", "CH1(V)", 0)] == (0.5, 1.0) and got[("screen", "CH2(V)", 0)] == (0.5, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x', 1.5), (None, "", 2.0)], "s string, t string, v double")
    for fmt in ("json", "parquet"):
        tables.write_tables({"t": df}, str(tmp_path / fmt), fmt)
        assert sorted(map(str, tables.read_table(spark, str(tmp_path / fmt), "t", df, fmt).collect())) == \
            sorted(map(str, df.collect()))
    tables.write_tables({"t": df.limit(1)}, str(tmp_path / "csv"))
    assert tables.read_table(spark, str(tmp_path / "csv"), "t", df).collect() == df.limit(1).collect()
    lines = quality.checksum_manifest(df.select(F.col("t").alias("path"), F.col("t").alias("content")))
    tables.write_lines(lines, str(tmp_path / "sums"))
    assert spark.read.text(str(tmp_path / "sums")).count() == 2


def test_finished_table_is_reused(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert tables.cached_table(spark, path, build).count() == 3
    assert tables.cached_table(spark, path, build).count() == 3
    assert len(calls) == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.write.parquet(str(tmp_path / "in"))
    batch = rolling.rolling_rms(rows, "2 days", "1 day", "1 day")
    stream = rolling.rolling_rms(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")),
                                 "2 days", "1 day", "1 day")
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("rolling")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.recording_id, r.start): (r.n, round(r.rms, 9)) for r in spark.table("rolling").collect()}
    assert got == {(r.recording_id, r.start): (r.n, round(r.rms, 9)) for r in batch.collect()}
    assert math.isfinite(batch.agg(F.sum("rms")).first()[0])
