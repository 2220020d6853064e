import numpy as np
from pyspark.sql import functions as F

from serixa.functions import bits
from serixa.operators import columns, transforms
from serixa.sources import generators, scans, sinks


def test_binary_files_and_samples(spark, tmp_path):
    (tmp_path / "a.i16le").write_bytes(np.array([1, -2, 32767], "<i2").tobytes() + b"z")
    (tmp_path / "b.i16le").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = scans.binary_files(spark, str(tmp_path), ".i16le")
    assert [(r.idx, r.x) for r in scans.int16_rows(files).orderBy("idx").collect()] == [(0, 1), (1, -2), (2, 32767)]
    assert scans.prefix(files, 2).first().data == b"\x01\x00"


def test_csv_and_log(spark, tmp_path):
    (tmp_path / "v.csv").write_text("t,v\na,1.005\nb,bad\nc,0.125\nd,-9999\ne,\n")
    assert [r.x for r in scans.csv_series(spark, str(tmp_path / "v.csv")).orderBy("line").collect()] == [100, 12, -32767]
    (tmp_path / "l.txt").write_text("d t 1 2 19.5 x\nshort line\nd  t 1 2 nan_ 4\nd t 1 2 20.25\nd t 1 2 1\n")
    assert [r.x for r in scans.log_series(spark, str(tmp_path / "l.txt"), most=2).collect()] == [1950, 2025]


def test_labelled_series(spark, tmp_path):
    (tmp_path / "train").write_text("1 0.0 0.5\n")
    (tmp_path / "test").write_text("2\t1.0  0.25\n")
    rows = scans.min_max_to_int16(scans.labelled_series(spark, [str(tmp_path / "train"), str(tmp_path / "test")]))
    assert [r.x for r in rows.orderBy("split", "line", "at").collect()] == [-32767, 0, 32767, -16384]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r.x for r in scans.min_max_to_int16(flat).collect()} == {-32767}


def test_reports_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "core", 1000, 587), ("c2", "drh", 128, 15)], "corpus string, codec string, orig long, coded long")
    back = scans.ratio_lines(sinks.fixed_width(rows).union(spark.createDataFrame([("# noise",)], "value string")))
    assert {tuple(r) for r in back.collect()} == {("c1", "core", 1000, 587, "58.7%"), ("c2", "drh", 128, 15, "11.7%")}
    lines = spark.createDataFrame([("# c",), ("a\t1\t10\t5\t50.0\tCE",), ("short\t1",)], "value string")
    assert [tuple(r) for r in scans.ablation_lines(lines).collect()] == [("a", 1, 10, 5, 50.0, "CE")]
    (tmp_path / "r.json").write_text('{"rows": [{"corpus": "a",\n "coded": 5}]}')
    assert scans.json_rows(spark, str(tmp_path / "r.json")).first().coded == 5
    assert sinks.markdown(rows.orderBy("corpus")).count("\n") == 4
    sinks.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_generators_in_rows_and_bytes(spark):
    rows = generators.joint_rows(spark).orderBy("axis", "i").collect()
    assert np.array([r.x for r in rows], "<i2").tobytes() == generators.joints()
    assert bytes(r.b for r in generators.harness_rows(spark).orderBy("i").collect()) == generators.harness128()
    assert bytes(r.b for r in generators.logline_rows(spark).orderBy("i").collect()) == generators.logline()


def test_bits(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, -1, 32767, -32768)], "v int")
    zig = rows.select(bits.unzigzag16(bits.zigzag16(F.col("v"))).alias("a"), bits.unzigzag32(bits.zigzag32(F.col("v"))).alias("b"), "v").collect()
    assert all(r.a == r.v == r.b for r in zig)
    names = spark.createDataFrame([("raw",), ("TICKS",), ("fire",)], "n string").select(bits.frontend_by_alias(F.col("n")).alias("f"))
    assert [r.f for r in names.collect()] == [0, 2, None]


def test_segments_change_nothing(spark):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("series_id"), F.col("id").alias("idx"), (F.col("id") * 37 % 501).cast("int").alias("x"))
    key = ["idx", "z"]
    assert transforms.delta_by_segment(rows, 64).select(key).exceptAll(transforms.delta(rows).select(key)).count() == 0


def test_errors_in_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"abcd")), (3, None)], "series_id long, data binary")
    got = {(r.series_id, r.codec): r for r in columns.encode(rows, ["drh", "core_bytes"]).collect()}
    assert got[1, "drh"].error == -5 and got[1, "drh"].payload is None and got[2, "drh"].error == 0 and got[3, "core_bytes"].n_bytes == 0
    coded = columns.encode(rows, ["core_bytes"]).withColumn("crc", F.when(F.col("series_id") == 2, F.lit(7)).otherwise(F.col("crc")))
    assert {r.series_id: r.error for r in columns.decode(coded).collect()} == {1: 0, 2: -3, 3: 0}


def test_sql_functions(spark):
    columns.register(spark)
    row = spark.sql("SELECT series_decode('drh', series_encode('drh', X'01000200')) AS back, series_encode('none', X'00') AS none").first()
    assert row.back == b"\x01\x00\x02\x00" and row.none is None
    assert [tuple(r) for r in spark.sql("SELECT * FROM series_samples(X'0100FEFF')").collect()] == [(0, 1), (1, -2)]
