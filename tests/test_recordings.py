import time

from pyspark.sql import functions as F
from tracemill.sources import recordings as S


def test_discovery_pairing_and_latest(spark, tmp_path):
    for folder in ("a/fish_07_highact/x", "a/fish_08_lowact/y", "b/fish_07_highact/x"):
        d = tmp_path / folder
        d.mkdir(parents=True)
        (d / "dff.bin").write_text("1")
        if "08" not in folder:
            (d / "tail.bin").write_text("2")
        time.sleep(0.02)
    files = S.list_files(spark, str(tmp_path), "*.bin")
    assert files.count() == 5
    pairs = S.path_attributes(S.pair_files(files, "dff.bin", "tail.bin"), "folder")
    got = {(r.subject, r.session, r.prep) for r in pairs.collect()}
    assert pairs.count() == 2 and got == {(7, "high", "invivo")}
    best = S.latest_file(S.path_attributes(files.filter("name = 'dff.bin'")), ["subject"], F.when(F.col("path").contains("/b/"), 0).otherwise(1), F.lit(0)).collect()
    assert {r.subject: "/b/" in r.path for r in best} == {7: True, 8: False}
    assert all(r.label.endswith("dff.bin") and r.label.count("/") == 2 for r in best)


def test_columns_rates_and_clocks(spark, tmp_path):
    df = spark.createDataFrame([("f1", None, ([1.0, 2.0, 3.0],), 0.0, [0.0, 0.5, 1.0]), ("f2", [4.0, 5.0], ([9.0],), 2.5, [0.0])], "folder string, DFF array<double>, results struct<dff:array<double>>, rate double, times array<double>")
    got = {r.folder: r.trace for r in S.resolve_column(df, ["dff"], "trace").collect()}
    assert got == {"f1": [1.0, 2.0, 3.0], "f2": [4.0, 5.0]}
    ini = spark.createDataFrame([("f1", "x = 1\nvolume.frame.rate = 7.5\n"), ("f3", "nothing")], "folder string, text string")
    fps = S.resolve_fps(df, ["missing", "rate"], ini)
    assert {r.folder: r.fps for r in fps.collect()} == {"f1": 7.5, "f2": 2.5}
    assert {r.fps for r in S.resolve_fps(df.select("folder"), ["rate"]).collect()} == {S.DEFAULT_FPS}
    t = S.time_vector(S.resolve_column(fps, ["dff"], "trace"), "trace", ["times"])
    assert {r.folder: r.t for r in t.collect()} == {"f1": [0.0, 0.5, 1.0], "f2": [0.0, 0.4]}
    S.write_summary(t.select("folder", "fps"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    S.write_summary(t, str(tmp_path / "tree/one/x"))
    assert S.scan_recordings(spark, str(tmp_path / "tree")).filter("path like '%one/x%'").count() == 2
    good, failed = S.split_errors(spark.createDataFrame([(1, None), (2, "bad")], "id int, error string"))
    assert good.count() == failed.count() == 1
