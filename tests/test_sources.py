"""Files and checks that fail a job; the queries over the tables are in test_queries.py."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow.operators import features, intervals, nested, sparse, spectral
from axisflow.sources import audio, files, rttm, segments


def test_wav_files_of_every_type(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-1, 1, (2, 100))
    for kind, off in (("int16", 2**-15), ("int32", 2**-31), ("float32", 1e-7), ("float64", 0)):
        (tmp_path / f"{kind}.wav").write_bytes(audio.encode(16_000, x, kind))
        row = audio.read(spark, f"{tmp_path}/{kind}.wav").first()
        assert row.sample_rate == 16_000 and np.abs(np.array(row.channels) - x).max() <= off
        part = audio.read(spark, f"{tmp_path}/{kind}.wav", 90, 110, 1, fill=True).first().channels
        assert len(part) == 1 and len(part[0]) == 20 and part[0][10:] == [0.0] * 10
    head = audio.lengths(spark, f"{tmp_path}/*.wav").collect()
    assert {(r.n_channels, r.n_samples) for r in head} == {(2, 100)}


def test_files_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, "c")], "n long, s string")
    for end in ("json", "csv", "parquet", "orc"):
        files.write_any(df, f"{tmp_path}/t.{end}")
        assert sorted((int(r.n), r.s) for r in files.read_any(spark, f"{tmp_path}/t.{end}").collect()) == [(1, "a;b"), (2, "c")]
    (tmp_path / "t.yaml").write_text("a: [1, 2]\n")
    assert files.read_any(spark, f"{tmp_path}/t.yaml").selectExpr("try_variant_get(value, '$.a[1]', 'int') AS x").first().x == 2
    (tmp_path / "t.tsv").write_text("x\ty\n1\t2\n")
    assert files.read_csv(spark, f"{tmp_path}/t.tsv", sep=None).columns == ["x", "y"]
    with pytest.raises(ValueError):
        files.read_any(spark, "t.pkl")


def test_nested_tables(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, struct(struct(2 AS x, 'n' AS y) AS b, array(1) AS c) AS a")
    df.write.parquet(f"{tmp_path}/n")
    assert files.leaf_paths(df) == ["/id", "/a/b/x", "/a/b/y", "/a/c"]
    assert files.read_below(spark, f"{tmp_path}/n", "/a/b").first().asDict() == {"x": 2, "y": "n"}
    with pytest.raises(ValueError):
        files.update_table(df, df, ["id"])
    with pytest.raises(ValueError):
        nested.merge(df, ["a", "a"], allow_update=False)


def test_lines_that_fail(spark, tmp_path):
    iv = spark.createDataFrame([("f", "s", 16000, 24000)], "file_id string, speaker string, start long, stop long")
    rttm.write(iv, f"{tmp_path}/r", 16_000)
    assert rttm.read(spark, f"{tmp_path}/r", 16_000).first().asDict() == iv.first().asDict()
    (tmp_path / "seg").write_text("u f 0.5 1.00003\n")
    with pytest.raises(Exception, match="between samples"):
        segments.read(spark, f"{tmp_path}/seg", 16_000).collect()
    assert segments.read(spark, f"{tmp_path}/seg", 16_000, F.floor).first().stop == 16_000
    five = spark.createDataFrame([("u f 1 2 3",)], "line string")
    with pytest.raises(Exception, match="not four fields"):
        segments.parse_lines(five, 16_000).collect()


def test_checks_that_fail(spark):
    two = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0])], "k int, onset long, values array<double>")
    with pytest.raises(Exception, match="overlap"):
        sparse.from_arrays(two, ["k"]).collect()
    iv = spark.createDataFrame([(1, 0, 11)], "k int, start long, stop long")
    with pytest.raises(Exception, match="behind the axis"):
        intervals.within(iv, ["k"], 10).collect()
    with pytest.raises(Exception, match="two tables"):
        intervals.union_of_files([iv, iv], "k").collect()


def test_windows_and_differences():
    assert np.allclose(spectral.window("hann", 4), [0, 0.5, 1, 0.5]) and np.allclose(spectral.window("hann", 4, True), [0, 0.75, 0.75, 0])
    for name in spectral.WINDOWS:
        w = spectral.window(name, 16, True)
        assert len(w) == 16 and np.allclose(w, w[::-1])
    w = spectral.window("blackman", 16)
    assert np.isclose((w * spectral.dual_window(w, 4))[::4].sum(), 1)
    assert np.isclose(features.hz_to_mel(np.float64(6300), True, np), 2595)
    assert np.allclose(features.delta_taps(3, 2), np.convolve([0.5, 0, -0.5], [0.5, 0, -0.5]))


def test_signals_of_many_lengths(spark):
    rng = np.random.default_rng(1)
    x = [rng.standard_normal(n).tolist() for n in (1023, 1024, 1025, 1025)] + [[], None]
    df = spark.createDataFrame(list(enumerate(x)), "id int, x array<double>").coalesce(1)
    rows = spectral.stft(df, "x", 64, 16)
    back = {r.id: r.y for r in rows.select("id", spectral.istft(F.col("re"), F.col("im"), 64, 16).alias("y")).collect()}
    for i, v in enumerate(x[:4]):
        assert np.allclose(back[i][: len(v)], v) and len(back[i]) < len(v) + 16
    loud = rows.withColumn("loud", F.zip_with("re", "im", lambda a, b: F.zip_with(a, b, lambda p, q: F.sqrt(p * p + q * q))))
    made = {r.id: r.signal for r in spectral.griffin_lim(loud, "loud", 64, 16, iterations=5).collect()}
    assert [len(made[i]) for i in range(4)] == [len(back[i]) for i in range(4)] == [1024, 1024, 1040, 1040]
    order2 = df.where("id = 0").select(features.delta(F.col("x"), 3, 2).alias("d")).first().d
    pad = np.pad(np.array(x[0]), 3, mode="edge")
    want = np.convolve(np.convolve(pad, [0.5, 0, -0.5]), [0.5, 0, -0.5])[: len(pad)][3 + 1 :][: len(x[0])]
    assert np.allclose(order2[: len(want)], want)
