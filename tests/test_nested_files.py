"""Nested structures of paths, the cache of decoded files, and audio files written by a job."""

import os
import pickle
import time

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from axisflow.sources import audio, files
from axisflow.sources import nested_files as N

CHANNELS = [[0.0, 0.5, -0.25, 0.125], [0.25, 0.0, 0.0, -1.0]]


def wavs(spark, folder, names):
    rows = spark.createDataFrame([(n, 8000 + i, CHANNELS) for i, n in enumerate(names)], "name string, sample_rate int, channels array<array<double>>")
    files.write_any(rows, str(folder), "wav")
    return rows


def test_nested_paths(spark, tmp_path):
    wavs(spark, tmp_path, ["a.wav", "b/c.wav"])
    a, c = f"{tmp_path}/a.wav", f"{tmp_path}/b/c.wav"
    kind = "row int, found string, v struct<one:string,some:array<struct<k:string>>,named:map<string,array<string>>>"
    rows = spark.createDataFrame([(1, "x", (a, [(c,), (a,)], {"m": [a + "::[1:3,1]"]})), (2, "y", (None, [], {})), (3, "z", None)], kind)
    got = {r.row: r for r in N.load_audio_nested(rows, "v").collect()}
    assert (got[1].v.one.sample_rate, got[1].v.one.channels) == (8000, CHANNELS) and got[1].found == "x"
    assert [x.k.sample_rate for x in got[1].v.some] == [8001, 8000] and got[1].v.named["m"][0].channels == [[0.0, 0.0]]
    assert got[2].v.one is None and got[2].v.some == [] and got[2].v.named == {} and got[3].v is None
    texts = N.recursive_load(spark.createDataFrame([([a, a],)], "v array<string>"), "v", lambda content, path: F.octet_length(content))
    assert texts.collect()[0].v == [os.path.getsize(a)] * 2
    with pytest.raises(Exception, match="(?i)path"):
        N.load_audio_nested(spark.createDataFrame([(f"{tmp_path}/none.wav",)], "v string"), "v").collect()
    with pytest.raises(TypeError):
        N.load_audio_nested(spark.createDataFrame([(1,)], "v int"), "v")


def test_tasks_open_files_themselves(spark, tmp_path):
    """The tasks of a load do not grow with the number of files (before: 1,315 tasks for these)."""
    names = spark.range(1200).select(F.format_string("%d.wav", "id").alias("name"), (F.col("id") + 1).cast("int").alias("sample_rate"), F.lit(1.0).alias("x"))
    files.write_any(names.select("name", "sample_rate", F.array(F.array("x")).alias("channels")), str(tmp_path), "wav")
    spark.sparkContext.setJobGroup("opened", "")
    try:
        got = N.load_audio_nested(names.select("sample_rate", F.concat(F.lit(f"{tmp_path}/"), "name").alias("v")), "v").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 1200 and all(r.v.sample_rate == r.sample_rate for r in got)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("opened") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(info.numTasks for s in set(stages) if (info := tracker.getStageInfo(s))) < 300


def test_paths_of_any_name_and_store(spark, tmp_path):
    wavs(spark, tmp_path, ["_a.wav", "b [1].wav", "c.wav"])
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{tmp_path.name}.link./in", f"file://{tmp_path}")
    paths = [f"{tmp_path}/_a.wav", f"{tmp_path}//b [1].wav::[1:3,1]", f"file://{tmp_path}/c.wav", f"viewfs://{tmp_path.name}/in/c.wav::[:2,0]", os.path.relpath(f"{tmp_path}/c.wav")]
    got = N.load_audio_nested(spark.createDataFrame([(paths,)], "v array<string>"), "v").collect()[0].v
    assert [x and x.sample_rate for x in got] == [8000, 8001, 8002, 8002, 8002]
    assert [got[1].channels, got[3].channels] == [[[0.0, 0.0]], [[0.0, 0.5]]]


def test_few_bytes_of_paths_are_opened_by_many_tasks(spark, tmp_path):
    """Also where Spark joins partitions of so few bytes to one."""
    wavs(spark, tmp_path, [f"{i}.wav" for i in range(64)])
    paths = spark.range(64).select(F.concat(F.lit(f"{tmp_path}/"), "id", F.lit(".wav")).alias("leaf")).distinct()
    assert N.contents(paths).select(F.spark_partition_id().alias("task")).distinct().count() == 8


def test_blocks_of_contents_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    for name in "ab":
        (tmp_path / name).write_bytes(name.encode() * 60)
    rows = [(f"{name}::[{i}:]", f"{tmp_path}/{name}") for name in "ab" for i in range(2)]
    got = list(N._opened(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["leaf", "file"])])))
    assert [b.num_rows for b in got] == [1] * 4 and [tuple(r.values()) for b in got for r in b.to_pylist()] == [(x, f[-1].encode() * 60) for x, f in rows]


def test_audio_files_are_written_whole_or_not_at_all(spark, tmp_path):
    folder = tmp_path / "out"
    rows = wavs(spark, folder, ["a.wav", "b/c.wav"])
    assert sorted(os.listdir(folder)) == ["a.wav", "b"]
    assert {r.path.rpartition("/")[2]: r.channels for r in audio.read(spark, f"{folder}/*.wav").collect()} == {"a.wav": CHANNELS}
    for bad in (rows, rows.limit(1).union(rows.limit(1)).withColumn("name", F.lit("d.wav")), rows.withColumn("name", F.lit("../e.wav")), rows.withColumn("name", F.when(F.col("sample_rate") == 8000, "f.wav"))):
        with pytest.raises(Exception):
            files.write_any(bad, str(folder), "wav")
        assert sorted(x for x in os.listdir(folder) if not x.startswith("_")) == ["a.wav", "b"]
    files.write_any(rows.withColumn("sample_rate", F.lit(16_000)), str(folder), "wav", overwrite=True)
    assert {r.sample_rate for r in audio.read(spark, f"{folder}/*.wav").collect()} == {16_000} and os.listdir(f"{folder}/b") == ["c.wav"]


def test_the_driver_gets_names_only(tmp_path):
    """Not a path of the staging folder a file; what is there already is met in the folders of new files only."""
    write = lambda names, overwrite=False: (w := N._AudioWriter(f"file:{tmp_path}/out", "int16", ["name", "sample_rate", "channels"], overwrite), w.write(iter([Row(name=n, sample_rate=8000, channels=CHANNELS) for n in names])))
    w, some = write([f"{i:04}.wav" for i in range(200)])
    more = w.write(iter([Row(name="d/0000.wav", sample_rate=8000, channels=CHANNELS)]))
    assert len(pickle.dumps(some)) < 30 * 200
    w.commit([some, None, more])
    assert sorted(os.listdir(tmp_path / "out")) == [*(f"{i:04}.wav" for i in range(200)), "d"]
    for names in (["new.wav", "0007.wav"], ["d/0000.wav"], ["e/1.wav", "e/1.wav"]):
        w, message = write(names)
        with pytest.raises(ValueError, match="names are not free"):
            w.commit([message])
    w, message = write(["0007.wav", "e/1.wav"], overwrite=True)
    w.commit([message])
    assert len(os.listdir(tmp_path / "out")) == 202 and os.listdir(tmp_path / "out" / "e") == ["1.wav"]


def test_cache_decodes_only_what_is_new_or_changed(spark, tmp_path):
    wavs(spark, tmp_path / "in", ["a.wav", "b.wav"])
    loader = N.CachedLoader(spark, f"{tmp_path}/cache", lambda content: audio.decoded(content))
    paths = f"{tmp_path}/in/*.wav"
    name = lambda p: p.rpartition("/")[2]
    assert sorted(map(name, loader.missing(paths))) == ["a.wav", "b.wav"]
    first = {name(r.path): r.data.channels for r in loader.load(paths).collect()}
    assert first == {"a.wav": CHANNELS, "b.wav": CHANNELS} and loader.missing(paths) == []
    with open(tmp_path / "in" / "b.wav", "wb") as f:
        f.write(audio.encode(8000, [[0.5]]))
    os.utime(tmp_path / "in" / "b.wav", (time.time() + 5,) * 2)
    assert [name(p) for p in loader.missing(paths)] == ["b.wav"]
    assert {name(r.path): r.data.channels for r in loader.load(paths).collect()} == {"a.wav": CHANNELS, "b.wav": [[0.5]]} and loader.missing(paths) == []
