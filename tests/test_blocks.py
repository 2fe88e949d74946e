"""Arrays in blocks: cost and memory of operators over many signals, and their results by plain forms."""

import time

import numpy as np
from pyspark.sql import functions as F

from axisflow.operators import features

SIGNAL = "id int, x array<double>"
BANDS = dict(sample_rate=16_000, window_length=16, shift=8, size=16, cepstra=5, filters=6)


def test_modulation_of_many_signals(spark):
    """Blocks and means of the stored cepstra, and a cost that does not multiply what stands below an explode."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.standard_normal(64 if i % 9 else 20).tolist()) for i in range(2_000)], SIGNAL)
    began = time.time()
    made = features.modmfcc(rows, "x", 4, 1, average=3, average_step=2, **BANDS)
    assert made.select("id", F.explode("modulation").alias("b")).select("id", F.explode("b").alias("c")).select("id", F.explode("c")).count() == (2 * 1_777 + 223) * 3 * 5
    assert time.time() - began < 40
    cepstra = {r.id: np.array(r.cepstra) for r in features.mfcc(rows.limit(20), "x", 5, filters=6, sample_rate=16_000, window_length=16, shift=8, size=16).collect()}
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(4) / 4)
    for r in made.where("id < 20").collect():
        c = np.pad(cepstra[r.id], ((0, 4), (0, 0)))
        blocks = [np.abs(np.fft.rfft(c[b : b + 4] * w[:, None], axis=0)) for b in range(max(1, len(cepstra[r.id]) - 3))]
        blocks = blocks + [0 * blocks[0]] * 3
        want = [sum(blocks[g : g + 3]) / 3 for g in range(0, 3 if r.id % 9 else 1, 2)]
        assert np.allclose(r.modulation, want)


def test_python_holds_few_blocks(spark, monkeypatch):
    """What Python holds at once does not grow with the rows of a batch: fn meets blocks of bounded size, and results leave in slices."""
    import pyarrow as pa

    from axisflow.operators import blocks

    seen, out = [], []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: out.append(run) or self)
    rows = spark.createDataFrame([(1, [[0.0]])], "id int, x array<array<double>>")
    blocks.mapped(rows, ["x"], lambda x: seen.append(x.size) or (x.reshape(len(x), -1),), {"y": 1})
    rng = np.random.default_rng(3)
    values = [rng.standard_normal((7 + i // 3_000, 30)).tolist() for i in range(9_000)] + [None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9_002)), pa.array(values, pa.list_(pa.list_(pa.float64())))], ["id", "x"])
    made = list(out[0](iter([batch])))
    assert max(seen) <= blocks.CELLS <= 200_000 and max(b.num_rows for b in made) < 2_000
    assert [x for b in made for x in b.column("y").to_pylist()] == [[z for y in v or [] for z in y] for v in values]


def test_spectra_and_alignments_in_blocks(spark):
    """Mixed lengths, empty and null rows in one batch."""
    from axisflow.operators import spectral

    rng = np.random.default_rng(5)
    signals = [rng.standard_normal(n).tolist() for n in (64, 64, 80, 1, 64)] + [[], None]
    rows = spark.createDataFrame([(i, x, signals[-3 - i] if i < 5 else x) for i, x in enumerate(signals)], "id int, x array<double>, y array<double>").coalesce(1)
    framed = spectral.stft(rows.select("id", "x"), "x", 16, 4).select("id", *(F.when(F.col("id") != 4, F.col(c)).alias(c) for c in ("re", "im")))
    back = {r.id: r.z for r in framed.select("id", spectral.istft(F.col("re"), F.col("im"), 16, 4).alias("z")).where("z IS NULL OR size(z) >= 0").collect()}
    assert back[4] is None and all(np.allclose(back[i][: len(signals[i])], signals[i]) for i in range(4))
    loud = framed.select("id", F.col("re").alias("loud"))
    alone = {r.id: r.signal for r in spectral.griffin_lim(loud.repartition(7, "id"), "loud", 16, 4, iterations=3, alpha=0.5).collect()}
    assert alone[4] == [] and alone == {r.id: r.signal for r in spectral.griffin_lim(loud, "loud", 16, 4, iterations=3, alpha=0.5).collect()}
    found = {r.id: r.d for r in rows.select("id", spectral.dtw(F.col("x"), F.col("y")).alias("d")).collect()}
    assert found[6].cost is None and found[6].path is None and (found[5].cost, found[5].path) == (0.0, [])
    assert found[3].cost == found[1].cost == abs(np.array(signals[1]) - signals[3][0]).sum() and len(found[3].path) == 64
