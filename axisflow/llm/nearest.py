"""Operator 9: nearest neighbours along shifted space-filling curves."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 4096  # rows of a curve that meet queries in one group
CROWD = 50_000  # queries that meet them there


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cells (n, d), bits * d <= 63, by Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    fold, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        fold ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= fold
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _sorted_places(keys: DataFrame) -> DataFrame:
    """Place of every row of keys(curve, rep, key, cell) within its curve: range partitions, their sizes summed, a window in each."""
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(keys.repartitionByRange(parts, "curve", "key", "rep").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["curve"], r["part"], r["count"]) for r in dealt.groupBy("curve", "part").count().collect())  # a row or two a partition
    offsets, last, total = [], None, 0
    for curve, part, n in sizes:
        total = total if curve == last else 0
        offsets.append((curve, part, total))
        last, total = curve, total + n
    at = keys.sparkSession.createDataFrame(offsets, "curve int, part int, before long")
    inside = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "rep")) - 1
    return dealt.join(F.broadcast(at), ["curve", "part"]).select("curve", "rep", "cell", (F.col("before") + inside).alias("place"))


def _centre(reps: DataFrame, n_dims: int, sample: int = 100_000) -> tuple[np.ndarray, float]:
    """Mean vector and mean deviation of a component, from a hash sample of about `sample` vectors (all, if fewer)."""
    n = reps.count()
    some = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * sample / n)) if n > sample else reps
    rows = some.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s")).collect()  # a row a component
    centre = np.zeros(n_dims)
    centre[[r["i"] for r in rows]] = [r["m"] for r in rows]
    spread = float(np.sqrt(np.mean([r["s"] for r in rows]))) if rows else 0.0
    return centre, spread if np.isfinite(spread) and spread > 0 else 1.0


def _blocks(n: int, most: int, least: int) -> int:
    """Rows of a block: a power of two from `least` on, so that a curve has at most `most` blocks."""
    return max(least, 1 << max(0, math.ceil(math.log2(max(1, n) / most))))


class _Curves:
    """Random axes and shifts of every curve, and the mean place of each of its blocks on these axes."""

    def __init__(self, n_dims: int, curves: int, used: int, bits: int, seed: int, centre: np.ndarray, spread: float):
        rng = np.random.default_rng(seed)
        self.axes = [np.linalg.qr(rng.standard_normal((n_dims, n_dims)))[0][:, :used] for _ in range(curves)]
        self.shifts, self.bits, self.centre, self.spread, self.n_dims = rng.random((curves, used)), bits, centre, spread, n_dims
        self.means: list[np.ndarray] = []

    def scaled(self, vectors) -> np.ndarray:
        return (np.stack(vectors.to_numpy()) - self.centre) / self.spread if len(vectors) else np.zeros((0, self.n_dims))

    def cells(self, x: np.ndarray, c: int) -> np.ndarray:
        """Integer cells of three deviations around the centre; what lies beyond goes to border cells."""
        return (((x @ self.axes[c]) / 3 + 1 + self.shifts[c]) / 3 * (1 << self.bits)).clip(0, (1 << self.bits) - 1).astype(np.int64)

    def place(self, blocks: pd.DataFrame) -> None:
        """Takes the blocks' mean cells (curve, block, c0, c1, ..)."""
        for c in range(len(self.axes)):
            own = blocks[blocks["curve"] == c].sort_values("block")
            self.means.append((((own.iloc[:, 2:].to_numpy() + 0.5) / (1 << self.bits) * 3 - 1 - self.shifts[c]) * 3).astype("f4"))

    def nearest(self, x: np.ndarray, c: int) -> np.ndarray:
        """The curve's blocks for each row of x, nearest first."""
        p = (x @ self.axes[c]).astype("f4")
        return np.argsort((self.means[c] ** 2).sum(1)[None] - 2 * p @ self.means[c].T, axis=1, kind="stable")


def _true_neighbours(reps: DataFrame, asked: DataFrame, k: int, queries: int) -> list[tuple[int, np.ndarray, int]]:
    """(query, its vector, neighbour) by an exact pass of the table past about `queries` of the asked vectors, chosen by hash."""
    n = asked.count()
    some = asked.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, queries / max(1, n)))).orderBy("rep").collect()
    if not some:
        return []
    names, q = np.array([r["rep"] for r in some]), np.array([r["v"] for r in some])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                d = (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)
                keep = min(k + 1, len(x))
                best = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                yield pd.DataFrame({"query": np.repeat(np.arange(len(q)), keep), "rep": f["rep"].to_numpy()[best.ravel()], "near": np.take_along_axis(d, best, 1).ravel()})

    met = reps.select("rep", "v").mapInPandas(run, "query int, rep long, near double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("near", "rep"))
    found = met.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("query", "rep").collect()  # k + 1 rows a sampled query
    return [(r["query"], q[r["query"]], r["rep"]) for r in found if r["rep"] != names[r["query"]]]


def search(vectors: DataFrame, is_query, k: int = 10, curves: int = 16, dims: int = 12, bits: int = 7, recall: float = 0.97, least: int = 2048, most_blocks: int = 4096, spare: int = 12, seed: int = 9) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found, of vectors(vec_id, embedding), for each row where `is_query` holds.

    Equal vectors are one representative that keeps its k + 1 smallest ids, which is all that a result can need. Each curve
    projects the centred vectors on `dims` random axes (all, if they have fewer components) with a random shift, takes
    Hilbert keys, range-partitions and numbers the rows, and cuts them into at most `most_blocks` key windows of 64 rows or more, whose
    mean places are all that is broadcast. A query meets the windows of every curve that lie nearest to it on that curve's axes; how many,
    about 64 of the queries decide: so many that `recall` of their true neighbours (by an exact pass) stand in one of them, and `least`
    rows a curve at least. The findings of all curves merge, and the nearest by single-precision vectors are reranked by Euclidean distance
    in double precision on the original vectors. Candidates farther than a query's k + 1 nearest in its first windows of one curve
    cannot be results and are dropped where they are met.
    Up to `least` distinct vectors every candidate is met, and results are exact; beyond, the number of windows follows the data and the
    table's size (figures in the README). Centre and window count come from bounded samples; every vector is indexed.
    Vectors that are null, zero, or hold null or non-finite components take no part; nor do null ids and vectors of another
    length than most; repeated rows (equal id and vector) count once; ties go to smaller ids; fewer than k candidates: all.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(whole)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_dims, used = length["n"], min(dims, length["n"])
    rows = rows.where(F.size("v") == n_dims).withColumn("rep", F.xxhash64("v"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
    ids = rows.select("rep", "vec_id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    reps = materialize(rows.groupBy("rep").agg(F.first("v").alias("v"), F.max("asked").alias("asked")).join(ids, "rep"))
    asked = rows.where("asked").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query_rep")).distinct()
    centre, spread = _centre(reps, n_dims)
    index = _Curves(n_dims, curves, used, min(bits, 62 // used), seed, centre, spread)

    def keys(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = index.scaled(f["v"])
            for c in range(curves):
                cells = index.cells(x, c)
                yield pd.DataFrame({"rep": f["rep"], "curve": c, "key": hilbert_keys(cells, index.bits), "cell": [r.tobytes() for r in cells.astype(np.uint8)]})

    n = reps.count()
    block = _blocks(n, most_blocks, 64)
    window = max(block, WINDOW)  # rows of neighbouring blocks that meet in one group; larger blocks are met in parts of WINDOW rows
    placed = _sorted_places(reps.select("rep", "v").mapInPandas(keys, "rep long, curve int, key long, cell binary"))
    placed = materialize(placed.select("curve", "rep", "cell", F.floor(F.col("place") / block).cast("int").alias("block"), F.floor(F.col("place") / window).cast("int").alias("window"), F.floor(F.col("place") % window / WINDOW).cast("int").alias("part")))
    byte = lambda i: F.conv(F.hex(F.substring("cell", i + 1, 1)), 16, 10).cast("int")
    index.place(placed.groupBy("curve", "block").agg(*(F.avg(byte(i)).alias(f"c{i}") for i in range(used))).toPandas())  # most_blocks rows a curve at most

    probes = math.ceil(least / block)
    n_blocks = len(index.means[0])
    if probes < n_blocks:
        known = _true_neighbours(reps, reps.where("asked").select("rep", "v"), k, 64)
        if known:
            told = spark.createDataFrame([(i, rep) for i, (_, _, rep) in enumerate(known)], "i int, rep long")
            x = (np.array([v for _, v, _ in known]) - centre) / spread
            orders = [np.argsort(index.nearest(x, c), axis=1) for c in range(curves)]
            needed = np.full(len(known), n_blocks)
            for r in placed.join(F.broadcast(told), "rep").select("i", "curve", "block").collect():  # a row a curve and sampled neighbour
                needed[r["i"]] = min(needed[r["i"]], orders[r["curve"]][r["i"], r["block"]] + 1)
            probes = max(probes, int(np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]))
    probes = min(probes, n_blocks)

    def code(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"rep": f["rep"], "least": f["least"], "code": [x.tobytes() for x in index.scaled(f["v"]).astype("<f4")]})

    codes = reps.select("rep", "v", F.col("ids")[0].alias("least")).mapInPandas(code, "rep long, least long, code binary")

    def probing(of: list[int], count: int):
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for a in range(0, len(f), 256):
                    part = f.iloc[a : a + 256]
                    x = index.scaled(part["v"])
                    short = [r.tobytes() for r in x.astype("<f4")]
                    for c in of:
                        blocks = index.nearest(x, c)[:, :count]
                        at = np.repeat(np.arange(len(part)), blocks.shape[1])
                        yield pd.DataFrame({"rep": part["rep"].to_numpy()[at], "reach": part["reach"].to_numpy()[at], "code": [short[i] for i in at], "curve": c, "block": blocks.ravel()})

        return run

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        there, mine = f[~f["asks"]], f[f["asks"]]
        vector = lambda x: np.frombuffer(b"".join(x["code"]), "<f4").reshape(len(x), n_dims)
        found = []
        if len(there) and len(mine):
            there = there.sort_values(["block", "least"])
            x, names, blocks = vector(there), there["rep"].to_numpy(), there["block"].to_numpy()
            xx = (x.astype(float) ** 2).sum(1)
            for b, part in mine.groupby("block"):
                lo, hi = np.searchsorted(blocks, [b, b + 1])
                keep = min(k + 1 + spare, hi - lo)
                for a in range(0, len(part) if keep else 0, 512):
                    some = part.iloc[a : a + 512]
                    q = vector(some)
                    d = ((q.astype(float) ** 2).sum(1)[:, None] - 2 * (q @ x[lo:hi].T) + xx[lo:hi]).clip(0)
                    if keep < hi - lo:  # what is as near as the keep-th nearest stays, ties too
                        d = np.where(d <= np.minimum(np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep], some["reach"].to_numpy()[:, None]), d, np.inf)
                    else:
                        d = np.where(d <= some["reach"].to_numpy()[:, None], d, np.inf)
                    i, j = np.nonzero(np.isfinite(d))
                    found.append(pd.DataFrame({"query_rep": some["rep"].to_numpy()[i], "rep": names[lo:hi][j], "near": d[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"query_rep": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "near": np.zeros(0)})

    def met(queries: DataFrame, of: list[int], count: int) -> DataFrame:
        """query_rep, rep, near: what queries(rep, v, reach) meet in their `count` nearest blocks of each curve; crowded windows are met in shares of the queries."""
        asks = queries.mapInPandas(probing(of, count), "rep long, reach double, code binary, curve int, block int")
        asks = asks.withColumns({"window": F.floor(F.col("block") * F.lit(block) / window).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(max(1, window // WINDOW) - 1)))})
        crowds = asks.groupBy("curve", "window", "part").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("shares")).where("shares > 1")
        crowds = materialize(crowds)
        share = F.coalesce("shares", F.lit(1))
        asks = asks.join(crowds, ["curve", "window", "part"], "left").select("curve", "window", "part", F.pmod("rep", share).cast("int").alias("share"), "block", "rep", "code", "reach", F.lit(None).cast("long").alias("least"), F.lit(True).alias("asks"))
        there = placed.where(F.col("curve").isin(of)).select("curve", "window", "part", "block", "rep").join(codes, "rep").join(crowds, ["curve", "window", "part"], "left")
        there = there.select("curve", "window", "part", F.explode(F.sequence(F.lit(0), share - 1)).alias("share"), "block", "rep", "code", F.lit(None).cast("double").alias("reach"), "least", F.lit(False).alias("asks"))
        pairs = asks.unionByName(there).groupBy("curve", "window", "part", "share").applyInPandas(meet, "query_rep long, rep long, near double")
        return pairs.groupBy("query_rep", "rep").agg(F.min("near").alias("near"))

    best = F.row_number().over(Window.partitionBy("query_rep").orderBy("near", "rep"))
    queries = reps.where("asked").select("rep", "v")
    bound = F.when(F.count("*") > k, F.max("near") * 1.0001 + 1e-4)
    first = met(queries.withColumn("reach", F.lit(float("inf"))), [0], min(probes, 8)).withColumn("nth", best).where(F.col("nth") <= k + 1)
    reach = materialize(first.groupBy(F.col("query_rep").alias("rep")).agg(bound.alias("reach")))
    queries = queries.join(reach, "rep", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    pairs = materialize(met(queries, list(range(curves)), probes).withColumn("nth", best).where(F.col("nth") <= 2 * (k + 1 + spare)).select("query_rep", "rep"))
    q = reps.select(F.col("rep").alias("query_rep"), F.col("v").alias("qv"))
    square = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    scored = pairs.join(q, "query_rep").join(reps, "rep").select("query_rep", "ids", F.sqrt(square).alias("score"))
    near = F.row_number().over(Window.partitionBy("query_rep").orderBy("score", F.col("ids")[0]))
    found = scored.withColumn("nth", near).where(F.col("nth") <= k + 1).drop("nth")
    # copies of a query share its list; each drops itself
    lists = found.groupBy("query_rep").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("vec_id")))))).alias("near"))
    each = asked.join(lists, "query_rep").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return each.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
