"""Operator 6: near-duplicate documents by banded SetSketch registers, a likelihood estimate and exact verification."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

SHINGLE = 5
BANDS, ROWS = 40, 5  # at similarity 0.75 all bands of a pair differ with probability 2e-5, less for nearer pairs
BASE, RATE = 1.1, 20.0  # of the registers' exponential spacing
MARGIN = 0.2  # about six standard deviations of the estimate at 200 registers


@functools.cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    m = BANDS * ROWS
    return rng.integers(0, 2**32, m, dtype=np.uint32), rng.integers(0, 2**31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's 5-word shingles; of all words, if fewer; nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers: max over elements of floor(1 - log_b x), x exponential with rate RATE; 8 bits each, mergeable by max.

    The register is a falling step function of the least x, and so of the least uniform hash, which is what is kept per element.
    """
    flips, odds = _seeds()
    least = np.full(len(flips), np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), 128):  # a block stays in the processor's cache
        h = short[a : a + 128, None] ^ flips
        h *= odds
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


@functools.cache
def _grid() -> np.ndarray:
    return np.linspace(0.005, 0.995, 100)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair, jointly from registers that are above, below and equal, and both set sizes."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.minimum(_grid()[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    over, under = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    same = np.clip(1 - over - under, 1e-12, 1)
    likely = up * np.log(over) + down * np.log(under) + (a.shape[1] - up - down) * np.log(same)
    return j[np.arange(len(j)), likely.argmax(1)]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (64-bit hash of the whole set; null without words), regs, of every row."""
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                s = shingles(text)
                out.append((doc, len(s), str(_node(s)) if len(s) else None, registers(s).tobytes() if len(s) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "node", "regs"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_shingles long, node string, regs binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("node", F.col("node").cast("long"))


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, n, hashes) of the classes in nodes(node): the whole shingle set, from one text each.

    It is the text of the class's smallest doc_id; where that id is repeated, the hash of the set tells the right row.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = reps.join(nodes, "node").select("node", "doc_id", "repeated").join(texts, "doc_id").select("node", "text", "repeated")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(n, s) for n, t in zip(part.column("node").to_pylist(), part.column("text").to_pylist(), strict=True) if _node(s := shingles(t)) == n]
                sets = [s.view(np.int64) for _, s in found]
                ends = np.cumsum([0, *map(len, sets)])
                values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["node", "n", "hashes"])

    form = "node long, n long, hashes array<long>"
    several = texts.where("repeated").select("node", "text").mapInArrow(run, form).dropDuplicates(["node"])
    return texts.where(~F.col("repeated")).select("node", "text").mapInArrow(run, form).unionByName(several)


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Those of pairs (a, b) whose whole sets have 100 * intersection >= share * union."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("hashes").alias(f"hashes_{x}"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return pairs.join(side("b"), "b").join(side("a"), "a").where((100 + share) * both >= share * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """All pairs (a, b) of nodes(node, root) with different roots that may reach the similarity: an exact set-similarity join.

    Shingles are put in one order: those that only one component has, which match nothing, then the others, rare ones first.
    Two sets that are similar enough have their first common shingle so early in both that what follows it can still fill
    the intersection; that bounds the prefix that is joined and the place of the match. In texts made from one template the
    few changed words fill the prefix, so that the template itself is not joined. Of each shingle's rows only those
    outside its most frequent component meet all its rows: members of one component are never paired.
    """
    tokens = nodes.join(sets, "node").select("node", "root", "n", F.explode("hashes").alias("s"))
    shared = materialize(tokens.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s", "df"))
    own = tokens.join(shared, "s").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("known"))
    first = (F.col("n") - F.size("known")).alias("first")
    placed = own.select("node", "root", "n", first, F.posexplode("known").alias("at", "x"))
    places = placed.select(F.col("x.s").alias("s"), "node", "root", F.col("n"), (F.col("n") - F.col("first") - F.col("at")).alias("left"))
    places = materialize(places.where(100 * F.col("left") >= share * F.col("n")))
    main = places.groupBy("s", "root").count().groupBy("s").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    main = materialize(main.select("s", "main"))
    odd = places.join(main, "s").where("root <> main").select("s", "main", *(F.col(c).alias(f"{c}_1") for c in ("node", "root", "n", "left")))
    odd, every = materialize(odd), places.join(main.select("s"), "s", "left_semi")
    once = (F.col("root") == F.col("main")) | (F.col("node_1") < F.col("node"))
    fits = (100 + share) * F.least("left_1", "left") >= share * (F.col("n_1") + F.col("n"))
    return odd.join(every, "s").where((F.col("root_1") != F.col("root")) & once & fits).select(F.least("node_1", "node").alias("a"), F.greatest("node_1", "node").alias("b")).distinct()


def _likely(pairs: DataFrame, reps: DataFrame, share: int) -> DataFrame:
    """Pairs whose registers make a similarity near the threshold possible."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                regs = [np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("regs_a", "regs_b")]
                j = estimate(*regs, f["n_a"].to_numpy(float), f["n_b"].to_numpy(float))
                yield f.loc[j >= share / 100 - MARGIN, ["a", "b"]]

    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * share  # no link is possible otherwise
    return pairs.join(side("b"), "b").join(side("a"), "a").where(sizes).mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b), root the least node reached; large-star and small-star by grouped minima.

    The minima are written before they are joined, so that Spark can split the rows of a node with very many edges.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # finished when every node has one edge down, and what it leads to has none
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.down").alias("down"), F.count("*").alias("all"))
        if ends.where("down > 1 OR down > 0 AND down < all").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.toDF("u", "v")).where("u <> v").distinct()
        edges = materialize(small)


def _merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """of(node, root) after links (a, b) between its nodes; the roots alone are joined anew."""
    root = lambda x: of.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    links = materialize(links)
    if links.isEmpty():
        return of
    between = links.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    new = components(between).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return materialize(of.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root")))


def _mixed(members: DataFrame, of: DataFrame) -> DataFrame:
    """(bucket, node, root) of the buckets whose members are in several components."""
    placed = members.join(of, "node")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    return materialize(placed.join(mixed, "bucket").select("bucket", "node", "root"))


def near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text): documents linked at share % similarity.

    Rows with equal sets are one class. Classes that agree in a band of registers are candidates. First each class of a bucket is
    compared with the bucket's least class, then the classes outside the bucket's best-linked component with the class that has most
    links: as many pairs as members. What then still shares a bucket across components is settled by an exact
    set-similarity join of prefixes, so nothing is capped and no group is paired as a whole. Candidates of the first two rounds
    pass the likelihood estimate; all are verified on whole sets.
    Null, empty and blank texts have 0 shingles and are their own component; a null doc_id is linked with nothing, with a
    null component_id and kept; rows that repeat a doc_id are judged by their own texts; other columns are ignored; an empty
    table gives no rows.
    """
    return _judged(docs, share).drop("node", "root")


def _judged(docs: DataFrame, share: int) -> DataFrame:
    """near_duplicates with the node and the root of each row's class."""
    rows = materialize(sketch(docs))
    some = rows.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    reps = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n_shingles"))
    several = some.groupBy("doc_id").agg((F.count("*") > 1).alias("repeated"))  # only such a text is checked against its node
    reps = materialize(reps.join(several, "doc_id"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * ROWS + 1, F.lit(ROWS))))
    members = reps.select("node", F.explode(bands).alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").select("bucket", "centre")
    crowded = materialize(members.join(centres, "bucket"))
    nodes = crowded.select("node").distinct()
    sets = materialize(_sets(nodes, reps, docs))

    star = crowded.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(_verified(_likely(star, reps, share), sets, share))
    of = _merged(materialize(nodes.withColumn("root", F.col("node"))), links)

    left = _mixed(crowded.select("bucket", "node"), of)
    if not left.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        ranked = left.join(degree, "node", "left").withColumn("best", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("node").alias("hub"), F.col("root").alias("main")))
        hubs = materialize(ranked.groupBy("bucket").agg(F.max("best").alias("best")).select("bucket", "best.hub", "best.main"))
        more = left.join(hubs, "bucket").where("root <> main").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        of = _merged(of, _verified(_likely(more, reps, share), sets, share))
        open_nodes = materialize(_mixed(left.select("bucket", "node"), of).select("node", "root").distinct())
        of = _merged(of, _verified(_prefix_pairs(open_nodes, sets, share), sets, share))

    classes = materialize(reps.select("node", "doc_id").join(of, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = materialize(classes.groupBy("root").agg(F.min("doc_id").alias("component")))
    of_node = classes.join(least, "root").select("node", "component", "root")
    out = some.join(of_node, "node").select("doc_id", "n_shingles", F.col("component").alias("component_id"), "node", "root")
    rest = rows.where(F.col("node").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node", F.lit(None).cast("long").alias("root"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, share: int = 75) -> DataFrame:
    """The rows of docs that stand for their group, with their columns; null ids stay, and of rows equal in id and set one stays.

    Rows that repeat an id with different texts are judged each by its own text; where several texts of one group have its least
    id, the one with the least set hash stays.
    """
    kept = _judged(docs, share).where("kept").where(F.col("doc_id").isNotNull())
    # the node of the group's row; groups that share a least id are told apart by the root
    kept = materialize(kept.groupBy("doc_id", "root").agg(F.min("node").alias("own")).select(F.col("doc_id").alias("id"), "own"))
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.struct(*quoted(docs)).alias("row"))  # no name can clash
    times = known.groupBy("id").agg((F.count("*") > 1).alias("repeated"))
    several = times.join(kept.select("id").distinct(), "id", "left_semi")
    rows = known.join(several, "id")
    once = rows.where(~F.col("repeated")).select("row.*")

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        sets = (shingles(t) for t in texts)
        return pd.Series([_node(s) if len(s) else None for s in sets], dtype="Int64")

    # texts are read a second time only where an id is repeated
    more = rows.where("repeated").select("id", "row", node("row.text").alias("node"))
    more = more.join(kept.withColumnRenamed("id", "wanted"), (F.col("id") == F.col("wanted")) & F.col("node").eqNullSafe(F.col("own")), "left_semi")
    more = more.dropDuplicates(["id", "node"]).select("row.*")
    return once.unionByName(more).unionByName(docs.where(F.col("doc_id").isNull()))
