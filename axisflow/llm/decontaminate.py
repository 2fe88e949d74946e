"""Operator 2 [native]: benchmark decontamination by winnowed word k-grams, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted, words_column

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1  # k-grams whose least hash is kept: any shared run of WINDOW words shares a kept one


def _grams(words, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.slice(words, i + 1, n)))).otherwise(F.array().cast("array<bigint>"))


def _winnowed(hashes) -> Column:
    """(at, h) of the k-grams that are least in some SPAN consecutive ones, the first among equals."""
    def place(i):
        span = F.slice(hashes, i + 1, SPAN)
        return (i + F.array_position(span, F.array_min(span)) - 1).cast("int")

    kept = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(hashes) - SPAN), place))
    return F.transform(kept, lambda at: F.struct(at.alias("at"), F.get(hashes, at).alias("h")))


def _whole(n: int) -> Column:
    """(n, at, h) of every run of n words, for items shorter than a window."""
    return F.transform(_grams(F.col("words"), n), lambda h, i: F.struct(F.lit(n).alias("n"), i.cast("int").alias("at"), h.alias("h")))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (n, fp, off, w) of items(item_id, text), and the items of each (w, item_id); w holds its words joined by blanks.

    An item of fewer than `window` words, but not none, is one window. fp is the least k-gram hash at off for full windows,
    and the hash of all words for short ones. Null texts have no windows; null ids are left out; equal items share windows.
    """
    words = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), words_column(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    each = words.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.slice("words", i + 1, n))).alias("run")).distinct()
    grams = _grams(F.col("run"), GRAM)
    joined = F.array_join("run", " ")
    windows = each.select("n", "run").distinct().select(
        "n", joined.alias("w"), F.when(F.col("n") == window, F.array_min(grams)).otherwise(F.xxhash64("run")).alias("fp"),
        F.when(F.col("n") == window, F.array_position(grams, F.array_min(grams)) - 1).otherwise(F.lit(0)).cast("int").alias("off"))
    return windows, each.select(joined.alias("w"), "item_id")


def _same(left: str = "", right: str = "") -> Column:
    return F.col(f"{left}doc_id").eqNullSafe(F.col(f"{right}d")) & (F.col(f"{left}tie") == F.col(f"{right}t"))


def find_contamination(docs: DataFrame, items: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, item_ids (sorted as strings), spans [start, end) in words, for every row of docs(doc_id, text).

    Winnowed fingerprints of documents meet those of the benchmark's windows by their hashes. Documents with a meeting are read again for
    the places of theirs; each is extended to the whole window, whose words must be those of a window of the benchmark. Fingerprints (20
    bytes a row) and keys of documents with meetings (16 bytes) are broadcast only up to `broadcast_rows` rows, and shuffled beyond that.
    Null texts have no words and no hits; null ids stay null; repeated rows give repeated results; other columns are ignored;
    an empty benchmark hits nothing; an empty table gives no rows.
    """
    windows, members = benchmark_windows(items)
    windows, members = materialize(windows), materialize(members)
    prints_of = materialize(windows.select("n", "fp", "off").distinct())
    per_length = prints_of.groupBy("n").count().collect()  # at most WINDOW rows
    small = sum(r["count"] for r in per_length) <= broadcast_rows
    short = sorted(r["n"] for r in per_length if r["n"] < WINDOW)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")

    def hashed(rows: DataFrame) -> DataFrame:
        words = rows.select("doc_id", "tie", words_column(F.col("text")).alias("words"))
        return words.select("doc_id", "tie", F.size("words").cast("long").alias("n_words"), "words", _grams(F.col("words"), GRAM).alias("grams"))  # n_words here, lest explode copies the words

    leasts = F.when(F.size("grams") >= SPAN, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("grams") - SPAN), lambda i: F.array_min(F.slice("grams", i + 1, SPAN)))))
    of_length = lambda hashes, n: F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))
    prints = [of_length(F.coalesce(leasts, F.array().cast("array<bigint>")), WINDOW), *(of_length(F.array_distinct(_grams(F.col("words"), n)), n) for n in short)]
    mark = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("h")))  # one row a document, hit or not
    rows = hashed(keyed).select("doc_id", "tie", "n_words", F.explode(F.concat(mark, *prints)).alias("p")).select("doc_id", "tie", "n_words", F.col("p.n").alias("pn"), "p.h")
    known = prints_of.select("n", "fp").distinct()
    met = (F.col("h") == F.col("fp")) & (F.col("pn") == F.col("n"))
    if small:
        joined = rows.join(F.broadcast(known), met, "left").where(F.col("fp").isNotNull() | (F.col("pn") == 0)).select("doc_id", "tie", "n_words", "fp")
    else:
        joined = rows.where("pn > 0").join(known, met).select("doc_id", "tie", "n_words", "fp").unionByName(rows.where("pn = 0").select("doc_id", "tie", "n_words", F.col("h").alias("fp")))
    joined = materialize(joined)  # a row a document without fp, and a row a meeting
    keys = materialize(joined.where("fp IS NOT NULL").select(F.col("doc_id").alias("d"), F.col("tie").alias("t")).distinct())
    keys = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    again = materialize(keyed.join(keys, _same(), "left_semi"))  # documents with meetings: where these are
    full = F.when(F.size("grams") >= SPAN, F.transform(_winnowed(F.col("grams")), lambda x: F.struct(F.lit(WINDOW).alias("n"), x["at"].alias("at"), x["h"].alias("h"))))
    placed = F.concat(F.coalesce(full, F.array().cast("array<struct<n:int,at:int,h:bigint>>")), *(_whole(n) for n in short))
    placed = hashed(again).select("doc_id", "tie", "n_words", F.explode(placed).alias("p")).select("doc_id", "tie", "n_words", F.col("p.n").alias("pn"), "p.at", "p.h")
    start = F.col("at") - F.col("off")
    starts = placed.join(F.broadcast(prints_of) if small else prints_of, met).where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    starts = materialize(starts.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.collect_set(F.struct(start.alias("start"), "n")).alias("starts")))
    texts = again.join(starts, _same()).select("doc_id", "tie", "starts", words_column(F.col("text")).alias("words"))
    runs = texts.select("doc_id", "tie", F.explode(F.transform("starts", lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end"), F.array_join(F.slice("words", s["start"] + 1, s["n"]), " ").alias("w")))).alias("run"))
    hits = materialize(runs.select("doc_id", "tie", "run.*").join(windows.select("w"), "w").distinct())

    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")))
    by = [F.col("doc_id").alias("d"), F.col("tie").alias("t")]
    covered = hits.groupBy(*by).agg(spans.alias("spans")).withColumn("n_hit", merged["n"].cast("long"))
    of_doc = hits.select(*by, "w").distinct().join(members, "w").groupBy("d", "t").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    of_doc = of_doc.toDF("doc_id", "tie", "item_ids").join(covered, _same()).select("d", "t", "spans", "n_hit", "item_ids")
    every = joined.where("fp IS NULL").groupBy("doc_id", "tie", "n_words").agg(F.count("*").cast("int").alias("times"))
    both = every.join(of_doc, _same(), "left")
    return both.select(
        "doc_id", F.col("tie").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")


def contamination_digest(found: DataFrame, *more: str) -> DataFrame:
    """The contract's columns from find_contamination, a row for each of its rows; a document without words is not contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *more)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that the contract's rule does not call contaminated, with their columns.

    Each row is judged by its own text, also where ids are repeated or null; null and empty texts stay; an empty table gives no rows.
    """
    found = find_contamination(docs, items)
    bad = contamination_digest(found, "text_hash").where("contaminated").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("own"), F.struct(*quoted(docs)).alias("row"))  # no name can clash
    return rows.join(bad, F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")), "left_anti").select("row.*")
