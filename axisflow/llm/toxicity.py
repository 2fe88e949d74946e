"""Operator 10: toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, materialize

WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words of the whole text."""
    return set(WORD.findall((text or "").translate(ASCII_LOWER)))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(score - cuts[k]) with one weight vector for all thresholds; P(grade > 0) from `reject` on is toxic."""

    weights: dict[str, float]
    cuts: np.ndarray
    reject: float = 0.5

    def above(self, text: str | None) -> np.ndarray:
        get = self.weights.get
        score = sum(get(w, 0.0) for w in sorted(features(text)))
        return 1.0 / (1.0 + np.exp(-np.clip(score - self.cuts, -40, 40)))


def grade(toxic, quality):
    """0: not toxic; 1: toxic in an otherwise good document; 2: toxic in a poor one."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1))


def _ordinal(kinds: list[list[int]], y: np.ndarray, times: np.ndarray, size: int, steps: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of `size` words and cuts, by gradient descent; row i has the words kinds[i], the grade y[i] and counts times[i] times."""
    doc, code = np.repeat(np.arange(len(y)), [len(w) for w in kinds]), np.array([w for k in kinds for w in k], dtype=int)
    top = int(y.max())
    target = (y[:, None] > np.arange(top)[None, :]).astype(float)
    part = (times / times.sum())[:, None]
    share = (target * part).sum(0).clip(1e-4, 1 - 1e-4)
    cuts, w = -np.log(share / (1 - share)), np.zeros(size)
    m, v = np.zeros(size + top), np.zeros(size + top)
    for t in range(1, steps + 1):
        score = np.bincount(doc, w[code], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
        gap = (p - target) * part
        g = np.concatenate([np.bincount(code, gap.sum(1)[doc], minlength=size) + l2 * w, -gap.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, cuts = w - step[:size], cuts - step[size:]
        cuts = np.maximum.accumulate(cuts)  # thresholds stay in order
    return w, cuts


def _reject_cut(score: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> float | None:
    """The score from which on the rows rejected have the best F1, just above the next lower one; None if no cut hits a toxic row."""
    levels = np.unique(score)
    if len(levels) < 2 or not toxic.any():
        return None
    hit = np.array([times[toxic & (score >= x)].sum() for x in levels[1:]])
    every = np.array([times[score >= x].sum() for x in levels[1:]])
    best = int(np.argmax(2 * hit / (every + times[toxic].sum())))  # of equal ones the lowest
    return float(0.9 * levels[best] + 0.1 * levels[best + 1]) if hit[best] else None


def fit(
    labelled: DataFrame, max_rows: int = 20_000, min_docs: int = 5, min_z: float = 4.0, steps: int = 2000, l2: float = 1e-5, min_purity: float = 0.8
) -> Ordinal:
    """Fits labelled(doc_id, text, grade) by gradient descent on a hash sample of about `max_rows` rows (all, if fewer).

    Rows without a grade teach nothing; equal texts count once, with their most frequent grade. Only words get a weight that
    stand in at least `min_docs` toxic texts, of whose texts `min_purity` at least are toxic, and whose share of toxic texts is
    `min_z` standard deviations above the whole share. A fit without a fifth of the texts, its words chosen without them too,
    sets the cut from which on documents are rejected by its F1 on that fifth; the weights come from all texts. Without two
    grades to tell apart, every document gets the lowest one. Words are counted by Spark; the sample's rows reach the
    driver as the numbers of the few words that can get a weight.
    """
    rows = labelled.where(F.col("grade").isNotNull())
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("grade").cast("int").alias("grade"))
    rows = rows.groupBy("text").agg(F.mode("grade", True).alias("grade")).withColumn("held", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(5)) == 0)
    rows = materialize(rows)  # read three times
    sizes = rows.agg(
        F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("int")).alias("toxic"), F.countDistinct("grade").alias("grades"),
        F.count(F.when(~F.col("held"), 1)).alias("n_fit"), F.count(F.when(~F.col("held") & (F.col("grade") > 0), 1)).alias("toxic_fit")).first()
    if sizes["grades"] < 2:
        return Ordinal({}, np.array([40.0]))

    def tally(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts = [Counter() for _ in range(4)]  # seen, toxic; the same without the held-out texts
            for text, g, held in zip(f["text"], f["grade"], f["held"], strict=True):
                words = features(text)
                for at in (0,) if held else (0, 2):
                    counts[at].update(words)
                    if g > 0:
                        counts[at + 1].update(words)
            yield pd.DataFrame({"word": list(counts[0])} | {k: [c[w] for w in counts[0]] for k, c in zip(("seen", "toxic", "seen_fit", "toxic_fit"), counts, strict=True)})

    def telling(seen: str, toxic: str, n: int, n_toxic: int):
        share = n_toxic / max(n, 1)
        odd = F.col(toxic) - F.col(seen) * share >= min_z * F.sqrt(F.col(seen) * (share * (1 - share)))
        return (F.col(toxic) >= min_docs) & (F.col(toxic) >= min_purity * F.col(seen)) & odd

    counts = rows.mapInPandas(tally, "word string, seen long, toxic long, seen_fit long, toxic_fit long")
    counts = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("seen", "toxic", "seen_fit", "toxic_fit")))
    counts = counts.select("word", telling("seen", "toxic", sizes["n"], sizes["toxic"]).alias("whole"), telling("seen_fit", "toxic_fit", sizes["n_fit"], sizes["toxic_fit"]).alias("part"))
    chosen = counts.where("whole or part").collect()
    vocabulary = sorted(r["word"] for r in chosen)
    place = {w: i for i, w in enumerate(vocabulary)}

    def number(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"held": f["held"], "grade": f["grade"], "words": [sorted(place[w] for w in features(t) if w in place) for t in f["text"]]})

    sample = rows.mapInPandas(number, "held boolean, grade int, words array<int>").groupBy("held", "grade", "words").count().collect()
    sample.sort(key=lambda r: (r["held"], r["grade"], r["words"]))  # the sample's order must not matter
    times, y, held = (np.array([r[c] for r in sample]) for c in ("count", "grade", "held"))

    def learn(use: np.ndarray, which: str) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        known = {place[r["word"]] for r in chosen if r[which]}
        kinds = [[w for w in r["words"] if w in known] for r in sample]
        return kinds, *_ordinal([k for k, u in zip(kinds, use, strict=True) if u], y[use], times[use], len(vocabulary), steps, l2)

    cut = None
    if y[~held].any() and held.any():
        kinds, w, _ = learn(~held, "part")
        cut = _reject_cut(np.array([w[k].sum() for k in kinds])[held], y[held] > 0, times[held])
    _, w, cuts = learn(np.ones(len(y), bool), "whole")
    reject = 0.5 if cut is None else float(1 / (1 + np.exp(-np.clip(cut - cuts[0], -40, 40))))
    return Ordinal({r["word"]: float(w[place[r["word"]]]) for r in chosen if r["whole"]}, cuts, reject)


def score_toxicity(docs: DataFrame, model: Ordinal, threshold: float | None = None) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (P(grade > 0)), toxic (p_toxic >= threshold) of every row, from whole texts.

    Without a threshold the model's cut decides.
    Null or empty texts have no words, so only the thresholds speak. Repeated rows give repeated results; null ids stay
    null; other columns are ignored; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = [shared.value.above(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "severity": [float(x.sum()) for x in p], "p_toxic": [float(x[0]) for x in p]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(run, "doc_id string, severity double, p_toxic double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("toxic", F.col("p_toxic") >= (model.reject if threshold is None else threshold))


def train_from_labels(docs: DataFrame, labels: DataFrame) -> Ordinal:
    """fit() on the documents of docs(doc_id, text) that labels(doc_id, toxic, quality) marks.

    The labels tell whether a text is toxic, not how much: grades above 0 differ by quality only. Null ids and labels do not count;
    an id with several rows or labels counts with each pair; null and empty texts have no words; other columns are ignored.
    """
    marks = labels.select("doc_id", grade(F.col("toxic"), F.col("quality")).alias("grade")).where(F.col("grade").isNotNull())
    return fit(docs.select("doc_id", "text").join(marks, "doc_id"))


def drop_toxic(docs: DataFrame, model: Ordinal, threshold: float | None = None) -> DataFrame:
    """The rows of docs that the model does not reject, with their columns; no shuffle.

    Each row is judged by its own text, also where ids are repeated or null. Null and empty texts have no words, so only the
    thresholds speak; a score equal to the threshold is rejected; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def p_toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([float(shared.value.above(t)[0]) for t in texts], dtype="float64")

    return docs.where(p_toxic(F.col("text")) < (model.reject if threshold is None else threshold))
