"""Operator 5: language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
BITS = 21  # of a code point; a gram is up to three of them in one long
BLANK = 1  # no letter, and not 0, so that grams of different lengths differ


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 characters, and their counts, over words padded with a blank on both sides."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.concatenate([[BLANK], np.where(_letters()[points], points, BLANK), [BLANK]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != BLANK) | (points[:-1] != BLANK)
    p = points[keep]
    two = (p[:-1] << BITS) | p[1:]
    three = (two[:-1] << BITS) | p[2:]
    codes = np.concatenate([p[p != BLANK], two[two != (BLANK << BITS | BLANK)], three[p[1:-1] != BLANK]])
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Most frequent first; ties in the order of the grams."""
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(training: DataFrame, max_rows: int = 20_000, size: int = PROFILE) -> dict[str, np.ndarray]:
    """lang -> grams in the order of their rank, from training(doc_id, text, lang).

    The fit uses a hash sample of about `max_rows` labelled rows (all, if fewer); what reaches the driver is `size`
    grams a language. Rows without text, language or any letter teach nothing.
    """
    rows = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))

    def tally(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 500):
                for lang, g in f.iloc[a : a + 500].groupby("lang"):
                    codes, counts = grams(" ".join(g["text"]))
                    yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})

    counts = rows.select("lang", "text").mapInPandas(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best: dict[str, list[tuple[int, int]]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).collect():
        best.setdefault(r.lang, []).append((r["rank"], r.gram))
    return {lang: np.array([g for _, g in sorted(x)], np.int64) for lang, x in best.items()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs(doc_id, text), by the smallest out-of-place distance over whole texts.

    A gram missing from a profile costs `size` places. score: 1 - distance / worst distance. Ties go to the alphabetically
    first language. Null texts, texts without a letter and an empty set of profiles give `und` with score 0.
    Repeated rows give repeated results; null ids stay null; other columns are ignored; no shuffle.
    """
    langs = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast([(np.sort(profiles[k]), np.argsort(profiles[k])) for k in langs])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def predict(text: str | None) -> tuple[str, float]:
            top = ranked(*grams(text), size) if text else ()
            if not len(top) or not langs:
                return "und", 0.0
            here, costs = np.arange(len(top)), []
            for codes, rank in shared.value:
                at = np.searchsorted(codes, top).clip(0, len(codes) - 1)
                costs.append(int(np.where(codes[at] == top, np.abs(rank[at] - here), size).sum()))
            best = int(np.argmin(costs))
            return langs[best], max(0.0, 1.0 - costs[best] / (size * len(top)))

        for f in frames:
            found = [predict(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(run, "doc_id string, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
