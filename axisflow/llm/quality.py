"""Operator 12: document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FEATURES = ("symbols", "upper", "digits", "repeats", "variety", "marks", "ends", "finished", "word_size", "size", "seen")
_BYTE = np.full(256, 4)  # symbol
_BYTE[[9, 10, 11, 12, 13, 32]], _BYTE[48:58], _BYTE[65:91], _BYTE[97:123], _BYTE[128:] = 0, 1, 2, 3, 3
_PLAIN = np.isin(np.arange(256), [ord(c) for c in ".,'"])


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) and the lines' lengths in bytes, of a whole text; null and empty texts are one empty line.

    Shares of symbols, upper-case letters, digits, words like the one before, words that are single marks, words that end a sentence;
    variety of words; whether the line ends a sentence and stood before in the text; lengths of words and of the line.
    """
    lines = (text or "").split("\n")
    raw = np.frombuffer((text or "").encode("utf-8", "replace") + b"\n", np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 10)[:-1] + 1])
    kinds = _BYTE[raw]
    count = lambda hit: np.add.reduceat(hit.astype(np.int64), starts)
    symbols, digits, upper, letters = count((kinds == 4) & ~_PLAIN[raw]), count(kinds == 1), count(kinds == 2), count((kinds == 2) | (kinds == 3))
    size = np.diff(np.append(starts, len(raw))) - 1
    said, seen = np.zeros((len(lines), 6)), set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
            marks = sum(len(w) == 1 and not w.isalnum() for w in words)
            ends = sum(w[-1] in ".!?" for w in words)
            said[i] = repeats / n, np.log1p(len(set(words))) / np.log1p(n), marks / n, ends / n, words[-1][-1] in ".!?", line in seen
            seen.add(line)
    words = np.maximum(count((kinds > 0) & np.concatenate([[True], kinds[:-1] == 0])), 1)
    shares = [symbols / np.maximum(size, 1), upper / np.maximum(letters, 1), digits / np.maximum(size, 1), said[:, 0], said[:, 1], said[:, 2], said[:, 3], said[:, 4], np.log1p(size / words), np.log1p(size), said[:, 5]]
    return np.stack(shares, 1).astype("f4"), size


def around(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of its neighbours in the text (zero beyond its ends), and a one."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[first + counts - 1] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], 1)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def forward_backward(good: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, 2) marginals of bad and good, and the (2, 2) expected transitions summed over all texts.

    `good` is each line's log-odds, `step` the scores of going from the one label to the other; texts stand one behind the other
    with counts[i] >= 1 lines. All texts advance together, a line at a time.
    """
    emit = np.stack([np.zeros_like(good), good], 1)
    order = np.argsort(-counts, kind="stable")
    first, long = (np.cumsum(counts) - counts)[order], counts[order]
    alpha, beta = emit.copy(), np.zeros_like(emit)
    alive = [int(np.searchsorted(-long, -t, side="left")) for t in range(int(long[0]))] if len(long) else []  # texts of more than t lines
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        alpha[at] += _lse(alpha[at - 1][:, :, None] + step[None], 1)
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        beta[at - 1] = _lse(step[None] + (emit[at] + beta[at])[:, None, :], 2)
    both = alpha + beta
    whole = _lse(both, 1)
    later = np.ones(len(good), bool)
    later[first] = False
    j = np.flatnonzero(later)
    pairs = np.exp(alpha[j - 1][:, :, None] + step[None] + (emit[j] + beta[j])[:, None, :] - whole[j][:, None, None])
    return np.exp(both - whole[:, None]), pairs.sum(0)


@dataclass
class LineField:
    """Scores of good lines, weights * features, between transitions `step`; quality = sigmoid(slope * mean + shift) of the mean marginal."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def inputs(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return around(((x - self.mean) / self.scale).clip(-4, 4), counts)

    def lines(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The marginal of good for every line."""
        return forward_backward(self.inputs(x, counts) @ self.weights, counts, self.step)[0][:, 1]

    def quality(self, x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _mean_marginal(self.lines(x, counts), sizes, counts) + self.shift, -40, 40)))


def _mean_marginal(good: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means over each text's lines, weighted by their bytes and one."""
    first, w = np.cumsum(counts) - counts, sizes + 1
    return np.add.reduceat(good * w, first) / np.add.reduceat(w, first) if len(counts) else np.zeros(0)


def _descend(field: LineField, x: np.ndarray, y: np.ndarray, counts: np.ndarray, steps: int, l2: float) -> None:
    """Fits weights and transitions to line labels y by Adam on the whole sample's mean log-likelihood."""
    first = np.cumsum(counts) - counts
    later = np.ones(len(y), bool)
    later[first] = False
    j = np.flatnonzero(later)
    told = np.zeros((2, 2))
    np.add.at(told, (y[j - 1], y[j]), 1)
    value = np.concatenate([field.weights, field.step.ravel()])
    m, v, n = np.zeros_like(value), np.zeros_like(value), len(field.weights)
    for k in range(1, steps + 1):
        p, pairs = forward_backward(x @ value[:n], counts, value[n:].reshape(2, 2))
        slope = np.concatenate([x.T @ (p[:, 1] - y), (pairs - told).ravel()]) / len(y) + l2 * value
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        value -= 0.1 / (1 + k / 100) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.weights, field.step = value[:n], value[n:].reshape(2, 2)


def fit_lines(x: np.ndarray, sizes: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 80, l2: float = 1e-4) -> LineField:
    """A field from texts' lines (x, sizes; counts[i] lines of text i) and their labels, 1 good or 0 bad.

    Lines take their text's label at first. Then a bad text's lines that the field calls good count as good, but for its worst one, and the
    field is fitted again. Texts of one label only give a field that scores all texts alike, with that label's share.
    """
    k = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(k), np.ones(k))
    field = LineField(mean, scale, np.zeros(3 * k + 1), np.zeros((2, 2)))
    if len(set(label.tolist())) < 2:
        field.slope, field.shift = 0.0, float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5)))
        return field
    inputs, first = field.inputs(x, counts), np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    y = label[of]
    for r in range(rounds):
        _descend(field, inputs, y, counts, steps, l2)
        if r + 1 < rounds:
            good = forward_backward(inputs @ field.weights, counts, field.step)[0][:, 1]
            worst = np.minimum.reduceat(good, first)[of]
            y = np.where(label[of] == 1, 1, ((good > 0.5) & (good > worst)).astype(int))
    m = _mean_marginal(forward_backward(inputs @ field.weights, counts, field.step)[0][:, 1], sizes, counts)
    a = b = 0.0
    for _ in range(50):  # Newton steps of a logistic regression on the mean marginal
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * m * m).sum() + 0.01, (s * m).sum()], [(s * m).sum(), s.sum() + 0.01]])
        da, db = np.linalg.solve(h, [((label - p) * m).sum() - 0.01 * a, (label - p).sum() - 0.01 * b])
        a, b = a + da, b + db
    field.slope, field.shift = float(a), float(b)
    return field


def _lines_of(texts: Iterable[str | None], size: int = 4 << 20) -> Iterator[tuple[list, list, list]]:
    """Features and sizes of texts, and their numbers of lines, in runs of about `size` characters."""
    xs, sizes, counts, held = [], [], [], 0
    for text in texts:
        x, s = line_features(text)
        xs.append(x)
        sizes.append(s)
        counts.append(len(s))
        held += len(text or "")
        if held >= size:
            yield xs, sizes, counts
            xs, sizes, counts, held = [], [], [], 0
    if counts:
        yield xs, sizes, counts


def learn_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, max_lines: int = 400_000) -> LineField:
    """A field from docs(doc_id, text) that labels(doc_id, quality 0 or 1) marks.

    At most about `max_rows` labelled documents and `max_lines` of their lines, chosen by the hash of the id, are learned from: a labelled
    sample, on the driver as numbers. Ids without a text or label do not count; nor do ids with two labels; repeated rows count each time.
    No labelled document: every text scores 0.5.
    """
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality").select("id", F.col("quality").cast("int").alias("quality"))
    told = materialize(told)
    share = lambda seed, part: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * part)
    some = told.where(share(12, min(1.0, max_rows / max(1, told.count()))))  # max_rows ids at most about: small enough to broadcast

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = [line_features(t) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "quality": f["quality"], "x": [a.tobytes() for a, _ in x], "size": [s.astype("<i8").tobytes() for _, s in x], "lines": [len(s) for _, s in x]})

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(some), "id").select("id", "text", "quality")
    found = materialize(rows.mapInPandas(run, "id long, quality int, x binary, size binary, lines long"))
    lines = found.agg(F.sum("lines")).first()[0] or 0
    sample = found.where(share(13, min(1.0, max_lines / max(1, lines)))).orderBy("id", "x").collect()  # max_lines lines at most about
    join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in sample), kind)
    return fit_lines(join("x", "<f4").reshape(-1, len(FEATURES)).astype(float), join("size", "<i8"), np.array([r["lines"] for r in sample], int), np.array([r["quality"] for r in sample], int))


def score_quality(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and n_lines for every row of docs(doc_id, text), from its whole text.

    Null and empty texts score as one empty line; null ids stay null; repeated rows give repeated results; other columns are ignored; an
    empty table gives no rows; no shuffle.
    """
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores, lines = [], []
            for xs, sizes, counts in _lines_of(f["text"]):
                scores.append(field.quality(np.concatenate(xs).astype(float), np.concatenate(sizes), np.array(counts)))
                lines += counts
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": np.concatenate(scores) if scores else [], "n_lines": lines})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, score double, n_lines long").withColumn("doc_id", F.col("doc_id").cast("long"))


def label_lines(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, line (from 0), good (the marginal), n_bytes: every line of docs(doc_id, text). Edge cases as in score_quality."""
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, done = f["doc_id"].to_numpy(), 0
            for xs, sizes, counts in _lines_of(f["text"]):
                good = field.lines(np.concatenate(xs).astype(float), np.array(counts))
                yield pd.DataFrame({"doc_id": np.repeat(ids[done : done + len(counts)], counts), "line": np.concatenate([np.arange(n) for n in counts]), "good": good, "n_bytes": np.concatenate(sizes)})
                done += len(counts)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, line long, good double, n_bytes long").withColumn("doc_id", F.col("doc_id").cast("long"))
