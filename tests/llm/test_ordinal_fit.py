"""The ordinal fit of operator 10 against its likelihood written out by rows and thresholds."""

import math
import random

import numpy as np

from axisflow.llm import toxicity


def loss(weights, cuts, kinds, grades, times, l2):
    total = 0.0
    for words, grade, n in zip(kinds, grades, times, strict=True):
        score = sum(weights[w] for w in words)
        for k, cut in enumerate(cuts):
            p = 1 / (1 + math.exp(-(score - cut)))
            total -= n / sum(times) * math.log(p if grade > k else 1 - p)
    return total + l2 / 2 * sum(w * w for w in weights)


def test_no_step_from_the_fit_lowers_the_loss():
    rng = random.Random(4)
    kinds = [sorted(rng.sample(range(6), rng.randrange(4))) for _ in range(60)]
    grades = np.array([min(2, max(0, sum(w < 2 for w in k) + rng.choice([-1, 0, 0, 0, 1]))) for k in kinds])
    times, l2 = np.array([rng.randrange(1, 4) for _ in kinds]), 0.02
    w, cuts = toxicity._ordinal(kinds, grades, times, 6, 3000, l2)
    best = loss(w, cuts, kinds, grades, times, l2)
    assert cuts[0] < cuts[1]
    for i in range(6):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += d
            assert loss(moved, cuts, kinds, grades, times, l2) > best - 1e-6
    for k in range(2):
        for d in (-0.05, 0.05):
            moved = cuts.copy()
            moved[k] += d
            assert loss(w, moved, kinds, grades, times, l2) > best - 1e-6


def test_grades_come_from_both_labels(spark):
    rows = spark.createDataFrame([(t, q) for t in (0, 1, None) for q in (0, 1, None)], "toxic int, quality int")
    got = {(r.toxic, r.quality): r.g for r in rows.select("*", toxicity.grade(rows.toxic, rows.quality).alias("g")).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, None): 0, (1, 0): 2, (1, 1): 1, (1, None): 1, (None, 0): None, (None, 1): None, (None, None): None}
