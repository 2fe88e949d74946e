"""Operators 11 to 13 against plain forms: best-first search over edits, all labellings of lines, all pairs of words."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow.llm import conversations, quality, spelling

SF = "/root/testdata/sf0.01"
CLASH = "".join(f", `{c}` string" for c in ("k", "word", "n", "part", "pos", "id", "score", "key", "x.y"))

# ---- 11: conversations ----

NEXT = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
ROLES = (("u", "user"), ("a", "assistant"))


def damaged(rows):
    said, out = lambda x: " " if x is None else str(x), []
    for conv, turn, role, text in rows:
        fault, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def repaired(rows):
    """The first goal that a best-first search by (cost, audit) takes from its queue."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "E", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(rows) and state in "EA":
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        moves = [(3, "I", i, r, f"{name}:") for r, name in ROLES]
        if i < len(rows):
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                more, (_, role, text) = 3 * (faults[i] == "truncated"), rows[i]
                moves += [(more, "K", i + 1, role[:1], f"{role}:{text}")] + [(3 + more, "R", i + 1, r, f"{name}:{text}") for r, name in ROLES]
        for paid, edit, to, initial, line in moves:
            if (state, initial) in NEXT:
                heapq.heappush(queue, (cost + paid, audit + edit, to, NEXT[state, initial], (*lines, line)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def every_repair(rows):
    by = defaultdict(list)
    for conv, *_ in rows:
        by[conv]
    for conv, *rest in damaged(rows):
        by[conv].append(tuple(rest))
    return sorted(((conv, *repaired(v)) for conv, v in by.items()), key=str)


def conversations_of(seed):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(40)]:
        for i in range(rng.choice([1, 2, 5, 9, 30, 70])):
            text = rng.choice(["A b.", "c d", "", " \t", "Why?", None, f"x{i}.", "y. ", "é!", "long " * 5000 + "end."])
            rows.append((conv, rng.choice([None, i, i, i, i // 2]), rng.choice(["user", "assistant"] * 3 + ["system", None, "tool", ""]), text))
    return rows


def digest(turns, **how):
    df = conversations.repair_digest(conversations.repair_edits(conversations.damage(turns), **how), turns)
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"whole_rows": 6, "span": 4, "fan": 3}, {"whole_bytes": 1000, "span": 5, "fan": 2}], ids=["whole", "segments", "by bytes"])
def test_repair_against_search(spark, how):
    rows = conversations_of(3)
    turns = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], "conv_id long, turn long, role string, text string" + CLASH)
    want = every_repair(rows)
    assert digest(turns, **how) == [x[:-1] for x in want]
    got = defaultdict(list)
    for r in conversations.repair_turns(conversations.damage(turns), **how).collect():
        got[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {x[0]: list(x[-1]) for x in want if x[-1]}
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digest(empty) == [] and conversations.repair_turns(empty).collect() == []
    lost = next(i for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = spark.createDataFrame([(lost, 0, "user", "gone.")], empty.schema)
    assert digest(only) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_is_dealt_out(spark):
    """One conversation of 30,000 rows: segments of 256 rows give what one pass over it gives."""
    turns = spark.range(30_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    got, = digest(turns)
    assert got == every_repair([tuple(r) for r in turns.collect()])[0][:-1]


# ---- 12: quality ----


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    counts, step = np.array([3, 1, 6, 2]), rng.normal(size=(2, 2))
    good = rng.normal(size=counts.sum())
    got, pairs = quality.forward_backward(good, counts, step)
    want, told, at = [], np.zeros((2, 2)), 0
    for n in counts:
        g, at = good[at : at + n], at + n
        weight = {y: np.exp(sum(a * b for a, b in zip(g, y, strict=True)) + sum(step[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=int(n))}
        total = sum(weight.values())
        want += [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        for y, w in weight.items():
            for a, b in itertools.pairwise(y):
                told[a, b] += w / total
    assert np.allclose(got[:, 1], want) and np.allclose(pairs, told)


def test_fit_follows_the_likelihood():
    """The gradient of the plain log-likelihood, by differences, vanishes where the fit ends."""
    rng = np.random.default_rng(1)
    counts = np.array([4, 3, 5, 2])
    x, y = rng.normal(size=(counts.sum(), 3)), rng.integers(0, 2, counts.sum())
    field = quality.LineField(np.zeros(3), np.ones(3), np.zeros(3), np.zeros((2, 2)))
    quality._descend(field, x, y, counts, 3000, 0.05)

    def loss(value):
        w, step, out, at = value[:3], value[3:].reshape(2, 2), 0.0, 0
        for n in counts:
            g, own, at = x[at : at + n] @ w, y[at : at + n], at + n
            score = lambda v: sum(a * b for a, b in zip(g, v, strict=True)) + sum(step[a, b] for a, b in itertools.pairwise(v))  # noqa: B023, E731
            out += np.log(sum(np.exp(score(v)) for v in itertools.product((0, 1), repeat=int(n)))) - score(own.tolist())
        return out / counts.sum() + 0.025 * (value**2).sum()

    value = np.concatenate([field.weights, field.step.ravel()])
    slope = [(loss(value + 1e-5 * e) - loss(value - 1e-5 * e)) / 2e-5 for e in np.eye(7)]
    assert np.abs(slope).max() < 2e-3


def test_line_features_by_plain_rules():
    text = "The the dog RAN | $$$ 12.\n\nThe the dog RAN | $$$ 12.\nÉté fini!"
    x, size = quality.line_features(text)
    assert size.tolist() == [len(t.encode()) for t in text.split("\n")]
    f = dict(zip(quality.FEATURES, x.T.tolist(), strict=True))
    assert f["symbols"] == pytest.approx([4 / 25, 0, 4 / 25, 1 / 11]) and f["upper"] == pytest.approx([4 / 12, 0, 4 / 12, 0])
    assert f["digits"] == pytest.approx([2 / 25, 0, 2 / 25, 0]) and f["marks"] == pytest.approx([1 / 7, 0, 1 / 7, 0])
    assert f["repeats"] == [0, 0, 0, 0] and f["seen"] == [0, 0, 1, 0] and f["finished"] == [1, 0, 1, 1] and f["ends"] == pytest.approx([1 / 7, 0, 1 / 7, 1 / 2])
    assert quality.line_features(None)[0].shape == quality.line_features("")[0].shape == (1, len(quality.FEATURES))


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    field = quality.learn_quality(docs.where(~fold), labels)
    rows = quality.score_quality(docs.where(fold), field).join(labels, "doc_id").select("score", "quality").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    for told in (0, 1):
        own = [r for r in rows if r.quality == told]
        assert own and sum((r.score >= 0.3) == told for r in own) >= 0.97 * len(own)
    lines = quality.label_lines(docs, field)
    mean = lines.groupBy("doc_id").agg((F.sum(F.col("good") * (F.col("n_bytes") + 1)) / F.sum(F.col("n_bytes") + 1)).alias("mean"))
    both = quality.score_quality(docs, field).join(mean, "doc_id").collect()
    assert len(both) == docs.count() and all(r.score == pytest.approx(1 / (1 + np.exp(-(field.slope * r.mean + field.shift))), abs=1e-6) for r in both)


def test_quality_edges(spark):
    rows = [(1, None), (1, ""), (None, "A text. Of two.\nLines."), (2, "x"), (2, "x"), (3, "\n\n\n"), (4, "word " * 60_000), (5, "a line.\n" * 40_000)]
    docs = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], "doc_id long, text string" + CLASH)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 0), (5, 1), (5, 0), (None, 1), (3, None)], "doc_id long, quality int")
    field = quality.learn_quality(docs, labels)
    got = quality.score_quality(docs, field).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.n_lines for r in got} == {1, 2, 4, 40_001} and len({r.score for r in got if r.doc_id == 1}) == 1
    none = quality.learn_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5} and quality.score_quality(docs.limit(0), none).collect() == []


# ---- 13: spelling ----


def counted(rows, least=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            found[run] += len(run) >= 6
    return {w: n for w, n in found.items() if n >= least}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x), default=None) for w, v in near.items()}
    form = {w: b for w, b in best.items() if b and words[b] >= 5 * words[w]}
    out = []
    for w in sorted(words):
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def test_spelling_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.word: r.n for r in spelling.count_words(docs, held=50).collect()} == words
    got = sorted(map(tuple, spelling.spelling_variants(spelling.count_words(docs)).collect()))
    assert got == variants(words) and any(r[1] for r in got)


def test_spelling_ties_chains_and_indels(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 7, 8, 9]))): rng.choice([5, 5, 6, 25, 26, 130, 700, 700, 3500, 20000]) for _ in range(600)}
    words |= {"q" * 6: 5, "q" * 7: 25, "q" * 8: 125, "q" * 9: 625, "q" * 10: 3125, "q" * 11: 15625}
    got = sorted(map(tuple, spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()))
    assert got == variants(words) and next(r[2] for r in got if r[0] == "qqqqqq") == "q" * 11


def test_spelling_edges(spark):
    rows = [(1, None), (1, ""), (None, "Wordless wordless WORDLESS wordless, wordless"), (2, "wordles_wordles wordles"), (2, "wordles wordles wordles"), (3, "tiny words only"), (4, "Äußerung äußerung " * 30_000), (5, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], "doc_id long, text string" + CLASH)
    words = counted(rows)
    assert "Äußerung" in words and "äußerung" in words
    assert sorted(map(tuple, spelling.spelling_variants(spelling.count_words(docs)).collect())) == variants(words)
    assert spelling.spelling_variants(spelling.count_words(docs.limit(0))).collect() == []
