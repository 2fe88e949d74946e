"""Null and repeated ids, null and empty texts, empty tables, clashing extra columns, long texts and ties; operators 5 and 10 by plain rules."""

import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from axisflow.llm import decontaminate, language, licenses, near_dup, secrets, tokens, toxicity
from tests.llm import brute as B

CLASH = ["_base", "_tokens", "_hit", "_bad", "_kept", "base_spans", "has_secret", "node", "root", "id", "row", "kept", "repeated", "tie", "words", "spans", "n_words", "length", "grade", "severity", "toxic", "lang_pred", "dotted.name"]
ROWS = [(1, "alpha beta gamma delta epsilon zeta"), (1, "an other text"), (2, None), (2, None), (3, ""), (None, "no id here"), (None, None), (4, "twice the same"), (4, "twice the same"), (5, "token = 24be64439e3e49cf46b2d7c90f3602a3")]
ITEMS = [(1, "an item that nobody has in any text"), (None, "twice the same"), (2, None)]
MODEL = toxicity.Ordinal({"vile": 3.0}, toxicity.np.array([1.0, 2.0]))


def table(spark, rows, clash=True):
    extra = CLASH if clash else []
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *["x"] * len(extra)) for d, t in rows], schema)


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


OPERATORS = {
    "op1": lambda docs: tokens.count_tokens(docs),
    "op2": lambda docs: decontaminate.contamination_digest(decontaminate.find_contamination(docs, items(docs.sparkSession))),
    "op3": lambda docs: tokens.pack(docs).drop("sequence_id", "offset"),
    "op5": lambda docs: language.identify(docs, language.learn_profiles(docs)),
    "op6": lambda docs: near_dup.near_duplicates(docs),
    "op7": lambda docs: secrets.secret_digest(secrets.find_secrets(docs)),
    "op8": lambda docs: licenses.license_digest(licenses.scan_licenses(docs)),
    "op10": lambda docs: toxicity.score_toxicity(docs, MODEL),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    run = OPERATORS[name]
    got, plain = run(table(spark, ROWS)).collect(), run(table(spark, ROWS, clash=False)).collect()
    assert sorted(map(str, got)) == sorted(map(str, plain))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in ROWS)
    assert run(table(spark, [])).count() == 0


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "toxicity"], ids=lambda s: s[0])
def test_stages_keep_columns(spark, stage, monkeypatch):
    name, run = stage
    monkeypatch.setattr(corpus_pipeline, "load", lambda spark, folder, table: items(spark))
    docs = table(spark, ROWS)
    out = run(spark, docs, "")
    got = sorted(str(r.doc_id) for r in out.collect())
    want = sorted(str(d) for d, _ in ROWS)
    if name == "near_dedup":  # rows equal in id and set count once
        want = sorted(["1", "1", "2", "3", "4", "5", "None", "None"])
    assert got == want
    if name != "packing":
        assert out.columns == docs.columns
    assert run(spark, table(spark, []), "").count() == 0


def test_toxicity_stage_keeps_columns(spark):
    docs = table(spark, [*ROWS, (9, "a vile text"), (None, "vile")])
    out = toxicity.drop_toxic(docs, MODEL)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(d) for d, _ in ROWS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, toxicity.train_from_labels(docs, labels)).count() == len(ROWS) + 2


def test_token_files_of_repeated_ids_and_of_no_rows(spark, tmp_path):
    for name, rows in (("some", ROWS), ("none", [])):
        path = f"file://{tmp_path}/{name}"
        tokens.write_token_ids(table(spark, rows), path, docs_per_file=3)
        got = sorted(tokens.token_id_digests(spark, path).collect(), key=lambda r: r.start)
        left, at = Counter((d, B.crc(B.ids_of(t, [2]))) for d, t in rows), 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
            left[r.doc_id, r.ids_crc32] -= 1
        assert not any(left.values())
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda d: (d is None, d or 0))


def test_very_long_text(spark):
    rnd = random.Random(4)
    long = " ".join(rnd.choice(["alpha", "bêta", "x1", "secret=abcdefghij0123", "all rights reserved"]) + f" w{rnd.randrange(10_000)}" for _ in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    assert counts == {1: len(B.ids_of(long)), 2: len(B.ids_of(long + " end"))}
    assert sum(r.length for r in tokens.pack(docs).where("doc_id = 1").collect()) == counts[1] + 1
    got = secrets.secret_digest(secrets.find_secrets(docs)).where("doc_id = 1").first()
    assert [got.n_assign, got.n_access, got.n_hex] == B.secrets(long)[0]
    found = licenses.license_digest(licenses.scan_licenses(docs)).where("doc_id = 1").first()
    assert (found.n_words, found.n_base, found.first_word, found.last_word, found.base_labels) == B.licenses(long)
    assert {r.component_id for r in near_dup.near_duplicates(docs).collect()} == {1}
    assert {r.doc_id: r.p_toxic for r in toxicity.score_toxicity(docs, MODEL).collect()}[1] == pytest.approx(1 / (1 + math.e))


def grams(text):
    """Plain n-grams of letters, over words with a blank on both sides."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        out.update(c for c in word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def top(counts):
    order = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], order(g)))[: language.PROFILE]


def test_language_by_plain_rule_and_held_out(spark):
    rnd = random.Random(2)
    words = {"aa": "the of and to in is that it was for on are with his they".split(), "bb": "le de un être et à il avoir ne je son que se qui".split(), "cc": "der die und in den von zu das mit sich des auf für ist".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(rnd.randint(1, 40))), k) for i, k in enumerate(rnd.choice("abc") * 2 for _ in range(300))]
    train, held = rows[:200], rows[200:]
    schema = "doc_id long, text string, lang string"
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(held, schema), language.learn_profiles(spark.createDataFrame(train, schema))).collect()}
    profiles = {k: {g: i for i, g in enumerate(top(sum((grams(t) for _, t, x in train if x == k), Counter())))} for k in words}
    for d, t, _ in held:
        mine = top(grams(t))
        cost = {k: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[d] == (best, pytest.approx(max(0, 1 - cost[best] / (language.PROFILE * len(mine)))))
    assert sum(got[d][0] == x for d, _, x in held) >= 0.95 * len(held)


def test_language_ties_go_to_the_first(spark):
    train = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa"), (3, "same words", "mm")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(train, language.learn_profiles(train)).collect()} == {"aa"}


def test_toxicity_scores_by_plain_rule(spark):
    model = toxicity.Ordinal({"vile": 2.5, "mean": 0.75, "été": -0.5}, toxicity.np.array([1.0, 2.0]), 0.6)
    texts = ["vile", "Vile MEAN été", "kind", "", None, "vile vile mean", "x1vile2mean"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(docs, model).collect():
        score = sum(model.weights.get(w, 0) for w in set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())))
        p = [1 / (1 + math.exp(c - score)) for c in (1.0, 2.0)]
        assert r.severity == pytest.approx(sum(p)) and r.p_toxic == pytest.approx(p[0]) and r.toxic == (p[0] >= 0.6)


def test_packing_ties(spark):
    docs = spark.createDataFrame([(i % 7, "the same words") for i in range(50)], "doc_id long, text string")
    rows = tokens.pack(docs).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50
