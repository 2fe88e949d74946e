"""Ids that stand on rows with different texts."""

from axisflow.llm import near_dup

A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


def test_repeated_ids_are_judged_by_their_texts(spark):
    rows = [(1, C), (1, A), (1, B), (1, A), (2, A + " tail"), (3, C), (3, A + " more"), (4, B), (4, ""), (4, None), (5, C + " end"), (None, A), (6, "")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = near_dup.near_duplicates(docs).where("doc_id is not null and n_shingles > 0")
        assert {r.component_id for r in got.collect()} == {1}
        kept = [(r.doc_id, r.text or "") for r in near_dup.keep_one(docs).collect()]
        assert sorted(kept, key=str) == sorted([(1, A), (1, B), (1, C), (4, ""), (None, A), (6, "")], key=str)


def test_two_texts_of_one_group_under_one_id(spark):
    docs = spark.createDataFrame([(1, A), (1, A + " tail"), (2, A + " more"), (7, B)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near_dup.keep_one(docs).collect()]
    assert len(kept) == 2 and (7, B) in kept
