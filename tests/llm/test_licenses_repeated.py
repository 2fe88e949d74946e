"""Notices that repeat with edits, whose windows are merged."""

from axisflow.llm import licenses


def test_every_notice_of_a_run_is_found():
    finder = licenses.Finder()
    line = "all rights reservd all rights reservd all rights reserved all right reserved"
    assert [x[:3] for x in finder.fuzzy(line)] == [(0, 18, "reserved"), (19, 37, "reserved"), (38, 57, "reserved"), (58, 76, "reserved")]


def test_many_edited_notices_in_one_text():
    """40,000 edited notices in a row: each is found, and the time follows the text's length."""
    import time

    from axisflow.llm.licenses import Finder

    finder, took = Finder(), {}
    for n in (4_000, 40_000):
        began = time.process_time()
        found = finder.fuzzy(" ".join(["all rights reservd"] * n))
        took[n] = time.process_time() - began
        assert len(found) == n and {x[2] for x in found} == {"reserved"}
    assert took[40_000] < 25 * max(took[4_000], 0.05)
