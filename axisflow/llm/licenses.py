"""Operator 8: fuzzy search for short licence notices."""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and labels of the exact search.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices as their words stand in texts, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}

#: Words that tell a notice from those of other licences: no edit may touch them.
TELLING = {"mit": ("mit",), "apache-2.0": ("apache", "2"), "lgpl": ("lesser",), "agpl": ("affero",), "mpl-2.0": ("mozilla", "2"), "cc-by-sa": ("sharealike",)}


class Finder:
    """Exact phrases by words; notices with up to `errors` edits (one edit for each 12 characters, 3 at most).

    By the pigeonhole principle a notice with k edits holds at least one of its k + 1 parts unchanged, so every match lies
    around an exact part. The automaton finds all parts at once; the regex library's bounded-error match then decides.
    """

    def __init__(self, notices: dict[str, str] = NOTICES):
        self.notices = [(n, label, max(1, min(3, len(n) // 12))) for n, label in notices.items()]
        self.match = [regex.compile(f"(?b)(?:{regex.escape(n, special_only=True)}){{e<={k}}}") for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for j in range(k + 1):
                a, b = len(n) * j // (k + 1), len(n) * (j + 1) // (k + 1)
                seeds.setdefault(n[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for s, uses in seeds.items():
            self.seeds.add_word(s, (len(s), uses))
        self.seeds.make_automaton()
        self.phrases = {tuple(p.split()): label for p, label in PHRASES.items()}

    def base(self, words: list[str], line: str) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.phrases.items():
            if " ".join(phrase) not in line:
                continue
            first, n = phrase[0], len(phrase)
            found += [(i, label) for i, w in enumerate(words) if w == first and tuple(words[i : i + n]) == phrase]
        return found

    def tells(self, line: str, start: int, end: int, notice: str, label: str) -> bool:
        """Whether the whole words of the place hold the telling words of the notice unchanged."""
        whole = line[line.rfind(" ", 0, start) + 1 : (line.find(" ", end) + 1 or len(line) + 1) - 1].split()
        return all(w in whole for w in TELLING.get(label, ()) if w in notice.split())

    def fuzzy(self, line: str) -> list[tuple[int, int, str, float]]:
        """Spans in the normalised line: start, end, label, similarity; those of one notice do not overlap.

        Each seed's own window is searched by itself. The best match of a notice is taken first (ties: the leftmost); a window whose match
        a taken one overlaps is searched again in what is left of it. A window meets few taken matches, so the work follows the line's length.
        """
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, uses) in self.seeds.iter(line):
            for i, a in uses:
                n, _, k = self.notices[i]
                first = end + 1 - size - a
                windows.setdefault(i, set()).add((max(0, first - k), min(len(line), first + len(n) + k)))
        found = []
        for i, own in windows.items():
            n, label, k = self.notices[i]
            best: list[tuple[int, int, int, int, int]] = []
            starts: list[int] = []
            taken: list[tuple[int, int]] = []

            def look(lo: int, hi: int, i=i, n=n, k=k, best=best) -> None:
                m = self.match[i].search(line, lo, hi) if hi - lo >= len(n) - k else None
                if m is not None:
                    heapq.heappush(best, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

            for lo, hi in sorted(own):
                look(lo, hi)
            while best:
                errors, start, end, lo, hi = heapq.heappop(best)
                at = bisect.bisect_left(starts, lo)
                near = [x for x in taken[max(0, at - 1) : bisect.bisect_left(starts, hi)] if x[1] > lo]
                if not any(x[0] < end and start < x[1] for x in near):
                    place = bisect.bisect_left(starts, start)
                    starts.insert(place, start)
                    taken.insert(place, (start, end))
                    if self.tells(line, start, end, n, label):
                        found.append((start, end, label, 1.0 - errors / len(n)))
                    continue
                for a, z in zip([lo, *(x[1] for x in near)], [*(x[0] for x in near), hi], strict=True):
                    look(a, z)
        return sorted(found)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Every row's n_words, base places (word, label) and notices (start, end, label, similarity; in the words joined by blanks).

    Whole texts; null or empty texts have no words and no places. Repeated rows give repeated results; null ids stay null;
    other columns are ignored; no shuffle.
    """
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for f in frames:
            out = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                words = WORD.findall((text or "").translate(ASCII_LOWER))
                line = " ".join(words)
                base = [{"word": i, "label": x} for i, x in finder.base(words, line)]
                notices = [dict(zip(("start", "end", "label", "similarity"), x, strict=True)) for x in finder.fuzzy(line)]
                out.append((doc, len(words), base, notices))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "base", "notices"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = "doc_id string, n_words long, base array<struct<word:long,label:string>>, notices array<struct<start:long,end:long,label:string,similarity:double>>"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def license_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_licenses, a row for each of its rows, repeated and null ids included.

    Without places first_word and last_word are null, labels empty, and the score is that of the best notice, or 0. An empty table gives no rows.
    """
    label = lambda a: F.transform(a, lambda x: x["label"])
    base, every = label("base"), F.concat(label("base"), label("notices"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    places = F.transform("base", lambda x: x["word"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"), joined(every).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["similarity"])), F.lit(0.0))).alias("score"),
    )
