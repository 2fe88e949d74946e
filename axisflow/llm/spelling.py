"""Operator 13: spelling variants of a corpus' words, by wildcard and deletion groups instead of pairs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The contract's runs (after lower-casing A-Z), of as many letters as a word needs, and its planted deletions.
RUN = r"[a-zÀ-ÿ]"
PLANTED = 199


def count_words(docs: DataFrame, least_letters: int = 6, least_count: int = 5, planted: int | None = PLANTED, held: int = 200_000) -> DataFrame:
    """(word, n): words of `least_letters` code points or more that stand `least_count` times or more in docs(doc_id, text).

    Whole texts; A-Z are lower-cased, nothing else. Where `planted` divides the crc32 of `<doc_id>:<run>`, the run's code point at crc32 %
    length is taken out first, as a stand-in for typing errors (None: none). Null and empty texts have no words; a null id reads as an
    empty text in that checksum; repeated rows count each time; other columns are ignored; an empty table gives no rows. A task holds at
    most `held` words and one text before it passes its counts on.
    """
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"{RUN}{{{least_letters},}}")
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                here = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))  # bytes are lower-cased in A-Z alone
                if planted:
                    prefix = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                    for word in list(here):
                        h = zlib.crc32(word.encode(), prefix)
                        if h % planted == 0:
                            n, at = here.pop(word), h % len(word)
                            if len(word) > least_letters:
                                counts[word[:at] + word[at + 1 :]] += n
                counts.update(here)
                if len(counts) >= held:
                    yield out()
        if counts:
            yield out()

    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words(word, n) that have a near one: by exactly one inserted, deleted or replaced code point.

    A word joins the group of each (position, prefix, suffix) around one of its code points, whose members are near each other, and the
    groups of its deletions, in which it meets the word that the deletion is, if there is one. A group passes its members nothing but its
    size and its top two words, by n, then in code-point order; so no pair is made, and a group has no more members than letters exist
    for its open place (times places, for deletions). Words are distinct and not null, and hold no `*`; an empty table gives no rows.
    """
    places = F.sequence(F.lit(1), F.length("word"))
    around = lambda i, open_: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.lit(open_), F.substring(F.col("word"), i + 1, F.length("word")))
    keys = F.concat(F.transform(places, lambda i: around(i, "*")), F.array_distinct(F.transform(places, lambda i: around(i, ""))), F.array("word"))
    each = words.select("word", "n", F.explode(keys).alias("key"))
    own = F.col("key") == F.col("word")
    order = Window.partitionBy("key").orderBy(own.desc(), F.col("n").desc(), "word")  # a deletion's own word leads its group
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("word", "n")
    groups = each.select("word", "key", F.count("*").over(whole).alias("size"), F.first(me).over(whole).alias("first"), F.nth_value(me, 2).over(whole).alias("second"))
    other = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    seen = F.when(F.contains("key", F.lit("*")) | own, F.col("size") - 1).when(F.col("first.word") == F.col("key"), 1).otherwise(0)
    met = groups.select("word", seen.alias("seen"), (-other["n"]).alias("less"), other["word"].alias("other")).where("seen > 0")
    best = met.groupBy("word").agg(F.sum("seen").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.other").alias("best"))


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every one of words(word, n).

    form is the near word of largest n (ties: the smallest in code-point order), if it stands `times` times as often, else null; root is
    where forms lead to from the word, itself if it has none. Forms multiply n, so chains are short and hold no circle: they are followed
    by doubling, in as many joins as the largest n can need.
    """
    words = materialize(words.select("word", "n"))
    near = materialize(words.join(neighbours(words), "word", "left").withColumn("form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))))
    most, least = words.agg(F.max("n"), F.min("n")).first()
    depth = math.log(most / least, times) if most else 0
    ends = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(depth + 1))) if times > 1 else 0):
        ends = materialize(ends.join(ends.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    out = near.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))
