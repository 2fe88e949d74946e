"""Operators 1, 3 and 4: token counts, packing and token-id files, all with one public tokenizer file."""

from __future__ import annotations

import functools
import os
import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize

TOKENIZER = "byte_bpe_50k.json"
#: From this character on, the regex library and the tokenizer do not agree on all character classes.
FIRST_UNSURE = "԰"
CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
BYTES_A_TOKEN = 3  # only an estimate, for the number of shards


@functools.lru_cache(maxsize=2)
def worker_cache(path: str) -> dict[str, int]:
    """Lives as long as the worker process, over its tasks; emptied when it holds CACHE_ENTRIES."""
    return {}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
    return Tokenizer.from_file(path)


class TokenCounter:
    """Counts tokens by adding up pre-token lengths: a broadcast table first, then this worker's cache, then the library."""

    def __init__(self, path: str, table: dict[str, int]):
        self.library, self.table, self.cache = tokenizer(path), table, worker_cache(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < FIRST_UNSURE:
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def lengths(self, pieces: list[str]) -> list[int]:
        """Through the cache; what it lacks is encoded in one batch."""
        cache = self.cache
        known = {p: cache.get(p) for p in set(pieces)}
        new = [p for p, n in known.items() if n is None]
        if new:
            known.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
            cache.update((p, known[p]) for p in new if len(p) <= CACHE_CHARS)
        return [known[p] for p in pieces]

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if part:
                pieces = self.pre_tokens(part)
                known = list(map(self.table.get, pieces))
                total += sum(filter(None, known))
                if None in known:
                    total += sum(self.lengths([p for p, n in zip(pieces, known, strict=True) if n is None]))
        return total


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 2_000, entries: int = 32_768) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a hash sample of about `sample_docs` texts (all, if fewer), from all parts of the table.

    The table only saves time: any pre-token outside it is encoded, so the sample never changes a count. Pre-tokens are tallied where
    the texts are read; a task holds 16 times `entries` at most besides one text, and hands on its `entries` most frequent ones, which are
    added up.
    At most `entries` strings of at most CACHE_CHARS characters, hence a few MB whatever the corpus.
    """
    def tally(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, seen = TokenCounter(path, {}), Counter()
        for f in frames:
            for text in f["text"]:
                seen.update(p for p in counter.pre_tokens(text) if len(p) <= CACHE_CHARS)
                if len(seen) > 16 * entries:
                    seen = Counter(dict(seen.most_common(4 * entries)))
        top = seen.most_common(entries)
        if top:
            yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top]})

    share = int(1_000_000 * min(1.0, sample_docs / max(docs.count(), 1)))
    sample = docs.select("text").where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < share))
    sums = sample.mapInPandas(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = sums.orderBy(F.desc("n"), "piece").limit(entries).collect()
    counter = TokenCounter(path, {})
    pieces = [r.piece for r in rows]
    return dict(zip(pieces, counter.lengths(pieces), strict=True)) if pieces else {}


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text, ...).

    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; a null doc_id stays null;
    other columns are ignored. Texts are never shuffled: one pass with a broadcast of bounded size, after a tally of a sample.
    An empty table gives no rows.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(path, table.value)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_bytes": f["n_bytes"], "n_tokens": [counter.count(t) for t in f["text"]]})

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return _with_nullable_ids(rows, run, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def _with_nullable_ids(rows: DataFrame, run, columns: str) -> DataFrame:
    """pandas turns a null long into a float, so ids travel as text."""
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


@functools.lru_cache(maxsize=2)
def worker_ids(path: str) -> dict[str, bytes]:
    """Ids of chunks, little-endian; lives as long as the worker process, emptied when an encoder finds too many."""
    return {}


@functools.lru_cache(maxsize=2)
def leading_blank(path: str) -> np.ndarray:
    """Which token ids begin with a blank."""
    library = tokenizer(path)
    blank = library.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]
    out = np.zeros(library.get_vocab_size(), bool)
    out[[i for t, i in library.get_vocab().items() if t.startswith(blank)]] = True
    return out


BLANK, BREAK = 0x20, 0x0A
LETTERS = frozenset(string.ascii_letters.encode())
PUNCTUATION = frozenset(string.punctuation.encode())


@functools.cache
def byte_kinds() -> np.ndarray:
    """Of each byte: 1 ASCII letter, 2 ASCII punctuation, 4 visible ASCII."""
    return np.array([(b in LETTERS) | (b in PUNCTUATION) << 1 | (0x20 < b < 0x7F) << 2 for b in range(256)], np.uint8)


def borders(data: np.ndarray) -> np.ndarray:
    """Whether a pre-token surely begins at each of the UTF-8 bytes data[3:]: a blank or line break behind another character, ASCII punctuation behind a letter.

    No pre-token has white space behind another character, or punctuation behind a letter. Characters beyond ASCII count only where
    their bytes show that they are no white space: two bytes not led by C2, or longer ones not led by E1, E2 or E3;
    as letters those led by C3, without the signs of multiplication and division.
    """
    kinds = byte_kinds()[data]
    one, two, three = data[2:-1], data[1:-2], data[:-3]  # one to three bytes before data[3:]
    other = (one >= 0x80) & (((two >= 0xC3) & (two < 0xE0)) | ((two >= 0x80) & (two < 0xC0) & ~((three >= 0xE1) & (three <= 0xE3))))
    letter = (kinds[2:-1] & 1 > 0) | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
    now = data[3:]
    return (((now == BLANK) | (now == BREAK)) & ((kinds[2:-1] & 4 > 0) | other)) | ((kinds[3:] & 2 > 0) & letter)


class TokenEncoder:
    """Ids of whole texts by joining those of their chunks; what the worker's cache lacks is encoded many at a time.

    A chunk begins where a pre-token surely begins, so the chunks' ids are the text's. Texts with special strings go to the
    library whole. Arrow numbers the distinct chunks of a batch, so that Python looks up each of them once.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        self.library, self.ids, self.leads = tokenizer(path), worker_ids(path), leading_blank(path)
        self.breaks = np.zeros(len(self.leads), bool)
        self.breaks[self.library.encode("\n", add_special_tokens=False).ids] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def learn(self, new: list[str], leads: np.ndarray) -> list[str]:
        """Puts the ids of chunks in the cache: many in one text, cut at the tokens that begin a chunk. Returns those that cannot be cut so."""
        groups, left = [new[a : a + 256] for a in range(0, len(new), 256)], []
        for group, e in zip(groups, self.library.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
            found = np.array(e.ids, "<u4")
            at = [*(np.flatnonzero(leads[found]) * 4).tolist(), 4 * len(found)]
            if len(at) != len(group) + 1:
                left += group
                continue
            raw = found.tobytes()
            self.ids.update((p, raw[i:j]) for p, i, j in zip(group, at, at[1:], strict=False))
        return left

    def learn_all(self, new: list[str]) -> None:
        """Words behind a blank, or behind a line break, are encoded in groups; other chunks each by itself."""
        kinds: dict[str, list[str]] = {" ": [], "\n": [], "": []}
        for p in new:
            lead = p[0]
            grouped = lead in kinds and len(p) > 1 and p.count(lead) == 1 and (lead == " " or " " not in p) and not p[1].isspace() and not p[-1].isspace()
            kinds[lead if grouped else ""].append(p)
        alone = kinds[""] + self.learn(kinds[" "], self.leads) + self.learn(kinds["\n"], self.breaks)
        for p, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.ids[p] = np.array(e.ids, "<u4").tobytes()

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        ids = self.ids
        known = list(map(ids.get, chunks))
        gaps = [i for i, b in enumerate(known) if b is None]
        if gaps:
            self.learn_all([chunks[i] for i in gaps])
            for i in gaps:
                p = chunks[i]
                known[i] = ids[p] if len(p) <= CACHE_CHARS else ids.pop(p)
            if len(ids) > self.entries:
                ids.clear()
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        for i, e in zip(special, self.library.encode_batch_fast([texts[i] for i in special], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        plain = sorted({i for i, t in enumerate(texts) if t}.difference(special))
        if not plain:
            return out
        raw = [texts[i].encode() for i in plain]
        starts = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        begins = borders(np.frombuffer(b"xxx" + data, np.uint8))  # three bytes, so that each one has three before it
        begins[starts[:-1]] = True
        cuts = np.append(np.flatnonzero(begins), len(data))
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype("<i8")), pa.py_buffer(data))
        coded = parts.dictionary_encode()
        known = self.chunk_ids(coded.dictionary.to_pylist())
        ends = np.cumsum([0, *map(len, known)]) // 4
        table = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(known), "<u4")))
        found = table.take(coded.indices)
        ids, places = memoryview(np.ascontiguousarray(found.values.to_numpy(), "<u4")).cast("B"), 4 * found.offsets.to_numpy()[np.searchsorted(cuts, starts)]
        for i, x, y in zip(plain, places[:-1].tolist(), places[1:].tolist(), strict=True):
            out[i] = bytes(ids[x:y])
        return out


def batches_of(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Successive texts of about so many characters in all, or a single longer one."""
    a, total = 0, 0
    for b, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield texts[a : b + 1]
            a, total = b + 1, 0
    if a < len(texts):
        yield texts[a:]


def encoder(path: str, end_id: int):
    """Text to ids with the end id, as little-endian unsigned 32-bit values."""
    library, end = TokenEncoder(path), np.array([end_id], "<u4").tobytes()

    def run(texts: list[str]) -> Iterator[np.ndarray]:
        for part in batches_of(texts):
            for ids in library.encode(part):
                yield np.frombuffer(ids + end, "<u4")

    return run


# ---- packing ----


class BestFit:
    """Open windows counted by remaining capacity in a segment tree; the tightest that fits is found in log(capacity) steps."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}
        self.used: list[int] = []

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def _tightest(self, need: int) -> int | None:
        node = need + self.leaves
        if self.tree[node]:
            return need
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """The window and the offset in it."""
        capacity = self._tightest(length)
        if capacity is None:
            at, capacity = len(self.used), self.window
            self.used.append(0)
        else:
            at = self.open[capacity].pop()
            self._add(capacity, -1)
        offset, left = self.used[at], capacity - length
        self.used[at] += length
        if left:
            self.open.setdefault(left, []).append(at)
            self._add(left, 1)
        return at, offset


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, pieces_per_shard: int = 1500, with_ids: bool = False) -> DataFrame:
    """Pieces of every document, placed in windows of at most `window` tokens by best-fit decreasing.

    Documents longer than a window are first cut into full windows. Pieces are dealt by a hash of the piece and its row into
    shards of about `pieces_per_shard` pieces, whose number is estimated from the texts' bytes; each shard is packed by itself, so
    that no task grows with the corpus, and rows that repeat are spread like others. A shard's last windows are the only padding
    that sharding adds. Null text: empty, hence one piece with the end id only. Repeated rows are packed repeatedly; null ids
    stay null; ties in length go by id, start and checksum. An empty table gives no pieces; other columns are ignored.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (window, or the fill where that is a power of two), ids if asked.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    sizes = docs.select(F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / (BYTES_A_TOKEN * window)).alias("more")).agg(F.count("*").alias("n"), F.sum("more").alias("more")).first()
    shards = max(1, -(-int(sizes["n"] + (sizes["more"] or 0)) // pieces_per_shard))
    ids_column = ", ids array<int>" if with_ids else ""

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, end_id)
        for f in frames:
            out = []
            for doc, ids in zip(f["doc_id"], encode(list(f["text"])), strict=True):
                for a in range(0, len(ids), window):
                    piece = ids[a : a + window]
                    out.append((doc, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)) + ((piece.astype("i4"),) if with_ids else ()))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        fit = BestFit(window)
        at, offset = zip(*map(fit.place, f["length"].tolist()), strict=True)
        used = np.array(fit.used)[list(at)]
        f["sequence_id"] = f["shard"].astype("int64") * (1 << 32) + np.array(at)
        f["offset"] = offset
        f["padded_length"] = np.where(used & (used - 1) == 0, used, window)
        return f.drop(columns="shard")

    piece = "start long, length long, ids_crc32 long, doc_tokens long"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = rows.mapInPandas(cut, f"doc_id string, {piece}{ids_column}")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    packed = pieces.groupBy("shard").applyInPandas(fill, f"doc_id string, {piece}{ids_column}, sequence_id long, offset long, padded_length long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


# ---- token-id files ----


def write_token_ids(docs: DataFrame, path: str, end_id: int = 2, tokenizer_path: str | None = None, docs_per_file: int = 20_000, cache_entries: int = CACHE_ENTRIES) -> None:
    """ORC files in ascending doc_id order: doc_id, ids array<int> with the end id, place (of the row in its file).

    Null or empty texts have the end id only; null ids come last; repeated rows are written repeatedly, those that share an id in
    the order of their texts' hashes; other columns are not written; an empty table gives no rows.
    Rows are range-partitioned and sorted by id before they are encoded, so that sampling the ranges reads no tokens.
    Small tables get smaller files, two a core, so that all cores encode.
    ORC's integer run-length encoding packs the ids; row indexes and Bloom filters on doc_id serve lookups.
    """
    source = tokenizer_path or public_tokenizers.path(TOKENIZER)
    n = docs.count()
    files = max(1, -(-n // docs_per_file), min(2 * docs.sparkSession.sparkContext.defaultParallelism, n // 1000))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end, place = TokenEncoder(source, cache_entries), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            done = 0
            for texts in batches_of(batch.column("text").to_pylist()):
                part = batch.slice(done, len(texts))
                done += len(texts)
                raw = [ids + end for ids in library.encode(texts)]
                ends = np.cumsum([0, *map(len, raw)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(np.arange(place, place + len(raw)))], ["doc_id", "ids", "place"])
                place += len(raw)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(files, F.asc_nulls_last("doc_id"), tie).sortWithinPartitions(F.asc_nulls_last("doc_id"), tie, "text")
    encoded = rows.mapInArrow(run, "doc_id long, ids array<int>, place long")
    encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").orc(path)


def read_token_ids(spark, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids, stripes and row groups are skipped by statistics and Bloom filters."""
    df = spark.read.schema("doc_id long, ids array<int>, place long").orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(list(doc_ids)))


def token_id_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row in the files; start counts the ids of all rows before it.

    Each file is summed in its own window, in the order of its rows; only one total a file is summed over the files, by their
    part numbers, and their number is bounded by the range partitions. Null ids stay null; rows that repeat an id have a row each, one behind
    the other; no files' rows: no rows.
    """
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw, ends = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B"), ids.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            sizes = pa.array(np.diff(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("place"), sizes, pa.array(crc, pa.int64())], ["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    rows = read_token_ids(spark, path).select("doc_id", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("file"), "place", "ids")
    rows = materialize(rows.mapInArrow(digest, "doc_id long, file long, place long, n_tokens long, ids_crc32 long"))  # a few bytes a document, read twice
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens")).collect()  # one row a file
    offsets, total = [], 0
    for r in sorted(totals, key=lambda r: r.file):
        offsets.append((r.file, total))
        total += r.file_tokens
    order = Window.partitionBy("file").orderBy("place")
    inside = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = spark.createDataFrame(offsets, "file long, file_start long")
    joined = rows.join(F.broadcast(at) if len(offsets) <= 100_000 else at, "file")
    return joined.select("doc_id", (F.col("file_start") + F.coalesce(inside, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
