"""Operator 11: repair of a conversation's role structure, by DuckDB's recursive queries inside hash-partitioned batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The states of the grammar (s?(ua)+)? (E: nothing yet, S: after system, U: after user, A: after assistant), which may end, and costs.
NEXT = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
STATES, ENDS = "ESUA", ("E", "A")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}

#: Blanks and sentence ends of the contract.
SOME, FINISHED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

EDITS = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "k string, place long, edit string, role string, text string"
PARTS = "k string, part long, entry string, state string, cost long, audit string, roles string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _inserted(state: str) -> dict[str, tuple[int, str, str]]:
    """(cost, audit, roles) of the fewest inserts that lead from a state to each other one."""
    found, todo = {state: (0, "", "")}, [state]
    for s in todo:
        cost, audit, roles = found[s]
        for role in NAMES:
            to = NEXT.get((s, role))
            if to and to not in found:
                found[to] = (cost + INSERT, f"{audit}I", roles + role)
                todo.append(to)
    return found


def _moves() -> list[tuple[str, str, str, int, str, str]]:
    """(kind, from, to, cost, audit, roles): the cheapest edit of one row with the inserts behind it, for each kind of row and pair of states.

    Kinds: x for rows that must go, else the role's initial (o: any other), with ! if truncated.
    """
    best: dict[tuple[str, str, str], tuple[int, str, str]] = {}
    for kind in ["x", *(i + t for i in "suao" for t in ("", "!"))]:
        more = TRUNCATED * kind.endswith("!")
        for state in STATES:
            edits = [(state, DELETE, "D", "-")]
            if kind != "x":
                edits += [(NEXT[state, kind[0]], more, "K", kind[0])] if (state, kind[0]) in NEXT else []
                edits += [(NEXT[state, r], REROLE + more, "R", r) for r in NAMES if (state, r) in NEXT]
            for to, cost, edit, role in edits:
                for end, (c, a, r) in _inserted(to).items():
                    key, move = (kind, state, end), (cost + c, edit + a, role + r)
                    best[key] = min(best.get(key, move), move)
    return [(*key, *move) for key, move in best.items()]


def damage(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with the contract's faults put in by crc32(`conv_id:turn`) % 20; null values read as one space.

    0 drops a row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes its role user. Repeated rows are damaged alike.
    """
    filled = lambda c, kind: F.coalesce(F.col(c).cast(kind).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role", "string").alias("role"), filled("text", "string").alias("text"),
                        (F.crc32(F.concat_ws(":", filled("conv_id", "long"), filled("turn", "long")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _rows(turns: DataFrame) -> DataFrame:
    """k (the id as text, one space if null), turn, role, text, digest of the text, blank, cut (not finished)."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"),
        F.md5(text).alias("digest"), (~text.rlike(SOME)).alias("blank"), (~text.rlike(FINISHED)).alias("cut"))


def _groups(frames: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """Batches of whole keys k, of about `rows` rows or `size` bytes, from batches sorted by k."""
    held: list[pa.RecordBatch] = []
    for frame in frames:
        held.append(frame)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            table = pa.Table.from_batches(held)
            first = pc.index(table["k"], table["k"][-1]).as_py()  # of the last key, which may go on
            if first:
                yield table.slice(0, first)
                held = table.slice(first).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    con.execute("CREATE TABLE moves (kind VARCHAR, here VARCHAR, there VARCHAR, cost BIGINT, audit VARCHAR, roles VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())
    con.execute("CREATE TABLE opening (there VARCHAR, cost BIGINT, audit VARCHAR, roles VARCHAR)")
    con.executemany("INSERT INTO opening VALUES (?, ?, ?, ?)", [(s, *x) for s, x in _inserted("E").items()])
    return con


#: Positions, faults and kinds of the rows of whole conversations.
NUMBERED = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, digest) AS pos FROM batch),
d AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY k, role, digest ORDER BY pos) > 1 AS dup FROM p)
SELECT k, turn, role, text, pos, blank, dup, NOT blank AND NOT dup AND cut AS trunc, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY pos) AS before,
       CASE WHEN blank OR dup THEN 'x' ELSE CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END || CASE WHEN cut THEN '!' ELSE '' END END AS kind
FROM d"""

#: Advances all conversations by one row a recursion; USING KEY keeps one row a grammar state: the least cost, then the least audit.
WALK = """
WITH RECURSIVE walk(k, entry, state, pos, best) USING KEY (k, entry, state) AS (
  SELECT k, entry, state, 0::BIGINT, best FROM begins
  UNION
  SELECT w.k, w.entry, m.there, w.pos + 1, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.audit, 'roles': w.best.roles || m.roles})
  FROM walk w JOIN steps t ON t.k = w.k AND t.pos = w.pos + 1 JOIN moves m ON m.kind = t.kind AND m.here = w.state
  GROUP BY w.k, w.entry, w.pos, m.there)
SELECT w.k, w.entry, w.state, w.best.cost AS cost, w.best.audit AS audit, w.best.roles AS roles
FROM walk w JOIN (SELECT k, max(pos) AS n FROM steps GROUP BY k) USING (k) WHERE w.pos = n"""

LETTERS = """
SELECT k, i, audit[i] AS edit, roles[i] AS to_role, sum(CASE WHEN audit[i] <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN audit[i] <> 'D' THEN 1 ELSE 0 END) OVER w AS place
FROM (SELECT k, audit, roles, unnest(range(1, length(audit) + 1)) AS i FROM ends) WINDOW w AS (PARTITION BY k ORDER BY i)"""

REPAIRED = """
SELECT l.k, l.place::BIGINT AS place, l.edit, CASE WHEN l.edit = 'K' THEN s.role WHEN l.to_role = 'u' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN l.edit = 'I' THEN '' ELSE s.text END AS text
FROM letters l JOIN steps s ON s.k = l.k AND s.pos = greatest(l.pos, 1) WHERE l.edit <> 'D'"""

COUNTS = """
SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
       count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
FROM steps GROUP BY k"""


def _fill(con: duckdb.DuckDBPyConnection, **queries: str) -> None:
    for name, query in queries.items():
        con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {query}")


def _whole(con: duckdb.DuckDBPyConnection, batch: pa.Table) -> None:
    """Fills steps, ends (the cheapest audit of each conversation) and repaired from a batch of whole conversations."""
    con.register("batch", batch)
    _fill(con, steps=NUMBERED, begins="SELECT k, 'E' AS entry, there AS state, {'cost': cost, 'audit': audit, 'roles': roles} AS best FROM (SELECT DISTINCT k FROM steps), opening")
    _fill(con, walked=WALK, ends=f"SELECT k, x.cost AS cost, x.audit AS audit, x.roles AS roles FROM (SELECT k, min({{'cost': cost, 'audit': audit, 'roles': roles}}) AS x FROM walked WHERE state IN {ENDS} GROUP BY k)")
    _fill(con, letters=LETTERS)
    _fill(con, repaired=REPAIRED)
    con.unregister("batch")


WHOLE_EDITS = """
SELECT k, gaps, blank, duplicate, truncated, illegal, e.cost, e.audit, sha256(coalesce(r.joined, '')) AS repaired_sha256
FROM counts JOIN ends e USING (k) LEFT JOIN (SELECT k, string_agg(role || ':' || text, chr(10) ORDER BY place) AS joined FROM repaired GROUP BY k) r USING (k)"""


def _in_batches(rows: DataFrame, work, schema: str, order: list[str], size: int = 16 << 20) -> DataFrame:
    """work(connection, batch of whole keys) -> Arrow table, over rows dealt by the hash of k."""
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for batch in _groups(frames, 8192, size):
            yield from work(con, batch).to_batches()

    return rows.repartition("k").sortWithinPartitions("k", *order).mapInArrow(run, schema)


def _whole_edits(con: duckdb.DuckDBPyConnection, batch: pa.Table) -> pa.Table:
    _whole(con, batch)
    _fill(con, counts=COUNTS)
    return con.sql(WHOLE_EDITS).to_arrow_table().cast(pa.schema([(n, pa.string() if n in ("k", "audit", "repaired_sha256") else pa.int64()) for n in EDITS.replace(" string", "").replace(" long", "").split(", ")]))


def _whole_turns(con: duckdb.DuckDBPyConnection, batch: pa.Table) -> pa.Table:
    _whole(con, batch)
    return con.sql("SELECT k, place, edit, role, text FROM repaired").to_arrow_table()


class _Long:
    """Conversations too long for a batch: dealt by ranges of (conversation, turn), numbered, and cut into segments of `span` rows.

    A segment's recursion starts from every state, so that it knows nothing of the rows before it; then `fan` segments at a time are put
    together, by the same recursion over segments instead of rows, until each conversation is one.
    """

    def __init__(self, rows: DataFrame, span: int, fan: int):
        self.span, self.fan = span, fan
        some = materialize(rows.withColumn("id", F.monotonically_increasing_id()))
        order = ["k", F.col("turn").isNotNull(), "turn", "role", "digest", "id"]
        parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = some.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        dealt = materialize(dealt.withColumns({"task": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}))  # in the order of the sort
        heads = dealt.groupBy("k", "task").agg(F.min("nth").alias("head"), F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("k").orderBy("task")) - F.col("n")
        heads = heads.select("k", "task", (before - F.col("head") + 1).alias("shift"))
        placed = dealt.join(heads, ["k", "task"]).withColumn("pos", F.col("nth") + F.col("shift"))
        first = placed.groupBy("k", "role", "digest").agg(F.min("pos").alias("first"))
        placed = placed.join(first, ["k", "role", "digest"]).withColumn("dup", ~F.col("blank") & (F.col("pos") > F.col("first")))
        initial = F.substring("role", 1, 1)
        kind = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), F.when(F.col("cut"), "!").otherwise(""))
        self.rows = materialize(placed.select(
            "k", "turn", "role", "text", "pos", F.floor((F.col("pos") - 1) / span).cast("long").alias("part"), "blank", "dup", (~F.col("blank") & ~F.col("dup") & F.col("cut")).alias("trunc"),
            initial.alias("initial"), F.when(F.col("blank") | F.col("dup"), "x").otherwise(kind).alias("kind")))
        self.ends = self._ends()

    def _walked(self, parts: DataFrame, work) -> DataFrame:
        return materialize(_in_batches(parts, work, PARTS, ["pos"]))

    def _ends(self) -> DataFrame:
        """(k, cost, audit, roles) of whole conversations."""
        def rows(con: duckdb.DuckDBPyConnection, batch: pa.Table) -> pa.Table:
            con.register("batch", batch)
            _fill(con, steps="SELECT k, pos, kind FROM batch", begins="""
                SELECT k, 'E' AS entry, there AS state, {'cost': cost, 'audit': audit, 'roles': roles} AS best FROM (SELECT DISTINCT k FROM batch WHERE part = 0), opening
                UNION ALL SELECT k, here, here, {'cost': 0::BIGINT, 'audit': '', 'roles': ''} FROM (SELECT DISTINCT k FROM batch WHERE part > 0), (SELECT DISTINCT here FROM moves)""")
            con.unregister("batch")
            return con.sql(f"SELECT w.k, 0::BIGINT AS part, entry, state, cost, audit, roles FROM ({WALK}) w").to_arrow_table()

        def joined(con: duckdb.DuckDBPyConnection, batch: pa.Table) -> pa.Table:
            con.register("batch", batch)
            _fill(con, steps="SELECT k, pos, k || chr(0) || pos AS kind, entry, state, cost, audit, roles FROM batch",
                  begins="SELECT k, entry, state, {'cost': cost, 'audit': audit, 'roles': roles} AS best FROM steps WHERE pos = 0")
            con.unregister("batch")
            over = WALK.replace("JOIN moves m ON m.kind = t.kind AND m.here = w.state", "").replace("t.pos = w.pos + 1", "t.pos = w.pos + 1 AND t.entry = w.state").replace("m.there", "t.state").replace("m.", "t.")
            return con.sql(f"SELECT w.k, 0::BIGINT AS part, entry, state, cost, audit, roles FROM ({over}) w").to_arrow_table()

        split = lambda df: df.withColumns({"part": F.substring_index("k", ":", -1).cast("long"), "k": F.substring_index("k", ":", 1)})
        key = lambda part: F.concat_ws(":", "k", part.cast("string"))
        light = self.rows.select(key(F.col("part")).alias("k"), (F.col("pos") - F.col("part") * self.span).alias("pos"), "kind", "part")
        parts = split(self._walked(light, rows))
        while parts.agg(F.max("part")).first()[0]:
            group = F.floor(F.col("part") / self.fan).cast("long")
            parts = split(self._walked(parts.select(key(group).alias("k"), (F.col("part") % self.fan).alias("pos"), "entry", "state", "cost", "audit", "roles"), joined))
        best = F.min(F.struct("cost", "audit", "roles"))
        return materialize(parts.where(F.col("state").isin(*ENDS)).groupBy("k").agg(best.alias("x")).select("k", "x.*"))

    def turns(self) -> DataFrame:
        """The repaired turns; the rows of a segment meet its own part of the audit."""
        span = self.span
        piece = re.compile(f"I*(?:[KRD]I*){{1,{span}}}")

        def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for k, audit, roles in zip(f["k"], f["audit"], f["roles"], strict=True):
                    out, place = [], 0
                    for part, m in enumerate(piece.finditer(audit)):
                        out.append((k, part, place, m[0], roles[m.start() : m.end()]))
                        place += len(m[0]) - m[0].count("D")
                    yield pd.DataFrame(out, columns=["k", "part", "before", "audit", "roles"])

        pieces = self.ends.select("k", "audit", "roles").mapInPandas(cut, "k string, part long, before long, audit string, roles string")
        letters = F.arrays_zip(F.split("audit", "").alias("edit"), F.split("roles", "").alias("to_role"))
        each = pieces.select("k", "part", "before", F.posexplode(letters).alias("i", "x")).select("k", "part", "before", "i", "x.edit", "x.to_role")
        so_far = Window.partitionBy("k", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        pos = F.col("part") * span + F.sum((F.col("edit") != "I").cast("long")).over(so_far)
        place = F.col("before") + F.sum((F.col("edit") != "D").cast("long")).over(so_far)
        each = each.withColumns({"pos": pos, "place": place}).where("edit <> 'D'")
        kept = each.where("edit <> 'I'").join(self.rows.select("k", "pos", "role", "text"), ["k", "pos"])
        new = F.when(F.col("to_role") == "u", "user").otherwise("assistant")
        kept = kept.select("k", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(new).alias("role"), "text")
        return kept.unionByName(each.where("edit = 'I'").select("k", "place", "edit", new.alias("role"), F.lit("").alias("text")))

    def edits(self) -> DataFrame:
        """The findings; a conversation's hash is a chain, so its turns stream through one task, in bounded memory."""
        def chain(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, None
            for f in frames:
                for k, role, text in zip(f["k"], f["role"], f["text"], strict=True):
                    if k != now:
                        if state is not None:
                            yield pd.DataFrame({"k": [now], "repaired_sha256": [state.hexdigest()]})
                        now, state = k, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{role}:{text}".encode())
            if state is not None:
                yield pd.DataFrame({"k": [now], "repaired_sha256": [state.hexdigest()]})

        hashes = self.turns().repartition("k").sortWithinPartitions("k", "place").select("k", "role", "text").mapInPandas(chain, "k string, repaired_sha256 string")
        one = lambda c: F.sum(F.col(c).cast("long"))
        counts = self.rows.groupBy("k").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), one("blank").alias("blank"), one("dup").alias("duplicate"), one("trunc").alias("truncated"))
        turns = self.rows.where("turn IS NOT NULL").groupBy("k", "turn").count().groupBy("k").agg(F.count("*").alias("turns"))
        inside = self.rows.withColumn("last", F.lag("initial").over(Window.partitionBy("k", "part").orderBy("pos"))).select("k", "last", "initial")
        heads = self.rows.where(F.col("pos") % self.span == 1).select("k", "pos", "initial")
        tails = self.rows.where(F.col("pos") % self.span == 0).select("k", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("last"))
        pairs = inside.where("last IS NOT NULL").unionByName(heads.join(tails, ["k", "pos"]).select("k", "last", "initial"))
        illegal = pairs.where(~F.concat("last", "initial").isin("su", "ua", "au")).groupBy("k").agg(F.count("*").alias("illegal"))
        found = counts.join(turns, "k", "left").join(illegal, "k", "left").join(self.ends, "k").join(hashes, "k", "left")
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
        return found.select("k", gaps.alias("gaps"), "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"), "cost", "audit", F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


def _by_length(turns: DataFrame, whole_rows: int, whole_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that a batch can hold, and those of the others, if there are any."""
    rows = _rows(turns)
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = materialize(sizes.where((F.col("n") > whole_rows) | (F.col("size") > whole_bytes)).select("k"))
    if long.isEmpty():
        return rows, None
    return rows.join(long, "k", "left_anti"), rows.join(long, "k", "left_semi")


def _restored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.when(F.col("k") != " ", F.col("k").cast("long")).alias("conv_id"), *columns)


def repair_turns(turns: DataFrame, whole_rows: int = 1024, whole_bytes: int = 32 << 20, span: int = 256, fan: int = 64) -> DataFrame:
    """conv_id, place (from 1), edit (K kept, R given another role, I inserted), role, text: the cheapest repair of turns(conv_id, turn, role, text).

    Each conversation's rows in order of turn (nulls first; ties by role and the text's MD5) become role initials of the form (s?(ua)+)?:
    keeping a row costs 0, another role 3, deletion 4 (a must for blank and repeated rows), an inserted empty turn 3, and rows that stay
    without a sentence end 3 more; ties go to the least audit in ASCII order. Null roles and texts read as one space; rows of a null id are one
    conversation; rows alike in role and text are duplicates but for the first; a conversation of nothing but faults has no rows here; an
    empty table gives none; other columns are ignored. Conversations of up to `whole_rows` rows and `whole_bytes` bytes are repaired whole
    inside batches, longer ones in segments of `span` rows, with the same result.
    """
    short, long = _by_length(turns, whole_rows, whole_bytes)
    found = _in_batches(short, _whole_turns, TURNS, [])
    found = found if long is None else found.unionByName(_Long(long, span, fan).turns())
    return _restored(found, "place", "edit", "role", "text")


def repair_edits(turns: DataFrame, whole_rows: int = 1024, whole_bytes: int = 32 << 20, span: int = 256, fan: int = 64) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation of repair_turns' input.

    gaps are missing turn numbers (null ones do not count); blank, duplicate and truncated count each row's first fault; illegal counts
    neighbours whose initials are not su, ua or au; the hash is that of `role:text` lines of the repaired turns. Edge cases as in repair_turns.
    """
    short, long = _by_length(turns, whole_rows, whole_bytes)
    found = _in_batches(short, _whole_edits, EDITS, [])
    found = found if long is None else found.unionByName(_Long(long, span, fan).edits())
    return _restored(found, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_digest(edits: DataFrame, turns: DataFrame) -> DataFrame:
    """The contract's columns for every conversation of turns, also those that lost all rows: zeros, an empty audit and an empty text's hash."""
    ids = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(edits, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
