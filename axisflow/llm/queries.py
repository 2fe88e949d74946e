"""The contract's queries, each a thin layer over its operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, language, licenses, near_dup, nearest, quality, secrets, spelling, tokens, toxicity
from .common import load, work_dir


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(load(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(decontaminate.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(load(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    tokens.write_token_ids(load(spark, sf_dir, "documents"), path)
    return tokens.token_id_digests(spark, path)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    profiles = language.learn_profiles(docs.where(~fold))
    out = language.identify(docs, profiles)
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(load(spark, sf_dir, "documents")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_from_labels(docs, load(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return conversations.repair_digest(conversations.repair_edits(conversations.damage(turns)), turns)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))  # a null id is not held out
    field = quality.learn_quality(docs.where(~fold), load(spark, sf_dir, "labels"))
    return quality.score_quality(docs, field).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.count_words(load(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_decontamination, op3_packing, op4_token_ids, op5_language_id, op6_near_duplicates,
    op7_secret_scans, op8_license_scans, op9_nearest_neighbours, op10_toxicity, op11_conversation_repair, op12_quality, op13_spelling_variants)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_TERMS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_CRC = "SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t"


def _crc(codes: str) -> str:
    """The crc32 of a list of bytes, by the table t of _CRC."""
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
p AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM n),
wi AS (SELECT DISTINCT item_id, n, array_to_string(w[o:o + n - 1], ' ') AS win FROM p),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM d, (SELECT DISTINCT n FROM wi) WHERE len(w) >= n),
h AS (SELECT doc_id, o, dp.n, item_id FROM dp JOIN wi ON wi.n = dp.n AND wi.win = array_to_string(w[o:o + dp.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT o) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS o FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near),
c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op9_nearest_neighbours": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE crc AS ({_CRC}),
g(here, initial, there) AS (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
edits(edit, here, initial, there, paid) AS (
  SELECT 'D', here, '-', here, 4 FROM (VALUES ('E'), ('S'), ('U'), ('A')) x(here) UNION ALL SELECT 'K', here, initial, there, 0 FROM g UNION ALL SELECT 'R', here, initial, there, 3 FROM g WHERE initial <> 's'),
inserts(here, there, paid, audit, roles) AS (
  SELECT DISTINCT here, here, 0, '', '' FROM edits UNION ALL SELECT here, there, 3, 'I', initial FROM g WHERE initial <> 's'
  UNION ALL SELECT x.here, y.there, 6, 'II', x.initial || y.initial FROM g x JOIN g y ON y.here = x.there WHERE x.initial = 'u' AND y.initial = 'a'),
hashed AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT))")} % 20 AS f FROM conversations, crc),
damaged AS (SELECT k, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE f <> 0),
p AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM damaged),
b AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 AS again, lag(initial) OVER (PARTITION BY k ORDER BY pos) AS before FROM p),
r AS (SELECT *, blank OR again AS must, again AND NOT blank AS dup, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS trunc FROM b),
walk(k, pos, state, best) AS (
  SELECT k, 0, there, {{'cost': paid, 'audit': audit, 'roles': roles}} FROM (SELECT DISTINCT k FROM r), inserts WHERE here = 'E'
  UNION ALL
  SELECT w.k, w.pos + 1, i.there, min({{'cost': w.best.cost + e.paid + i.paid + CASE WHEN r.trunc AND e.edit <> 'D' THEN 3 ELSE 0 END, 'audit': w.best.audit || e.edit || i.audit, 'roles': w.best.roles || e.initial || i.roles}})
  FROM walk w JOIN r ON r.k = w.k AND r.pos = w.pos + 1 JOIN edits e ON e.here = w.state AND (e.edit = 'D' OR NOT r.must AND (e.edit = 'R' OR e.initial = r.initial)) JOIN inserts i ON i.here = e.there
  GROUP BY w.k, w.pos, i.there),
ends AS (SELECT k, min(best) AS best FROM walk JOIN (SELECT k, max(pos) AS pos FROM r GROUP BY k) USING (k, pos) WHERE state IN ('E', 'A') GROUP BY k),
letters AS (SELECT k, i, best.audit[i] AS edit, best.roles[i] AS initial, sum(CASE WHEN best.audit[i] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS pos FROM (SELECT k, best, unnest(range(1, length(best.audit) + 1)) AS i FROM ends)),
lines AS (SELECT l.k, l.i, CASE WHEN l.edit = 'K' THEN r.role WHEN l.initial = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l.edit = 'I' THEN '' ELSE r.text END AS line
  FROM letters l LEFT JOIN r ON r.k = l.k AND r.pos = l.pos WHERE l.edit <> 'D'),
shas AS (SELECT k, sha256(string_agg(line, chr(10) ORDER BY i)) AS sha FROM lines GROUP BY k),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k FROM conversations) LEFT JOIN counts USING (k) LEFT JOIN ends USING (k) LEFT JOIN shas USING (k)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE crc AS ({_CRC}),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))")} AS h FROM each, crc),
typed AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
keys AS (SELECT DISTINCT word, i, left(word, i - 1) || '*' || substr(word, i + 1) AS wild, left(word, i - 1) || substr(word, i + 1) AS less FROM places),
indels AS (SELECT DISTINCT k.word AS a, w.word AS b FROM keys k JOIN words w ON w.word = k.less),
pairs AS (SELECT x.word AS a, y.word AS b FROM keys x JOIN keys y ON x.wild = y.wild AND x.word <> y.word UNION SELECT a, b FROM indels UNION SELECT b, a FROM indels),
best AS (SELECT a AS word, count(*) AS n_near, min({{'less': -n, 'word': b}}) AS x FROM pairs JOIN words ON words.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.less >= 5 * w.n THEN x.word END AS form, CASE WHEN -x.less >= 5 * w.n THEN -x.less END AS form_n FROM words w LEFT JOIN best USING (word)),
roots(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT r.word, f.form FROM roots r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word) JOIN forms e ON e.word = r.root WHERE e.form IS NULL""",
}
