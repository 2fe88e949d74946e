"""Operator 7 [native]: secret scans by patterns and character Markov models, with DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The base patterns by kind, in the order in which kinds are listed, and the least length that counts.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run below the least length cannot hold a longer match, so both ask for the least length at once: far fewer matches to sift.
ACCESS, HEX = r"(AKIA[A-Z0-9]{14,})", r"([0-9a-f]{16,})"
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 1, 18), ("hex", HEX, 1, 16))
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,end:int,kind:int>>"
CHUNK = 64
TOKEN, TOKEN_CHARS = r"([A-Za-z0-9+/_=-]{20,})", 20

#: Parts from which ordinary identifiers are labelled samples, in pairs and threes.
IDENTIFIER_PARTS = """account action active address agent alias amount array asset author balance base batch billing binary block body border
branch bucket buffer build button byte cache call cancel card category center change channel char check child city class client clock close code
column command comment commit company config connection content context control convert cookie copy count country create currency current cursor
customer data database date debug default delete delivery depth description detail device digit directory disable document domain download draft
edit element email enable encode end engine entity entry error event exception execute export factory feature field file filter final find first
flag folder font form format forward frame function gateway generate get global group handle handler hash header height history host icon id image
import index info init inner input insert instance interface invoice item iterator key label language last layer layout length level library limit
line link list listener load local location lock log login logout loop main manager map match memory menu merge message method minute mode model
module month mouse move name network next node note number object offset open option order output owner package page panel parent parse part path
pattern payment phone picture player plugin point policy pool port position post prefix price print private process product profile project property
provider public query queue random range rate read record region register release remove render report request reset resource response result return
role root route row rule sample save scale schema scope screen script search second section select sequence server service session set setting shape
share size sort source stack start state status step stop store stream string style submit subject success suffix sum support switch symbol system
table tag target task template test text thread time title total trace track transaction tree type unit update upload url user util value vector
version video view visible warning weight widget width window word worker wrapper write year zone""".split()

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def labelled_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(label, s): random base64 and hexadecimal strings made from hashes, and ordinary text: identifiers in five spellings,
    paths, name=value, numbers and ruled lines."""
    parts = F.split(F.lit(" ".join(IDENTIFIER_PARTS)), " ")
    pick = lambda k: F.get(parts, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_PARTS))).cast("int"))
    digest = F.sha2(F.concat(F.lit("axisflow"), F.col("id").cast("string")), 256)
    snake, kebab = F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat_ws("-", pick(4), pick(5), pick(6))
    camel = F.concat(pick(7), F.initcap(pick(8)), F.initcap(pick(9)))
    path, named = F.concat_ws("/", *map(pick, range(13, 17))), F.concat(pick(17), F.lit("="), pick(18), F.lit("+"), pick(19))
    upper, heads = F.upper(F.concat_ws("_", pick(20), pick(21), pick(22))), F.concat(*(F.initcap(pick(i)) for i in range(23, 27)))
    number = F.concat(F.abs(F.xxhash64("id", F.lit(27))).cast("string"), F.lit("-"), F.abs(F.xxhash64("id", F.lit(28))).cast("string"))
    line = F.repeat(F.get(F.split(F.lit("- = _ + / -= +-"), " "), F.pmod("id", F.lit(7)).cast("int")), 20)
    ids = spark.range(rows)
    plain = (snake, kebab, camel, F.concat(pick(10), pick(11), pick(12)), path, named, upper, heads, number, line)
    ordinary = ids.select(F.lit("ordinary").alias("label"), F.explode(F.array(*plain)).alias("s"))
    random = ids.select(F.lit("random").alias("label"), F.explode(F.array(F.rtrim(F.base64(F.unhex(digest)), F.lit("=")), F.base64(F.unhex(F.substring(digest, 1, 48))), digest)).alias("s"))
    return ordinary.unionByName(random)


def learn_markov(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each pair of successive characters, from samples(label, s).

    Counted with DataFrame functions; what reaches the driver is one row a pair of ALPHABET and label.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))
    counts = samples.where(F.length("s") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()
    seen = {(r["label"], r["pair"]): r["count"] for r in counts}
    after: dict[tuple[str, str], int] = {}
    for (label, pair), n in seen.items():
        after[label, pair[0]] = after.get((label, pair[0]), 0) + n
    k = len(ALPHABET)

    def log_p(label: str, a: str, b: str) -> float:
        return math.log((seen.get((label, a + b), 0) + smoothing) / (after.get((label, a), 0) + smoothing * k))

    return [round(log_p("random", a, b) - log_p("ordinary", a, b), 4) for a in ALPHABET for b in ALPHABET]


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), 0)  # so that the value is computed once


def _chunks(array: Column) -> Column:
    """The array in parts of CHUNK elements; none, if it is empty."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(array), F.lit(CHUNK)), lambda i: i < F.size(array)), lambda i: F.slice(array, i + 1, F.lit(CHUNK)))


def _matches(text: Column, pattern: str, group: int, least: int, kind: str, with_text: bool = False) -> Column:
    """Spans of the matches of a pattern whose group has the least length, in code points.

    What stands between matches, by split, gives the places; split and extraction walk the text in the same way. Lengths are
    summed by chunks, then within each, so that the work does not grow with the square of the matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(whole, F.char_length)
    groups = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
    more = [whole.alias("s")] if with_text else []
    extra = lambda x: [x["s"].alias("s")] if with_text else []
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), groups.alias("group"), *more), lambda x: x["size"].isNotNull())
    total = lambda part: F.aggregate(part, F.lit(0), lambda t, x: t + x["gap"] + x["size"])

    def placed(part: Column, before: Column) -> Column:
        start = lambda x, i: before + total(F.slice(part, F.lit(1), i)) + x["gap"]
        spans = F.transform(part, lambda x, i: F.struct(start(x, i).alias("start"), x["size"].alias("size"), x["group"].alias("group"), *extra(x)))
        return F.transform(F.filter(spans, lambda x: x["group"] >= least), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), *extra(x)))

    def all_placed(parts: Column) -> Column:
        sums = F.aggregate(
            F.transform(parts, total), F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("before")),
            lambda s, n: F.struct((s["to"] + n).alias("to"), F.concat(s["before"], F.array(s["to"])).alias("before")))
        zipped = F.arrays_zip(parts.alias("part"), sums["before"].alias("before"))
        return F.flatten(F.transform(zipped, lambda x: placed(x["part"], x["before"])))

    return F.when(text.rlike(pattern), _let(rows, lambda r: _let(_chunks(r), all_placed))).otherwise(F.array().cast(SPANS.replace("kind:int", "kind:int,s:string") if with_text else SPANS))


def find_secrets(docs: DataFrame, scores: list[float] | None = None, threshold: float = 0.8) -> DataFrame:
    """The rows of docs with one more column `secret_spans`: array of (start, end, kind), code points, end exclusive, sorted.

    Base kinds are assign, access and hex. `random` are runs of at least 20 token characters whose mean log-likelihood ratio a
    character pair passes `threshold`, where no base span overlaps them. In other runs it is the windows of 20 characters, clear
    of base spans, that pass it, joined and widened to the next of = / + - _, so that text glued to a secret does
    not hide it; such spans may take in some of that text.
    Whole texts; null or empty texts have no spans; repeated rows give repeated results; other columns stay as they are
    (a column secret_spans of docs is replaced); no shuffle.
    """
    scores = learn_markov(labelled_samples(docs.sparkSession)) if scores is None else scores
    table = F.from_json(F.lit(json.dumps(scores)), "array<double>")
    text, k = F.coalesce(F.col("text"), F.lit("")), len(ALPHABET)

    def ratios(s: Column) -> Column:
        place = F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
        return F.zip_with(F.slice(place, 1, F.length(s) - 1), F.slice(place, 2, F.length(s) - 1), lambda a, b: F.get(table, a * k + b))

    def mean(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / F.size(pairs)

    let = _let
    of_base, of_parts, of_tokens = fresh(docs, "base_spans", "base_parts", "token_spans")
    base = F.array_sort(F.concat(*(_matches(text, p, g, n, kind) for kind, p, g, n in BASE)))
    tokens = _matches(text, TOKEN, 1, TOKEN_CHARS, "random", True)
    parts_of = F.transform(_chunks(F.col(of_base)), lambda p: F.struct(F.array_min(F.transform(p, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(p, lambda b: b["end"])).alias("hi"), p.alias("part")))
    found = docs.withColumn(of_base, base).withColumn(of_parts, parts_of).withColumn(of_tokens, tokens)

    span, at = SPANS, KINDS.index("random")

    def piece(start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(at).alias("kind"))

    def clear(x: Column) -> Column:
        meets = lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
        return ~F.exists(of_parts, lambda p: (p["lo"] < x["end"]) & (x["start"] < p["hi"]) & F.exists(p["part"], meets))

    def join(pieces: Column) -> Column:
        """Sorted spans, those that overlap or touch made one."""
        state = F.aggregate(
            pieces, F.struct(F.array().cast(span).alias("done"), F.lit(None).cast(span[6:-1]).alias("last")),
            lambda t, x: F.when(t["last"].isNull(), F.struct(t["done"].alias("done"), x.alias("last")))
            .when(x["start"] <= t["last"]["end"], F.struct(t["done"].alias("done"), piece(F.least(t["last"]["start"], x["start"]), F.greatest(t["last"]["end"], x["end"])).alias("last")))
            .otherwise(F.struct(F.concat(t["done"], F.array(t["last"])).alias("done"), x.alias("last"))))
        return let(state, lambda t: F.when(t["last"].isNull(), t["done"]).otherwise(F.concat(t["done"], F.array(t["last"]))))

    def parts(x: Column, s: Column, pairs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.length(s) - TOKEN_CHARS), lambda i: mean(F.slice(pairs, i + 1, F.lit(TOKEN_CHARS - 1))) >= threshold)
        windows = F.filter(F.transform(starts, lambda i: piece(x["start"] + i, x["start"] + i + TOKEN_CHARS)), clear)
        alnum = lambda r: F.length(F.regexp_extract(r, "^[A-Za-z0-9]*", 0))
        part = lambda a, b: F.substring(s, a + 1, b - a)

        def wide(w: Column) -> Column:
            return piece(w["start"] - alnum(F.reverse(part(F.lit(0), w["start"] - x["start"]))), w["end"] + alnum(part(w["end"] - x["start"], F.length(s))))

        return join(F.transform(join(windows), wide))

    def random(x: Column) -> Column:
        judge = lambda run, pairs: F.when(clear(x) & (mean(pairs) >= threshold), F.array(piece(x["start"], x["end"]))).otherwise(parts(x, run, pairs))
        return let(x["s"], lambda run: let(ratios(run), lambda pairs: judge(run, pairs)))

    every = F.concat(F.col(of_base), F.flatten(F.transform(of_tokens, random)))
    spans = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    named = F.transform(spans, lambda x: F.struct(x["start"], x["end"], F.get(F.array(*map(F.lit, KINDS)), x["kind"]).alias("kind")))
    return found.withColumn("secret_spans", named).drop(of_base, of_parts, of_tokens)


def secret_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets, a row for each of its rows; without spans the counts are 0 and the texts empty."""
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        F.col("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("secret_spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Texts with the union of overlapping secret spans replaced by `mark`, n_chars following; the columns of docs.

    Null texts stay null, texts without secrets as they are; repeated rows give repeated results; no rows: none.
    """
    state = F.aggregate(
        "secret_spans", F.struct(F.lit(0).alias("to"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["to"], x["end"]).alias("to"),
            F.when(x["start"] >= s["to"], F.concat(s["out"], F.substring(F.col("text"), s["to"] + 1, x["start"] - s["to"]), F.lit(mark))).otherwise(s["out"]).alias("out")))
    whole = F.concat(state["out"], F.substring(F.col("text"), state["to"] + 1, F.char_length("text")))
    hit, = fresh(found, "has_secret")
    clean = found.withColumn(hit, F.size("secret_spans") > 0).withColumn("text", F.when(F.col(hit), whole).otherwise(F.col("text")))
    if "n_chars" in found.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(hit), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.drop("secret_spans", hit)
