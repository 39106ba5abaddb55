"""Secret scan with DataFrame functions only: fixed patterns, and two character Markov models.

One model is of random strings, one of ordinary identifiers; both are first-order over the letters
of identifiers and are trained from labelled samples by one aggregation of letter pairs. A candidate
(a long run of identifier letters that holds a digit and a letter) is a secret if its log-likelihood
ratio under the two models passes a threshold. Patterns' spans always stay; candidates that overlap
one of them are not reported again.

Positions are found by splitting at the matches: the lengths of the pieces between and of the
matches themselves add up to starts and ends in code points.

Defined results: a null or empty text has no spans; repeated rows are scanned each; very long texts
are scanned whole; an empty table gives an empty result; an input column named like a new one gives
way to it.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns, and how long what they match has to be.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE, ACCESS_CHARS = 6, 20
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "api"]
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 10.0
#: Words of ordinary identifiers that every training sample holds, however small the corpus.
PLAIN = (
    "account address adapter array average batch brown buffer builder button cache change channel client color column config context count create current customer daily data date default delete "
    "document element encoder error event example factory field file filter first format forward function global group handler header height history identifier image index input instance item "
    "language last latest length level limit line linear list local logger manager matrix message method model module monthly name network node number object offset option order output package "
    "page parameter parent parser path pattern payment plain position previous product project property quick random range reader record report request resource response result return route "
    "sample schema score search section server service session simple size some sort source start state station status stock store stream string table target task temp test text the thread time "
    "total train type update upper user utils value variable vector version view weekly weight width window worker writer year"
).split()
#: Texts that ordinary identifiers are taken from, and random strings made, at most about.
SAMPLE_TEXTS = 500
SAMPLE_STRINGS = 4000

_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def labelled_samples(docs: DataFrame, key: str, text: str, texts: int = SAMPLE_TEXTS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(sample, is_random): digests in two alphabets, and identifiers joined from neighbouring words of a hash sample of texts."""
    spark = docs.sparkSession
    share = max(1, min(1 << 20, (texts << 20) // max(1, docs.count()) + 1))
    words = docs.where(F.pmod(F.xxhash64(key, text), F.lit(1 << 20)) < share).select(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]+"), lambda w: F.length(w) >= 3).alias("w"))

    def joined(w: Column) -> Column:
        number = lambda i: F.pmod(F.xxhash64(w[i], w[i + 1]), F.lit(100)).cast("string")
        at = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        snake = F.transform(at, lambda i: F.concat(F.lower(w[i]), F.lit("_"), F.lower(w[i + 1]), F.lit("_"), number(i)))
        camel = F.transform(at, lambda i: F.concat(F.lower(w[i]), F.initcap(w[i + 1]), number(i)))
        kebab = F.transform(at, lambda i: F.concat(F.lit("20"), number(i), F.lit("-"), F.lower(w[i]), F.lit("-"), F.lower(w[i + 1])))
        return F.concat(snake, camel, kebab)

    plain = spark.range(20).select(F.sort_array(F.transform(F.array(*map(F.lit, PLAIN)), lambda w: F.struct(F.xxhash64(w, F.col("id")).alias("h"), w.alias("w")))).alias("s")).select(F.transform("s", lambda x: x.w).alias("w"))
    ordinary = words.unionByName(plain).select(F.explode(joined(F.col("w"))).alias("sample"), F.lit(False).alias("is_random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = spark.range(strings).select(F.when(F.col("id") % 4 == 0, digest).otherwise(F.rtrim(F.translate(F.base64(F.unhex(digest)), "=", " "))).alias("sample"), F.lit(True).alias("is_random"))
    return ordinary.unionByName(random)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of letter pairs, row by row; add-one smoothing. At most two counts a pair reach the driver."""
    size = len(LETTERS)
    pairs = samples.select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("sample") - 1, F.lit(1))), lambda i: F.substring(F.col("sample"), i, 2))).alias("pair"))
    counts: dict[tuple[bool, int, int], int] = {}
    for row in pairs.groupBy("is_random", "pair").agg(F.count("*").alias("n")).where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[row.is_random, LETTERS.index(row.pair[0]), LETTERS.index(row.pair[1])] = row.n
    out = []
    for a in range(size):
        totals = {kind: size + sum(counts.get((kind, a, b), 0) for b in range(size)) for kind in (True, False)}
        out += [log((counts.get((True, a, b), 0) + 1) / totals[True]) - log((counts.get((False, a, b), 0) + 1) / totals[False]) for b in range(size)]
    return out


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string of LETTERS."""
    size = len(LETTERS)
    codes = F.split(F.lit(",".join(str(LETTERS.find(chr(c))) for c in range(128))), ",").cast("array<int>")
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.get(codes, F.ascii(c)))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct(i.alias("last"), (a.sum + F.when(a.last < 0, 0.0).otherwise(F.get(table, a.last * size + i))).alias("sum"))
    return F.aggregate(F.filter(places, lambda i: i >= 0), start, step).sum


def placed(text: Column, pattern: str, found: Column, good: Column, kind: int) -> Column:
    """Spans of the matches ``found`` of a pattern where the boolean array ``good`` is true."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), good.alias("good"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(a: Column, p: Column) -> Column:
        begin = a.at + F.length(p.gap)
        end = begin + F.coalesce(F.length(p.hit), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(F.coalesce(p.good, F.lit(False)), F.concat(a.out, span)).otherwise(a.out).alias("out"))

    return F.when(F.exists(good, lambda x: x), F.aggregate(pieces, start, step).out).otherwise(F.array().cast(_SPAN))


def secret_spans(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add base_spans and added_spans, arrays of (start, kind, stop) with KINDS by number, ends exclusive, in code points."""
    kept = [c for c in docs.columns if c not in ("base_spans", "added_spans")]
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    says = low.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        says = says | low.contains(word)
    nothing = F.array().cast("array<string>")
    found = docs.select(
        *kept,
        body.alias("__t"),
        F.when(says, F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0))).otherwise(nothing).alias("__assign"),
        F.when(says, F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))).otherwise(nothing).alias("__value"),
        F.when(body.contains("AKIA"), F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0))).otherwise(nothing).alias("__access"),
        F.regexp_extract_all(body, F.lit(HEX), F.lit(0)).alias("__hex"),
        F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("__long"),
    )
    t = F.col("__t")
    base = F.concat(
        placed(t, ASSIGN, F.col("__assign"), F.transform("__value", lambda v: F.length(v) >= ASSIGN_VALUE), 0),
        placed(t, ACCESS, F.col("__access"), F.transform("__access", lambda v: F.length(v) >= ACCESS_CHARS), 1),
        placed(t, HEX, F.col("__hex"), F.transform("__hex", lambda v: F.lit(True)), 2),
    )
    likely = placed(t, CANDIDATE, F.col("__long"), F.transform("__long", lambda v: log_ratio(v, ratios) >= threshold), 3)
    spans = found.select(*kept, F.array_sort(base).alias("base_spans"), likely.alias("__likely"))
    clear = F.filter("__likely", lambda s: ~F.exists("base_spans", lambda b: (b.start < s.stop) & (s.start < b.stop)))
    return spans.select(*kept, "base_spans", clear.alias("added_spans"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.stop.cast("string"))), ",")


def scan_secrets(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on samples of ``docs`` and scan them all."""
    return secret_spans(docs, train(labelled_samples(docs, key, text)), text)
