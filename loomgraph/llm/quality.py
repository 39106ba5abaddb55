"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once: the ledger holds the measurements and one long whose bits say which
rules a text fails. Policies are versioned sets of rules, so a verdict is ``bits & mask = 0``, and
ablations (what a policy would reject without one rule) are bitwise sums over the distinct bit sets.

Defined results: a null or empty text has no words and fails ``few_words``; white space alone is the
same; repeated rows are judged each; very long texts are measured whole (windows of eight words are
compared by 64-bit hashes of their words); an empty table gives an empty ledger; an input column
named like a new one gives way to it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_stutter"]

#: Rule names in the order of their bits, with the SQL condition of failure over MEASURES.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_letters": "10 * n_letters < 6 * word_chars",
    "upper_case": "2 * n_upper > n_letters",
    "stutter": "10 * n_stutter > 2 * n_words",
}
#: Versioned policies: the rules that reject.
POLICIES = {"base": ["few_words", "repeated_windows"], "v1": list(RULES)}


def mask(policy: str) -> int:
    return sum(1 << i for i, rule in enumerate(RULES) if rule in POLICIES[policy])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows that are found twice or more."""

    def marked(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def total(rows: Column) -> Column:
            twice = F.filter(rows, lambda x, j: (F.coalesce(F.get(rows, j - 1).h == x.h, F.lit(False))) | F.coalesce(F.get(rows, j + 1).h == x.h, F.lit(False)))
            places = F.sort_array(F.transform(twice, lambda x: x.i))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
            return F.aggregate(places, start, lambda a, i: F.struct((a.n + i + window - F.greatest(i, a.upto)).alias("n"), (i + window).alias("upto"))).n

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(ordered, total)).otherwise(0)

    # single elements are read in place; a slice would copy the whole array for each window
    of_words = F.transform(words, lambda w: F.xxhash64(w))
    hashes = _let(of_words, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)])))
    return F.when(F.size(words) > window, _let(hashes, marked)).otherwise(0).cast("long")


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add MEASURES and failed_bits to ``docs``.

    Everything is measured inside one expression, where words and lines are bound to variables: a
    filter that the optimizer moves below this projection still splits a text once.
    """
    kept = [c for c in docs.columns if c not in {*MEASURES, "failed_bits", "__ledger"}]
    white = F.lit(" \t\n\x0b\x0c\r")

    def words_of(body: Column) -> Column:
        bare = F.btrim(body, white)
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))

    def lines_of(body: Column) -> Column:
        return F.filter(F.split(body, "\n"), lambda x: F.btrim(x, white) != "")

    def measured(parts: Column) -> Column:
        body, words, lines = parts.body, parts.words, parts.lines
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_lines": F.size(lines),
            "n_letters": F.length(F.regexp_replace(body, r"\P{L}+", "")),
            "n_upper": F.length(F.regexp_replace(body, r"\P{Lu}+", "")),
            "n_stutter": F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in values.items()])

    body = F.coalesce(F.col(text), F.lit(""))
    measures = _let(body, lambda b: _let(F.struct(b.alias("body"), words_of(b).alias("words"), lines_of(b).alias("lines")), measured))
    rules = [re.sub(rf"\b({'|'.join(MEASURES)})\b", r"m.\1", rule) for rule in RULES.values()]
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(rules))
    fields = ", ".join(f"'{name}', m.{name}" for name in MEASURES)
    judged = F.expr(f"transform(array(__ledger), m -> named_struct({fields}, 'failed_bits', {bits}))[0]")
    return docs.select(*kept, measures.alias("__ledger")).select(*kept, judged.alias("__ledger")).select(*kept, "__ledger.*")


def apply_policy(ledger: DataFrame, policy: str = "v1", name: str = "kept") -> DataFrame:
    """Add a boolean column: no rule of the policy is failed."""
    return ledger.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: texts that fail it, and texts rejected by it alone.

    Texts are first counted for each distinct bit set (at most two to the power of the rules), so
    the sums over rules touch a bounded table.
    """
    sets = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r in POLICIES[policy]]
    each = sets.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("r.rule", "r.bit", "bits", "n")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )
