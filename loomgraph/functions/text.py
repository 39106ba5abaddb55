"""String functions on columns: labels, sanitizing, identifier pieces, long tokens, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.plans.relations import EXPRESSION_KINDS, STATEMENT_KINDS

#: Characters replaced by default, in this order.
MAPPINGS = {"\n": "___NLCHAR___", "\r": "___CR___", "^": "___CARET___"}
SENTINEL = "^"
LONGEST = 15
VALUE_CHARS = 15


def quote_special(text: str) -> str:
    return f"___{text}___"


def check_mappings(mappings: dict[str, str]) -> None:
    """Keys of one character; values that aren't empty, are distinct, contain no key and not each other."""
    values = list(mappings.values())
    if any(len(k) != 1 for k in mappings) or not all(values) or len(set(values)) != len(values):
        raise ValueError("keys are single characters, values distinct and not empty")
    if any(k in v for k in mappings for v in values):
        raise ValueError("a value contains a key")
    if any(a != b and a in b for a in values for b in values):
        raise ValueError("a value contains another")


def sanitize(text: Column, mappings: dict[str, str] = MAPPINGS) -> Column:
    check_mappings(mappings)
    for old, new in mappings.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unsanitize(text: Column, mappings: dict[str, str] = MAPPINGS) -> Column:
    for old, new in mappings.items():
        text = F.replace(text, F.lit(new), F.lit(old))
    return text


def escaped(text: Column) -> Column:
    """Line feed, return and tab as two characters each."""
    for old, new in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def long_token_pieces(token: Column, longest: int = LONGEST) -> Column:
    """Pieces of at most ``longest`` characters; an empty token is one empty piece."""
    count = F.greatest(F.ceil(F.length(token) / longest).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(token, i * longest + 1, F.lit(longest)))


def marked_pieces(pieces: Column) -> Column:
    """Pieces sanitized, all but the last with the sentinel."""
    return F.transform(pieces, lambda p, i: F.concat(sanitize(p), F.when(i < F.size(pieces) - 1, SENTINEL).otherwise("")))


def reconstituted(pieces: Column) -> Column:
    """Whole tokens from marked pieces: pieces that end in the sentinel go on with the next."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        more = p.endswith(SENTINEL)
        text = F.concat(a.open, F.when(more, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p))
        return F.struct(F.when(more, a.done).otherwise(F.concat(a.done, F.array(text))).alias("done"), F.when(more, text).otherwise("").alias("open"))

    return F.transform(F.aggregate(pieces, start, step).done, lambda x: unsanitize(x))


def identifier_pieces(name: Column) -> Column:
    """Pieces of a name at capitals and underscores; underscores stay with the piece before, leading ones are a piece.

    Whatever is no capital (digits too) goes on with the piece it follows; a title-case letter is a
    capital with a small letter after it.
    """
    small = r"[^\p{Lu}\p{Lt}_]"
    return F.regexp_extract_all(name, F.lit(rf"^_+|(?:\p{{Lt}}{small}*|\p{{Lu}}{small}+|\p{{Lu}}+(?!{small})|{small}+)_*"), F.lit(0))


def bare(text: Column) -> Column:
    """Without white space of any kind (control separators and the Unicode property)."""
    return F.regexp_replace(text, r"[\x{1C}-\x{1F}\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", "")


def content_digest(text: Column) -> Column:
    return F.sha2(bare(text), 256)


def label_relation(label: Column) -> Column:
    return F.regexp_extract(label, r"^([^(]*)\(", 1)


def label_values(label: Column) -> Column:
    """Values of a tuple label; for strings, whose first value may hold commas, the last two are split off."""
    inside = F.regexp_extract(label, r"(?s)^[^(]*\((.*)\)$", 1)
    text = F.array(*[F.regexp_extract(inside, r"(?s)^(.*),([^,]*),([^,]*)$", i) for i in (1, 2, 3)])
    return F.when(label_relation(label) == "py_strs", text).otherwise(F.transform(F.split(inside, ","), lambda x: F.trim(x)))


def node_type(rel: Column, vals: Column) -> Column:
    named = lambda kinds, prefix: F.concat(F.lit(prefix), F.get(F.array(*map(F.lit, kinds)), F.get(vals, F.lit(1)).try_cast("int")))
    return F.when(rel == "variable", F.concat(F.lit("v_"), vals[0])).when(rel == "py_exprs", named(EXPRESSION_KINDS, "expr_py_")).when(rel == "py_stmts", named(STATEMENT_KINDS, "stmt_py_")).otherwise(rel)


def node_value(rel: Column, vals: Column) -> Column:
    return F.when(rel == "variable", F.get(vals, F.lit(2))).when(rel == "py_strs", F.substring(vals[0], 1, VALUE_CHARS)).otherwise("")


def edge_halves(label: Column) -> Column:
    """The two columns of an edge label, with or without its parentheses."""
    return F.split(F.regexp_replace(label, r"^\(|\)$", ""), ",")


def normal_edge_label(label: Column) -> Column:
    return F.when(label.startswith("("), label).otherwise(F.concat(F.lit("("), label, F.lit(")")))


def alert_name(message: Column) -> Column:
    """The name quoted in an alert."""
    return F.regexp_extract(message, "'([^']*)'", 1)


def positional_encoding(position: Column, dims: int) -> Column:
    """Sines at even and cosines at odd dimensions."""
    angle = lambda i: position.cast("double") * F.exp(F.lit(-(2 * (i // 2)) * 9.210340371976184 / dims))
    return F.array(*[F.sin(angle(i)) if i % 2 == 0 else F.cos(angle(i)) for i in range(dims)])


def truncated_pair(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    """Lengths left when the longer of two is shortened until both fit; of equal ones the second."""
    over = F.greatest(a + b - limit, F.lit(0))
    gap = F.abs(a - b)
    level = F.greatest(over - gap, F.lit(0))  # what both give once they are equal
    from_b = F.when(b >= a, F.least(over, gap)).otherwise(0) + F.ceil(level / 2)
    from_a = F.when(a > b, F.least(over, gap)).otherwise(0) + F.floor(level / 2)
    return a - from_a, b - from_b


def padded(values: Column, length: int, fill) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), length)), 1, length)
