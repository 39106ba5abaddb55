"""Tokens of a text as arrays in its row: lexing by one pattern, splitting by kind, and back again.

All are column expressions: nothing leaves the row, so no token is shuffled, and each is linear in
the text. A token is a struct (spelling, kind), a piece a struct (token, spelling, last) that names the place
of the token it belongs to.
"""

from __future__ import annotations

import unicodedata
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.lexing import SPACE_RUN
from loomgraph.functions.text import LONGEST, MAPPINGS, SENTINEL, check_mappings, identifier_pieces, long_token_pieces, sanitize, unsanitize

#: Kinds that split like text, and kinds whose pieces are bounded in length.
LIKE_TEXT = ("COMMENT", "STRING", "WHITESPACE", "ERROR")
BY_LENGTH = ("COMMENT", "STRING", "NUMBER", "IDENTIFIER", "WHITESPACE", "ERROR")
#: What a token of each kind looks like, tried in this order; any other character is punctuation.
PATTERNS = {
    "COMMENT": r"#[^\n]*",
    "STRING": r'"(?:[^"\\\n]|\\.)*"',
    "NEWLINE": r"\n",
    "WHITESPACE": r"[ \t\r\f\x0B]+",
    "NUMBER": r"[0-9]+(?:\.[0-9]+)?",
    "IDENTIFIER": r"[\p{L}_][\p{L}\p{M}\p{Nd}_]*",
}
OTHER = "PUNCTUATION"


def _ranges(test) -> str:
    """The characters that pass a test, as the inside of a pattern's class."""
    codes = [c for c in range(0x110000) if test(chr(c))]
    starts = [codes[0], *[b for a, b in pairwise(codes) if b != a + 1]]
    ends = [*[a for a, b in pairwise(codes) if b != a + 1], codes[-1]]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


def _lossless_pattern() -> str:
    """Runs of one class: a capital with the small letters after it, digits, blanks or tabs up to a bound, other white space singly, and the rest."""
    upper, lower = r"\p{IsUppercase}", r"\p{IsLowercase}"
    digit = r"\p{Nd}" + _ranges(lambda c: c.isdigit() and unicodedata.category(c) != "Nd")
    space = _ranges(lambda c: c.isspace() and c not in " \t")
    rest = rf"[^{upper}{lower}{digit}{space} \t]"
    return rf"{upper}?{lower}+|{upper}+(?!{lower})|[{digit}]+| {{1,{SPACE_RUN}}}|\t{{1,{SPACE_RUN}}}|[{space}]|{rest}+"


LOSSLESS = _lossless_pattern()


def lossless_pieces(text: Column) -> Column:
    """Pieces of one character class that join to the text."""
    return F.regexp_extract_all(text, F.lit(LOSSLESS), F.lit(0))


def lexed(text: Column) -> Column:
    """Tokens that join to the text; null has none."""
    whole = "|".join(PATTERNS.values()) + r"|(?s:.)"
    kind = lambda s: F.coalesce(*[F.when(s.rlike(rf"\A(?:{pattern})\z"), F.lit(name)) for name, pattern in PATTERNS.items()], F.lit(OTHER))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(whole), F.lit(0)), lambda s: F.struct(s.alias("spelling"), kind(s).alias("kind")))


def conditioned(tokens: Column, skip: tuple[str, ...] = (), reserved: tuple[str, ...] = ()) -> Column:
    """Without the kinds to skip; what is spelled like a reserved word is a keyword, whatever it was."""
    kept = F.filter(tokens, lambda t: ~t.kind.isin(*skip)) if skip else tokens
    if not reserved:
        return kept
    return F.transform(kept, lambda t: F.struct(t.spelling.alias("spelling"), F.when(t.spelling.isin(*reserved), "KEYWORD").otherwise(t.kind).alias("kind")))


def split_by_kind(spelling: Column, kind: Column, longest: int = LONGEST) -> Column:
    """Pieces of a token: names at their humps, text like text, and the kinds bounded in length cut to ``longest``; others stay whole."""
    parts = F.when(kind == "IDENTIFIER", identifier_pieces(spelling)).when(kind.isin(*LIKE_TEXT), lossless_pieces(spelling)).otherwise(F.array(spelling))
    parts = F.when(F.size(parts) == 0, F.array(spelling)).otherwise(parts)
    short = F.flatten(F.transform(parts, lambda p: long_token_pieces(p, longest)))
    return F.when(kind.isin(*BY_LENGTH), short).otherwise(parts)


def pieces(tokens: Column, longest: int = LONGEST, mappings: dict[str, str] = MAPPINGS) -> Column:
    """All pieces of all tokens in order, sanitized, those that go on marked by the sentinel.

    ``mappings`` must replace the sentinel, so that a mark can't be mistaken for text.
    """
    check_mappings(mappings)
    if SENTINEL not in mappings:
        raise ValueError("the sentinel must be among the characters replaced")

    def of(token: Column, number: Column) -> Column:
        def piece(spelling: Column, last: Column) -> Column:
            mark = F.when(last, F.lit("")).otherwise(F.lit(SENTINEL))
            return F.struct(number.alias("token"), F.concat(sanitize(spelling, mappings), mark).alias("spelling"), last.alias("last"))

        parts = split_by_kind(token.spelling, token.kind, longest)
        # the last of the parts is told apart by slices, so that the parts are made twice and not once for each
        return F.concat(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: piece(p, F.lit(False))), F.array(piece(F.element_at(parts, -1), F.lit(True))))

    return F.flatten(F.transform(tokens, of))


def whole_tokens(marked: Column, mappings: dict[str, str] = MAPPINGS) -> Column:
    """Spellings of the whole tokens from marked pieces: the marks of all pieces joined by a line feed say where tokens end.

    An open token at the end is one too. Pieces hold no line feed, as it has to be among the mappings.
    """
    if "\n" not in mappings:
        raise ValueError("the line feed must be among the characters replaced")
    joined = F.replace(F.array_join(marked, "\n"), F.lit(f"{SENTINEL}\n"), F.lit(""))
    closed = F.regexp_replace(joined, rf"\{SENTINEL}\z", "")
    return F.when(F.size(marked) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(closed, "\n", -1), lambda t: unsanitize(t, mappings)))
