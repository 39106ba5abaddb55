"""Source-code tokens: a lossless splitter, the Python lexer, and abstract tokens in Arrow and pandas UDFs."""

from __future__ import annotations

import functools
import io
import keyword
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["NONE", "PUNCTUATION", "KEYWORD", "IDENTIFIER", "STRING", "NUMBER", "COMMENT", "NEWLINE", "EOS", "ERROR", "WHITESPACE"]
SPACE_RUN = 20
#: Characters of texts whose tokens are Python objects at once.
PART = 1 << 18
TOKEN = T.StructType([T.StructField("spelling", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])



class _Kinds(dict):
    """Class letter of a character: upper, lower, number, blank, tab, other white space, other."""

    def __missing__(self, c: str) -> str:
        tests = ((str.isupper, "U"), (str.islower, "L"), (str.isdigit, "N"), (" ".__eq__, "B"), ("\t".__eq__, "T"), (str.isspace, "W"))
        self[c] = next((kind for test, kind in tests if test(c)), "X")
        return self[c]


_KINDS = _Kinds()
_RUNS = re.compile(r"U?L+|U+(?!L)|N+|B{1,%d}|T{1,%d}|W|X+" % (SPACE_RUN, SPACE_RUN))


def lossless_pieces(text: str) -> list[str]:
    """Pieces of one character class that join to the text.

    Classes are those of Unicode: a capital goes with the small letters after it, digits and other
    characters stay together in runs, equal blanks or tabs up to SPACE_RUN; other white space is single.
    """
    return [text[m.start() : m.end()] for m in _RUNS.finditer("".join(map(_KINDS.__getitem__, text)))]


def python_tokens(code: str) -> list[tuple[str, str, int, int]]:
    """(spelling, kind, line, column) of Python source; what can't be read is one ERROR and the end."""
    out = []
    try:
        for tok in tokenize.generate_tokens(io.StringIO(code).readline):
            kind = {
                tokenize.NAME: "KEYWORD" if keyword.iskeyword(tok.string) else "IDENTIFIER",
                tokenize.NUMBER: "NUMBER",
                tokenize.STRING: "STRING",
                tokenize.COMMENT: "COMMENT",
                tokenize.OP: "PUNCTUATION",
                tokenize.NEWLINE: "NEWLINE",
                tokenize.NL: "NEWLINE",
                tokenize.INDENT: "WHITESPACE",
                tokenize.DEDENT: "WHITESPACE",
                tokenize.ENDMARKER: "EOS",
            }.get(tok.type, "STRING" if tokenize.tok_name[tok.type].startswith("FSTRING") else "ERROR")
            spelling = {tokenize.NEWLINE: "NEWLINE", tokenize.NL: "NL", tokenize.DEDENT: "DEDENT"}.get(tok.type, tok.string)
            spelling = f"INDENT{tok.string}" if tok.type == tokenize.INDENT else spelling
            out.append((spelling, kind, *tok.start))
    except (tokenize.TokenError, SyntaxError, ValueError):
        return [("ERROR", "ERROR", 1, 0), ("", "EOS", 1, 0)]
    return out


def _in_parts(texts: pa.Array, made, kind: pa.DataType) -> pa.Array:
    """A value of each text, of which only a part of about ``PART`` characters is Python objects at a time."""
    done, held, size = [], [], 0
    for text in texts:
        text = text.as_py()
        held.append(None if text is None else made(text))
        size += len(text or "")
        if size >= PART:
            done.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*done, pa.array(held, kind)])


@F.arrow_udf(T.ArrayType(T.StringType()))
def lossless_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield _in_parts(batch, lossless_pieces, pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(TOKEN))
def lexed_python(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    token = pa.struct([("spelling", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("column", pa.int32())])
    for batch in texts:
        yield _in_parts(batch, lambda t: [dict(zip(token.names, tok, strict=True)) for tok in python_tokens(t)], pa.list_(token))


def greedy_bpe(vocabulary: list[str], unknown: int = 0):
    """Column function: ids of the longest vocabulary entries that match from the left, each word closed by ``#``.

    An entry that would leave the closing mark alone is passed over; the last two characters are one
    token; where no entry of two or more characters fits, one character is. What the vocabulary lacks is ``unknown``.
    """
    ids = {token: i for i, token in enumerate(vocabulary)}
    lengths = sorted({len(t) for t in vocabulary if len(t) > 1}, reverse=True)

    def encode(word: str) -> list[int]:
        closed, at, out = word + "#", 0, []
        while (left := len(closed) - at) > 0:
            size = 2 if left == 2 else next((n for n in lengths if n <= left and n != left - 1 and closed[at : at + n] in ids), 1)
            out.append(ids.get(closed[at : at + size], unknown))
            at += size
        return out

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = functools.lru_cache(1 << 16)(encode)
        for series in words:
            yield series.map(lambda w: None if w is None else known(w))

    return ids_of
