"""Tokens by kind and their pieces, against plain versions; layout from places."""

import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import lexing, text, tokens
from loomgraph.operators import layout

CODE = '''def parseHTMLPage(x_1, *args):
    # a Comment  here, 12.5 times

    someLongIdentifierName_ = "two  words^ and\\\\"quotes" + 3.14


  return  x_1 ^ 2
    ends  '''


def texts(seed=1):
    rng = random.Random(seed)
    parts = ["camelCase", "HTMLPage", "_x__y", "été", "ǅungla", "12", "3.5", " ", "  ", "\t", "\n", "\n\n", "#note it", '"a b"', '"', "^", "(", "+=", "世界", "½", "²", "x" * 40, "\r", " "]
    return [CODE, "", "\n", "  ", None] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc int, text string").withColumn("tokens", tokens.lexed(F.col("text"))).cache()


def test_lossless_same_as_plain(spark):
    """Every character on its own and in random company, as far as both engines know it."""
    rng = random.Random(2)
    known = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and unicodedata.age(chr(c)) <= "9"] if hasattr(unicodedata, "age") else [chr(c) for c in range(1, 0x590)]
    odd = ["A" + c + "b" + c + "1" for c in known] + ["".join(rng.choice("aAbB19  \t\n_-é世²") for _ in range(30)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", tokens.lossless_pieces(F.col("t")).alias("p")).collect()
    assert [r.p for r in rows] == [lexing.lossless_pieces(r.t) for r in rows]


def plain_lexed(value):
    kinds = {"COMMENT": r"#[^\n]*", "STRING": r'"(?:[^"\\\n]|\\.)*"', "NEWLINE": r"\n", "WHITESPACE": r"[ \t\r\f\x0b]+", "NUMBER": r"[0-9]+(?:\.[0-9]+)?"}
    out, at = [], 0
    while at < len(value):
        for kind, pattern in kinds.items():
            if hit := re.compile(pattern).match(value, at):
                break
        else:
            letter = lambda c: unicodedata.category(c)[0] == "L" or c == "_"
            end = at + 1
            kind = "IDENTIFIER" if letter(value[at]) else "PUNCTUATION"
            while kind == "IDENTIFIER" and end < len(value) and (letter(value[end]) or unicodedata.category(value[end])[0] == "M" or unicodedata.category(value[end]) == "Nd"):
                end += 1
            hit = re.compile(r"(?s).{%d}" % (end - at)).match(value, at)
        out.append((hit[0], kind))
        at = hit.end()
    return out


def test_lexed(frame):
    for r in frame.collect():
        assert [tuple(t) for t in r.tokens] == plain_lexed(r.text or "")


def plain_pieces(found, longest):
    out = []
    for number, (spelling, kind) in enumerate(found):
        if kind == "IDENTIFIER":
            parts = plain_pieces.names[spelling] or [spelling]
        else:
            parts = lexing.lossless_pieces(spelling) if kind in ("COMMENT", "STRING", "WHITESPACE", "ERROR") else [spelling]
        if kind in ("COMMENT", "STRING", "NUMBER", "IDENTIFIER", "WHITESPACE", "ERROR"):
            parts = [p[i : i + longest] for p in parts for i in range(0, len(p), longest)]
        clean = [p.replace("\n", "___NLCHAR___").replace("\r", "___CR___").replace("^", "___CARET___") for p in parts]
        out += [(number, p + "^" * (i < len(clean) - 1), i == len(clean) - 1) for i, p in enumerate(clean)]
    return out


@pytest.mark.parametrize("longest", [15, 3])
def test_pieces_lead_back_to_tokens(spark, frame, longest):
    rows = frame.withColumn("pieces", tokens.pieces(F.col("tokens"), longest)).withColumn("whole", tokens.whole_tokens(F.col("pieces.spelling"))).collect()
    names = sorted({t.spelling for r in rows for t in r.tokens if t.kind == "IDENTIFIER"})
    plain_pieces.names = {r.n: r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.identifier_pieces(F.col("n")).alias("p")).collect()}
    for r in rows:
        assert [tuple(p) for p in r.pieces] == plain_pieces([tuple(t) for t in r.tokens], longest)
        assert r.whole == [t.spelling for t in r.tokens] and "".join(r.whole) == (r.text or "")


def test_open_token_and_wrong_mappings(spark):
    one = spark.range(1).select(tokens.whole_tokens(F.array(F.lit("ab^"), F.lit("c"), F.lit("d^"))).alias("w"), tokens.whole_tokens(F.array().cast("array<string>")).alias("none")).first()
    assert (one.w, one.none) == (["abc", "d"], [])
    with pytest.raises(ValueError, match="sentinel"):
        tokens.pieces(F.array(), mappings={"\n": "___NL___"})
    with pytest.raises(ValueError, match="line feed"):
        tokens.whole_tokens(F.array(), mappings={"^": "___CARET___"})


def test_conditioned(frame):
    row = frame.where("doc = 0").select(tokens.conditioned(F.col("tokens"), ("WHITESPACE", "NEWLINE", "COMMENT"), ("def", "return", "+")).alias("t")).first()
    kinds = {t.spelling: t.kind for t in row.t}
    assert kinds["def"] == kinds["return"] == kinds["+"] == "KEYWORD" and kinds["x_1"] == "IDENTIFIER"
    assert not {"WHITESPACE", "NEWLINE", "COMMENT"} & set(kinds.values())


def exploded(frame):
    whole = F.concat("tokens", F.array(F.struct(F.lit("").alias("spelling"), F.lit("EOS").alias("kind"))))
    return frame.select("doc", F.posexplode(whole).alias("pos", "t")).select("doc", "pos", "t.spelling", "t.kind")


def test_places(frame):
    got = {}
    for r in layout.placed_tokens(exploded(frame), ["doc"]).orderBy("pos").collect():
        got.setdefault(r.doc, []).append(r)
    for r in frame.collect():
        before = ""
        for t in got[r.doc]:
            assert (t.line, t.column) == (before.count("\n") + 1, len(before) - before.rfind("\n") - 1)
            before += t.spelling
            assert (t.end_line, t.end_column) == (before.count("\n") + 1, len(before) - before.rfind("\n") - 1)
        assert before == (r.text or "")


def test_layout_round_trip(frame):
    """Blank lines and indents come back from places alone."""
    placed = layout.placed_tokens(exploded(frame), ["doc"]).where("kind not in ('WHITESPACE', 'NEWLINE')").drop("end_line", "end_column")
    got = {r.doc: r.text for r in layout.laid_out(placed, ["doc"]).collect()}
    for r in frame.collect():
        want = re.sub(r"[\t\r\f\v]", " ", r.text or "")
        want = re.sub(r" +(?=\n)", "", want)
        if not re.search(r"[#\"\r\t]", r.text or ""):  # white space inside a token stays as it is
            assert got[r.doc] == want, (r.text, got[r.doc])
    first = frame.where("doc = 0").first().text
    assert got[0] == first
    assert sys.version_info >= (3, 10) and layout.laid_out(placed.limit(0), ["doc"]).count() == 0


def test_lexers_hold_a_part_of_a_batch(spark, monkeypatch):
    """Tokens of a batch become Arrow values part by part, with the results of the plain functions."""
    import pyarrow as pa

    from loomgraph.functions import lexing

    sizes, plain = [], lexing.pa.array
    monkeypatch.setattr(lexing.pa, "array", lambda rows, kind: sizes.append(len(rows)) or plain(rows, kind))
    monkeypatch.setattr(lexing, "PART", 20)
    texts = plain(["x = 1", None, "", "def f(): pass\n", "a b" * 20, "(", "y"])
    got = lexing._in_parts(texts, lexing.lossless_pieces, pa.list_(pa.string()))
    assert got.to_pylist() == [None if t is None else lexing.lossless_pieces(t) for t in texts.to_pylist()] and sizes == [5, 2]
    monkeypatch.undo()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "i int, t string")
    rows = df.select("t", lexing.lexed_python("t").alias("k"), lexing.lossless_tokens("t").alias("p")).collect()
    for r in rows:
        assert (r.k, r.p) == (None, None) if r.t is None else ([tuple(x) for x in r.k], r.p) == (lexing.python_tokens(r.t), lexing.lossless_pieces(r.t))
