"""Strings, tokens, dictionaries, sources and streams."""

import random
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import lexing, text
from loomgraph.operators import sampling, vocabulary
from loomgraph.sources import programs as sources
from loomgraph.streaming import events


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).collect()[0].y


def test_pieces_and_marks(spark):
    assert one(spark, "a" * 32, text.long_token_pieces) == ["a" * 15, "a" * 15, "a" * 2]
    assert one(spark, "", text.long_token_pieces) == [""]
    tokens = ["ab\nc^d" * 4, "x", "y" * 15]
    marked = [p for t in tokens for p in one(spark, t, lambda c: text.marked_pieces(text.long_token_pieces(c)))]
    assert one(spark, marked, text.reconstituted, "array<string>") == tokens


def test_identifier_pieces(spark):
    assert one(spark, "HTTPServerErrorX2y", text.identifier_pieces) == ["HTTP", "Server", "Error", "X2y"]
    for name in ("snake_case_name", "__init__", "camelCaseÜber9", "A", "_x_1"):
        assert "".join(one(spark, name, text.identifier_pieces)) == name


def test_bare_and_mappings(spark):
    assert one(spark, "a\u00a0b \u2003c\n\x1cd\te", text.bare) == "abcde"
    with pytest.raises(ValueError):
        text.check_mappings({"a": "b", "b": "a"})


def test_labels(spark):
    assert one(spark, "py_strs(a,b(,c,12,3)", text.label_values) == ["a,b(,c", "12", "3"]
    assert one(spark, "py_exprs(1, 18,3,0)", text.label_values) == ["1", "18", "3", "0"]
    df = spark.createDataFrame([("py_exprs", ["1", "18", "3", "0"]), ("variable", ["7", "1", "foo"]), ("py_strs", ["x" * 20, "1", "0"]), ("py_stmts", ["1", "99", "0", "0"])], "rel string, vals array<string>")
    got = [(r.t, r.v) for r in df.select(text.node_type(F.col("rel"), F.col("vals")).alias("t"), text.node_value(F.col("rel"), F.col("vals")).alias("v")).collect()]
    assert got == [("expr_py_Name", ""), ("v_7", "foo"), ("py_strs", "x" * 15), (None, "")]


def brute_truncate(a, b, limit):
    while a + b > limit:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_truncated_pairs(spark):
    cases = [(a, b, limit) for a in range(0, 12) for b in range(0, 12) for limit in (3, 8, 11)]
    df = spark.createDataFrame(cases, "a int, b int, m int")
    x, y = text.truncated_pair(F.col("a"), F.col("b"), F.col("m"))
    for row in df.select("a", "b", "m", x.alias("x"), y.alias("y")).collect():
        assert (row.x, row.y) == brute_truncate(row.a, row.b, row.m)


@given(st.text())
def test_lossless(value):
    assert "".join(lexing.lossless_pieces(value)) == value


def test_lexer():
    kinds = [(s, k) for s, k, _, _ in lexing.python_tokens("if x:\n    y = 'a'  # c\n")]
    assert kinds[:3] == [("if", "KEYWORD"), ("x", "IDENTIFIER"), (":", "PUNCTUATION")]
    assert ("'a'", "STRING") in kinds and kinds[-1][1] == "EOS"
    assert lexing.python_tokens("'''open")[0][1] == "ERROR"


def plain_lossless(code):
    """The rule character by character: a class change cuts, and so on."""
    kind = lambda c: "U" if c.isupper() else "L" if c.islower() else "N" if c.isdigit() else "S"
    out = []
    for i, c in enumerate(code):
        last = code[i - 1] if i else ""
        if not i:
            out.append(c)
        elif kind(c) == kind(last) == "S":
            blank = c in " \t" and c == last
            joined = (blank and len(out[-1]) < 20) or not (c.isspace() or last.isspace())
            out[-1:] = [out[-1] + c] if joined else [out[-1], c]
        elif kind(c) == kind(last):
            out[-1] += c
        elif kind(last) == "U" and kind(c) == "L":
            out[-1:] = [out[-1][:-1], last + c] if len(out[-1]) > 1 else [out[-1] + c]
        else:
            out.append(c)
    return out


def test_lossless_pieces():
    assert lexing.lossless_pieces("foo==barX[((1caf\u00e9 x\t\t\n\n") == ["foo", "==", "bar", "X", "[((", "1", "caf\u00e9", " ", "x", "\t\t", "\n", "\n"]
    rng = random.Random(4)
    for _ in range(3000):
        code = "".join(rng.choice(["aB", "C", "d", "\u00c9", "\u01c5", "\u00df", "1", "=", "(", " ", " " * 23, "\t", "\n", "_", "\u0661"]) for _ in range(rng.randrange(14)))
        assert lexing.lossless_pieces(code) == plain_lossless(code)


def test_greedy_bpe(spark):
    encode = lexing.greedy_bpe(["<PAD>", "ab", "abc#", "c#", "a", "#"])
    df = spark.createDataFrame([("abc",), ("abab",), ("z",), (None,)], "w string")
    assert [r.i for r in df.select(encode("w").alias("i")).collect()] == [[2], [1, 4, 0], [0], None]


def test_vocabulary_and_padding(spark):
    tokens = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c")], "k int, pos int, token string")
    vocab = vocabulary.vocabulary(tokens, ["k", "pos"])
    assert {r.token: r.id for r in vocab.collect()} == {"__pad__": 0, "__unknown__": 1, "b": 2, "a": 3, "c": 4}
    more = tokens.unionByName(spark.createDataFrame([(3, 0, "?")], tokens.schema))
    padded = vocabulary.padded_ids(vocabulary.encoded(more, vocab), "k", 2)
    assert {r.k: r.ids for r in padded.collect()} == {1: [2, 3], 2: [4, 0], 3: [1, 0]}


def test_texts_encoded_in_groups(spark, monkeypatch):
    """Same rows as token by token, for odd texts and any number of groups; a group asks for a word once."""
    texts = ["", " ", "a", "a b  a ", None, "ü 中 a\u00a0b\tc", " ".join(f"w{i % 7}" for i in range(64)), "a " * 500, "new words b", *[f"t{i} a b t{i}" for i in range(20)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b")], "k long, t string")
    tokens = vocabulary.token_positions(docs, "k", F.split("t", " "))
    vocab = vocabulary.vocabulary(tokens.where("k <> 8"), ["k", "pos"])
    want = {(r.k, r.block): " ".join(map(str, r.ids)) for r in vocabulary.padded_blocks(vocabulary.encoded(tokens, vocab), "k", 32).collect()}
    asked, encoded = [], vocabulary.encoded
    monkeypatch.setattr(vocabulary, "encoded", lambda tokens, vocab: (asked.append(tokens.count()), encoded(tokens, vocab))[1])
    for group in (10**6, 300, 1):
        monkeypatch.setattr(vocabulary, "GROUP", group)
        got = vocabulary.encoded_blocks(docs, "k", "t", vocab, 32).collect()
        assert {(r.k, r.block): r.ids for r in got} == want and len(got) == len(want)
    distinct = tokens.select("token").distinct().count()
    assert asked[0] == distinct < asked[2] < tokens.count() / 4
    assert vocabulary.encoded_blocks(docs.limit(0), "k", "t", vocab, 32).count() == 0


def test_first_places_as_numbers(spark):
    """One column of places gives the ids that several do."""
    tokens = spark.createDataFrame([(2, 0, "b"), (1, 1, "a"), (1, 0, "c"), (2, 1, "a"), (-5, 3, "d")], "k long, pos int, token string")
    one = tokens.select("token", (F.col("k") * 2**31 + F.col("pos")).alias("place"))
    assert sorted(map(tuple, vocabulary.vocabulary(one, ["place"]).collect())) == sorted(map(tuple, vocabulary.vocabulary(tokens, ["k", "pos"]).collect()))


def test_first_difference(spark):
    df = spark.createDataFrame([(1, "a\nfoo(connection)", "a\nfoo(self)"), (2, "same", "same"), (3, "x", "x\ny")], "k int, l string, r string")
    got = {r.k: (r.line, r.column, r.left_word, r.right_word) for r in vocabulary.first_difference(df, "l", "r").collect()}
    assert got[1] == (2, 5, "connection", "self") and got[2][:2] == (None, None) and got[3][:2] == (2, 1)


def test_greedy_batches(spark):
    df = spark.range(40).selectExpr("id", "(id * 37) % 50 + 1 as n")
    rows = sampling.length_bucketed_batches(df, "id", "n", 100, parts=2).collect()
    assert len(rows) == 40
    groups = {}
    for r in rows:
        groups.setdefault((r.bucket, r.batch), []).append(r.n)
    assert all(max(g) * len(g) <= 100 for g in groups.values())


def test_dot_and_points(spark, tmp_path):
    nodes = spark.createDataFrame([("g", 1, 'v("a\\b")'), ("g", 2, "w(2)")], "graph_id string, id long, label string")
    edges = spark.createDataFrame([("g", 1, 2, "(v.x,w.y)")], "graph_id string, src long, dst long, label string")
    n, e = sources.parse_dot(sources.dot_lines(nodes, edges), "line", ["graph_id"])
    assert sorted(n.collect()) == sorted(nodes.collect()) and e.collect() == edges.collect()
    plain, _ = sources.parse_dot(spark.createDataFrame([("1 [label=foo];",)], "value string"))
    assert plain.collect()[0].label == "foo"
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"anchor": "a(1)", "trajectories": [], "hints": [], "label": "x", "source": "s"}]))
    assert sources.read_points(spark, str(path)).collect()[0].anchors == ["a(1)"]


def test_relation_scan(spark, tmp_path):
    folder = tmp_path / "prog"
    folder.mkdir()
    (folder / "py_strs.bqrs.csv").write_text('"col0","ID of parent","idx"\n"a,""b""",5,0\n')
    (folder / "unknown.csv").write_text('"x"\n1\n')
    found = sources.read_program(spark, str(folder))
    assert list(found) == ["py_strs"]
    row = found["py_strs"].collect()[0]
    assert (row.id, row.parent, row.idx, row.graph_id) == ('a,"b"', 5, 0, "prog")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id * 1800) as ts", "id % 3 as user_id", "concat('t', id % 2) as event_type", "cast(id as double) as value")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    live = events.windowed(events.stream(spark, str(tmp_path / "in"), rows.schema), "1 hour")
    job = live.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    job.processAllAvailable()
    job.stop()
    want = events.windowed(rows, "1 hour")
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, want.collect()))
