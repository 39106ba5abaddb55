"""Word pieces: ids by longest prefixes, and tokens and texts from ids across sentences."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import tokens
from loomgraph.operators import wordpieces


def texts():
    rng = random.Random(5)
    parts = ["parseHTML", "snake_case_", "__", " ", "  ", "\n", "été", "世界", "\\", "\\u", "\\12;", ";", "12345", "^", "😀", "#c d", "x" * 33, "the", "theirs"]
    return ["", None, "a", "_", "^", "the theirs the"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(80)]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc int, text string").withColumn("pieces", tokens.pieces(tokens.lexed(F.col("text"))).getField("spelling")).cache()
    vocabulary = wordpieces.build_vocabulary(df.select(F.explode("pieces").alias("p")), "p", 40, characters=24)
    return wordpieces.with_ids(df, "pieces", vocabulary).cache(), vocabulary


def test_longest_prefixes(made):
    df, vocabulary = made
    assert len(set(vocabulary)) == len(vocabulary) and set(wordpieces.OWN) < set(vocabulary)
    letters = frozenset(t for t in vocabulary if len(t) == 1)
    for r in df.collect():
        want = []
        for piece in r.pieces:
            rest = wordpieces.escape_piece(piece, letters)
            while rest:
                best = max((t for t in vocabulary if rest.startswith(t)), key=len)
                want.append(vocabulary.index(best))
                rest = rest[len(best) :]
        assert r.ids == want
    assert any(f"\\{ord(c)};" in wordpieces.escape_piece("世界😀", letters) for c in "世界😀")


@pytest.mark.parametrize("length", [1, 3, 7, 1000])
def test_texts_come_back(made, length):
    df, vocabulary = made
    sentences = wordpieces.in_sentences(df, ["doc"], "ids", length)
    assert sentences.agg(F.max(F.size("ids"))).first()[0] <= length
    got = {r.doc: r.text for r in wordpieces.texts_of_sentences(sentences, ["doc"], vocabulary).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts())}


def test_tokens_and_their_ids(made):
    df, vocabulary = made
    found = {}
    for r in wordpieces.tokens_of_sentences(wordpieces.in_sentences(df, ["doc"], "ids", 4), ["doc"], vocabulary).orderBy("doc", "number").collect():
        found.setdefault(r.doc, []).append(r)
    for row in df.withColumn("t", tokens.lexed(F.col("text")).getField("spelling")).collect():
        got = found.get(row.doc, [])
        assert [r.token for r in got] == row.t and all(r.complete for r in got)
        assert [r["first"] for r in got] == [sum(x.ids for x in got[:i]) for i in range(len(got))] and sum(r.ids for r in got) == len(row.ids)


def test_next_whole_token_of_a_cut_sequence(spark, made):
    """For every prefix of the ids: the tokens whose last id it holds are whole, and at most one more is open."""
    df, vocabulary = made
    row = df.where("text like '%parseHTML%'").withColumn("t", tokens.lexed(F.col("text")).getField("spelling")).first()
    cut = spark.createDataFrame([(n, 0, row.ids[:n]) for n in range(1, len(row.ids) + 1)], "prefix int, sentence int, ids array<int>")
    found = {}
    for r in wordpieces.tokens_of_sentences(cut, ["prefix"], vocabulary).orderBy("prefix", "number").collect():
        found.setdefault(r.prefix, []).append(r)
    ends = [r["first"] + r.ids for r in found[len(row.ids)]]
    for n, got in found.items():
        whole = sum(e <= n for e in ends)
        assert [r.token for r in got if r.complete] == row.t[:whole] and sum(not r.complete for r in got) == (n not in ends)
        if whole:
            assert (got[0].token, got[0].ids) == (row.t[0], ends[0])


def test_pieces_are_made_once_for_a_vocabulary(spark):
    """Characters and common pieces come from one count, so what makes the pieces runs once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def piece(i):
        made.add(1)
        return f"p{i % 7}"

    found = wordpieces.build_vocabulary(spark.range(50).select(piece.asNondeterministic()("id").alias("p")), "p", 20)
    assert made.value == 50 and "p3_" in found
