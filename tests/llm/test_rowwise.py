"""Operators that work row by row, against plain versions of their rules."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from helpers import documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe, decontam, langid, pii, quality, secrets, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def test_token_counts(spark, docs):
    tok = Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "é", "中", "😀", "12", " ", "\x1c", "!!"]
    odd = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(30)),) for _ in range(300)], "text string")
    for df in (docs, odd):
        for row in token_counts.token_counts(df, BYTE, limit=50).collect():
            want = len(tok.encode(row.text or "", add_special_tokens=False))
            assert (row.n_tokens, row.n_bytes, row.over_limit) == (want, len((row.text or "").encode()), want > 50)
    assert token_counts.token_counts(empty(spark), BYTE).count() == 0


def test_bpe(spark, docs):
    tok = Tokenizer.from_file(WORD)
    rng = random.Random(4)
    parts = ["a", "The", "ing", " ", "\n", "<|endoftext|>", "<|STARTOFTEXT|>", "'LL", "é", "Σ", "İ", "½", "中", "😀", "\x1f", "\u0085", "-", "9"]
    odd = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(25)),) for _ in range(300)], "text string")
    for df in (docs, odd):
        for row in bpe.bpe_encode_decode(df, WORD).collect():
            ids = tok.encode(row.text or "", add_special_tokens=False).ids
            assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
            assert row.decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))
    forgetful = bpe.bpe_encode_decode(docs, WORD, group_bytes=1000, cache_words=5, keep=False)
    assert sorted(map(str, forgetful.collect())) == sorted(map(str, bpe.bpe_encode_decode(docs, WORD).collect()))
    real = bpe.bpe_encode_decode(docs, WORD, digests=False).where("text = 'one two three'").collect()[0]
    assert real.ids == tok.encode("one two three", add_special_tokens=False).ids
    assert bpe.bpe_encode_decode(empty(spark), WORD).count() == 0


def test_cache_generations():
    cache = bpe.Generations(2)
    for key in "abcd":
        for k in cache.missing({key, "a"}):
            cache.young[k] = k
    assert cache.missing({"a"}) == [] and len(cache.young) <= 4


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs):
    more = spark.createDataFrame([("a b c d e f g h " * 3 + "# % x",), ("l one\nl one\n\nl one\n \n \n",), ("a b c d e f g h i a b c d e f g h",)], "text string")
    for df in (docs, more):
        got = quality.apply_policy(quality.rule_ledger(df.withColumn("copy", F.col("text")), "copy"), "v1").collect()
        for row in got:
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == plain_quality(row.text)
            n = row.n_words
            assert bool(row.failed_bits & quality.mask("base")) == (n < 20 or 100 * row.n_repeat_words > 30 * n)
            assert row.kept == (row.failed_bits & quality.mask("v1") == 0)
    assert quality.rule_ledger(empty(spark)).count() == 0
    bits = [r.failed_bits & quality.mask("v1") for r in quality.rule_ledger(docs).collect()]
    for row in quality.ablations(quality.rule_ledger(docs)).collect():
        bit = 1 << list(quality.RULES).index(row.rule)
        assert (row.n_failed, row.n_only, row.n_rejected) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(b != 0 for b in bits))


def plain_hits(text, items):
    fold = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, found = fold(text), set(), set()
    for item, body in items:
        b = fold(body)
        n = min(13, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_decontamination(spark, docs, block):
    rng = random.Random(5)
    texts = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 40]
    items = [(i, " ".join(rng.choice(texts).split()[at : at + rng.choice([1, 3, 13, 30])])) for i, at in enumerate([0, 5, 10, 20, 2, 7])] + [(50, None), (51, ""), (52, "--"), (1, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    merged = {}
    for i, t in items:
        merged.setdefault(i, []).append(t)
    for row in decontam.decontaminate(docs, bench, block_bytes=block).collect():
        want = plain_hits(row.text, items)
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) == want
    clean = decontam.decontaminate(docs, bench, block_bytes=block, clean_only=True)
    assert clean.columns == docs.columns and clean.count() == sum(not plain_hits(r.text, items)[4] for r in docs.collect())
    assert decontam.decontaminate(empty(spark), bench, block_bytes=block).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_language(spark):
    rng = random.Random(6)
    vocab = {"en": ["the", "and", "house", "walking"], "de": ["der", "und", "haus", "gehen", "größe"], "fr": ["le", "et", "maison", "été"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(20)), lang) for i, lang in enumerate(sorted(vocab) * 40)]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (903, "ÜÖ", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(df.where("doc_id % 4 <> 0"), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.identify_language(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred in vocab and all(0 <= r.score <= 1 for r in got.values())
    none = langid.train(df.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.identify_language(df, none).collect()} == {"und"}
    assert langid.identify_language(df.limit(0), model).count() == 0


PII_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= sum(c.isdigit() for c in m) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
]


def test_pii_base():
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", "+", "4111 1111 1111 1111", "4111-1111-11111111", "1.2.3.4", "256.1.1.1", "+49 (30) 1234567", "+1", " ", "é", "0", "12", "999", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(PII_KINDS) for m in re.finditer(p, text) if good(m[0]))
        assert pii.base_spans(text) == want, text
    assert pii.base_spans("9" * 200_000 + "a" * 200_000 + "@") == []


def test_pii_network(spark, docs):
    tagger = pii.train(docs, "doc_id", "text")
    texts = ["Please call (578) 555-6437 or mail bob@localhost today.", "on 2024-01-05 we paid 1,234.56", "x " * 400 + "me.you@mail.example.com", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df, tagger).collect()}
    assert "phone:" in got[0].spans and got[0].n_phone == 0
    assert got[2].spans == "email:800:823" and got[2].n_email == 1
    assert got[3].spans == got[4].spans == "" and got[3].base_sha256 == sha("")
    red = {r.doc_id: r for r in pii.redact(df.withColumn("n", F.lit(5).cast("long")), tagger, length="n").collect()}
    assert red[2].text == "x " * 400 + "<EMAIL>" and red[2].n == 807 and red[3].text is None and red[3].n == 5
    assert pii.find_personal_data(empty(spark), pii.train(empty(spark), "doc_id", "text")).count() == 0


class AtSigns:
    """Labels words that hold an ``@`` or a run of four other digits, as far as a window shows them."""

    def decode(self, codes):
        import numpy as np

        out = np.zeros(codes.shape, np.int8)
        for row, code in enumerate(codes):
            places = np.flatnonzero((code != 96) & (code != 0))
            for word in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                kind = 0 if (code[word] == 33).any() else 3 if (code[word] == 98).any() else None
                if kind is not None:
                    out[row, word] = 2 + 2 * kind
                    out[row, word[0]] = 1 + 2 * kind
        return out


def test_pii_tile_edges():
    """A span that crosses into a tile without a digit or ``@`` is whole, at every offset; so is one over more tiles."""
    for offset in range(2 * pii.CORE):
        for word in ("firstname.lastname@in", "ab@intranethostname"):
            text = "x" * offset + " " + word + " " + "y" * 80
            at = offset + 1
            assert pii.added_spans(AtSigns(), [text], [[]]) == [[(at, 0, at + len(word))]], (offset, word)
    digits = "".join(chr(0x660 + i % 10) for i in range(10))
    assert pii.added_spans(AtSigns(), ["call " + digits, None, ""], [[], [], []]) == [[(5, 3, 15)], [], []]


def test_pii_same_as_every_tile():
    import numpy as np

    rng = random.Random(1)
    plain = [" ".join(rng.choice(["alpha", "Beta", "gamma", "of", "the", "end."]) for _ in range(60)) for _ in range(30)]
    tagger = pii.Tagger.fresh().fit(*pii.training_windows(plain))
    texts = ["a few words " * 5 + "z" * offset + " mail firstname.lastname@intranet now " + "and more words " * 12 for offset in range(pii.CORE)]
    got = pii.added_spans(tagger, texts, [[] for _ in texts])
    for text, spans in zip(texts, got, strict=True):
        tiles = -(-len(text) // pii.CORE)
        padded = np.zeros(tiles * pii.CORE + 2 * pii.MARGIN, np.uint8)
        padded[pii.MARGIN : pii.MARGIN + len(text)] = pii.encode(text)
        rows = tagger.decode(np.stack([padded[t * pii.CORE : t * pii.CORE + pii.WINDOW] for t in range(tiles)]))
        runs = pii.label_runs(rows[:, pii.MARGIN : pii.MARGIN + pii.CORE].ravel())
        assert spans == [(s, k, e) for s, k, e in runs if pii.fits(k, text[s:e]) and not text[s - 1 : s].isalnum() and not text[e : e + 1].isalnum()]
    assert sum(any(k == 0 for _, k, _ in spans) for spans in got) > len(texts) // 2


def test_pii_gradients():
    import numpy as np

    codes, gold = pii.training_windows(["some words in a text that is long enough to cut"], 8)
    tagger = pii.Tagger({k: v.astype(float) for k, v in pii.Tagger.fresh().p.items()})
    _, grads = tagger.gradients(codes[:3], gold[:3])
    for name, place in (("hf", (2, 3)), ("out", (4, 1)), ("trans", (0, 0)), ("xb", (int(codes[0, 40]), 5))):
        step, values = 1e-4, []
        for sign in (1, -1):
            tagger.p[name][place] += sign * step
            values.append(tagger.gradients(codes[:3], gold[:3])[0])
            tagger.p[name][place] -= sign * step
        assert np.isclose(grads[name][place], (values[0] - values[1]) / (2 * step), rtol=1e-3, atol=1e-5)


SECRET_KINDS = [
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def test_secrets(spark, docs):
    rng = random.Random(8)
    parts = ["token", "secret: ", "API_KEY", "=", ": ", '"', "'", "abc", "abcdefg", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 3, "0f", " ", "é😀", ".", "passwd", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(300)]
    texts += [None, "", "key Zx9Qw8Er7Ty6Ui5Op4As3 end", "the_quick_brown_fox_2024 and some_plain_identifier_12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base_spans", F.lit("clash"))
    ratios = secrets.train(secrets.labelled_samples(docs, "doc_id", "text"))
    for row in secrets.secret_spans(df, ratios).collect():
        text = row.text or ""
        want = sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(SECRET_KINDS) for m in re.finditer(p, text) if good(m))
        assert [tuple(s) for s in row.base_spans] == want
        for s in row.added_spans:
            assert not any(b.start < s.stop and s.start < b.stop for b in row.base_spans)
        if row.doc_id == 302:
            assert [text[s.start : s.stop] for s in row.added_spans] == ["Zx9Qw8Er7Ty6Ui5Op4As3"]
        if row.doc_id == 303:
            assert not row.added_spans
    assert secrets.secret_spans(empty(spark), ratios).count() == 0
    assert len(secrets.train(secrets.labelled_samples(empty(spark), "doc_id", "text"))) == len(secrets.LETTERS) ** 2
