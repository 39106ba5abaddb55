"""Merkle manifests, source divergence and toxicity, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, empty
from pyspark.sql import functions as F

from loomgraph.llm import divergence, merkle, toxicity
from loomgraph.llm.common import whole_groups

FIELDS = ["doc_id", "source", "lang", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, **other):
    values = [other.get(f, row[f]) for f in FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each leaf its steps (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            steps[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[leaf] = i // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain_manifest(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r.source].append(r)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        parts[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in parts[s]])
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, outer in zip(names, above, strict=True):
        for r, inner in zip(parts[s], trees[s][1], strict=True):
            steps, fold = inner + outer, plain_leaf(r, text=r.text and r.text.replace("\n", ""))
            for left, right in steps:
                fold = sha(left + fold + right)
            out.append((str(r.doc_id), plain_leaf(r), trees[s][0], root, sha("".join(a + b for a, b in steps)), fold, fold == root))
    return sorted(out)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, levels):
    docs = documents(spark).withColumn("source", F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 < 5 THEN 'hot' ELSE concat('ü', doc_id) END")).withColumn("root", F.lit("clash")).cache()
    claimed = {"text": F.translate("text", "\n", "")}
    found = merkle.verified(merkle.manifest(docs, "doc_id", "source", FIELDS, claimed, levels)).collect()
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found)
    assert got == plain_manifest(docs.collect())
    assert any(r.verified for r in found) and not all(r.verified for r in found)


def test_manifest_edges(spark):
    assert merkle.verified(merkle.manifest(empty(spark), "doc_id", "source", FIELDS)).count() == 0
    one = documents(spark).limit(1).cache()
    row = merkle.manifest(one, "doc_id", "source", FIELDS).first()
    assert row.steps == [] and row.leaf == row.subroot == row.root == plain_leaf(one.first())
    many = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit("t").alias("text"))
    root = {r.root for r in merkle.manifest(many, "doc_id", "source", FIELDS, levels=2).collect()}
    assert root == {plain_tree([plain_leaf(r) for r in many.orderBy("doc_id").collect()])[0]}


def test_whole_groups():
    rng = random.Random(2)
    keys = [k for k in range(60) for _ in range(rng.choice([1, 2, 3, 40]))]
    batches = pa.table({"k": keys, "v": range(len(keys))}).to_batches(max_chunksize=7)
    tables = list(whole_groups(iter(batches), ["k"], 10))
    assert [x for t in tables for x in t["v"].to_pylist()] == list(range(len(keys)))
    seen = [k for t in tables for k in set(t["k"].to_pylist())]
    assert len(seen) == len(set(seen))


def trie_of(rows, sources=("x", "y")):
    """A trie of (text, source) rows."""
    rows = sorted(rows, key=lambda r: r[1])
    names = sorted({s for _, s in rows} | set(sources))
    return divergence.Trie.of_texts(pa.array([t for t, _ in rows], pa.string()), np.array([names.index(s) for _, s in rows], np.int64), names)


def leaves(trie):
    return [(t, *row) for t, names, n, docs in trie.walk() for row in sorted(zip(names, n, docs, strict=True))]


def counted(rows):
    n, docs = Counter(), Counter()
    for text, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        n.update((t, source) for t in terms)
        docs.update((t, source) for t in set(terms))
    return sorted(((t, s, n[t, s], docs[t, s]) for t, s in n), key=lambda r: (r[0].encode(), r[1]))


def random_rows(seed, count=60):
    rng = random.Random(seed)
    return [(" ".join("".join(rng.choice("abÉé世-") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 12))), rng.choice("xyzw")) for _ in range(count)]


def test_trie_counts_merges_and_cuts():
    rows = random_rows(3)
    whole = trie_of(rows)
    assert leaves(whole) == counted(rows)
    parts = [trie_of(rows[i : i + 7]) for i in range(0, len(rows), 7)] + [trie_of([])]
    assert leaves(divergence.Trie.merged(parts)) == counted(rows)
    pile = divergence.Pile(20)
    for part in parts:
        pile.add(divergence.Trie.unpack(part.pack()))
    assert leaves(pile.merged()) == counted(rows)
    for depth in (1, 2, 3, 5, 40):
        cut = list(whole.subtrees(depth))
        assert [x for _, _, part in cut for x in leaves(divergence.Trie.unpack(part.pack()))] == counted(rows)
        assert len({prefix for prefix, _, _ in cut}) == len(cut)
        for prefix, single, part in cut:
            terms = [t.encode() for t, *_ in leaves(part)]
            assert {t[:depth] for t in terms} == {prefix} and single == (len(prefix) < depth)
    kept = Counter(t for t, _, _, d in counted(rows) for _ in range(d))
    assert [x[0] for x in leaves(whole.at_least(4))] == [x[0] for x in counted(rows) if kept[x[0]] >= 4]


def test_trie_shared_prefixes():
    trie = trie_of([("a ab abc abd b ü", "x")])
    assert trie.shared(5).tolist() == [0, 1, 2, 2, 0, 0] and trie.shared(1).tolist() == [0, 1, 1, 1, 0, 0]
    odd = trie_of([("abc", 's\0;"'), ("abc", "")])
    assert leaves(divergence.Trie.unpack(odd.pack())) == leaves(odd)


def plain_divergence(rows, min_docs, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i) for part, found in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(1, 5), (4, 50), (1000, 50)])
def test_divergence(spark, min_docs, top):
    docs = documents(spark).withColumn("source", F.expr("element_at(array('a', null, 'ü', 'hot', 'hot'), cast(pmod(coalesce(doc_id, 0), 5) + 1 as int))")).withColumn("term", F.lit("clash"))
    docs = docs.repartition(5).cache()
    got = divergence.source_divergence(docs, min_docs=min_docs, top=top).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == plain_divergence(docs.collect(), min_docs, top)
    assert divergence.source_divergence(empty(spark)).count() == 0


def test_divergence_in_pieces(spark, monkeypatch):
    """Tries that are handed on often, prefixes that are cut deeper, and walks that compare few terms at once, change nothing."""
    docs = documents(spark).repartition(3).cache()
    whole = divergence.count_terms(docs.coalesce(1), "text", "lang", "source")
    often = divergence.count_terms(docs, "text", "lang", "source", depth=1, most=1)
    rows = lambda df, **k: sorted((r.lang, r.term, tuple(sorted(zip(r.sources, r.counts, strict=True)))) for r in divergence.merged_terms(df, 2, **k).collect())
    want = rows(whole.where("prefix is not null"))
    deeper = divergence.cut_deeper(often.where("prefix is not null"), 2)
    assert rows(deeper, most=3) == want and len(want) > 10
    assert {r.depth for r in deeper.select("depth").distinct().collect()} & {2, 4}
    crowded = deeper.where("depth is not null").groupBy("lang", "prefix").agg(F.sum("entries").alias("n")).where("n > 2")
    assert crowded.count() == 0
    found = []
    for block in (1, 1000):
        monkeypatch.setattr(divergence, "BLOCK_COUNTERS", block)
        walk = divergence.Walk("en", ["a", "b"], [10, 20], 3, 2)
        for term, counts in (("x", [8, 1]), ("y", [1, 18]), ("z", [1, 1])):
            walk.add(term, ["a", "b"], counts)
        found.append(walk.rows())
    assert found[0] == found[1]
    assert divergence._share(np.array([10**10]), 10**10 + 7)[0] == 1 + 10**9 * (10**10 + 5) // (10**10 + 7)


def plain_features(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {(shape, tuple(w[i + d] for d in (0, *shape))) for shape in toxicity.SHAPES for i in range(len(w) - max(shape, default=0))}


def test_toxic_features():
    texts = ["One two three four", "", None, "one two", "a b c d e a b c d e", "x_y", "two three four five"]
    keys, owner = toxicity.features(texts)
    want = [plain_features(t) for t in texts]
    for i, found in enumerate(want):
        assert len(set(keys[owner == i].tolist())) == len(found)
    shared = set(keys[owner == 0].tolist()) & set(keys[owner == 6].tolist())
    assert len(shared) == len(want[0] & want[6])


def test_ftrl_against_plain():
    """Coordinate by coordinate, as the update is defined."""
    rng = random.Random(4)
    rows = [np.array([0, *sorted(rng.sample(range(1, 9), 3))]) for _ in range(60)]
    labels = np.array([int(2 in r or 5 in r) for r in rows])
    got = toxicity.ftrl(rows, labels, 9, 0.5, 1.0, 0.3, 0.1, 3)
    z, n, l1 = [0.0] * 9, [0.0] * 9, [0.0] + [0.3] * 8

    def weight(i):
        return 0.0 if abs(z[i]) <= l1[i] else -(z[i] - (l1[i] if z[i] > 0 else -l1[i])) / ((1 + n[i] ** 0.5) / 0.5 + 0.1)

    for _ in range(3):
        for at, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(9)]) and got[2] > 0 and got[5] > 0


def test_toxicity(spark):
    rng = random.Random(5)
    plain = ["river", "stone", "cloud", "grass", "walk", "table", "green", "north"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic := i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "Rotten"]))
        rows.append((i, " ".join(words), int(toxic), zlib.crc32(str(i).encode()) % 3 == 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, held_out boolean").withColumn("score", F.lit("clash"))
    model = toxicity.train(df.where("not held_out"), "text", "toxic", by=("doc_id",))
    got = toxicity.score_toxicity(df, model).where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)
    assert len(model.keys) < 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    again = toxicity.train(df.where("not held_out").repartition(7), "text", "toxic", by=("doc_id",))
    assert np.array_equal(again.keys, model.keys) and np.array_equal(again.values, model.values)
    long = "river " * 200_000 + "vile " + "stone " * 200_000
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "!!"), (4, long), (4, long)], "doc_id long, text string")
    score = [r.score for r in toxicity.score_toxicity(odd, model).collect()]
    assert score[0] == score[1] == score[2] < 0.7 <= score[3] == score[4]
    untaught = toxicity.train(df.limit(0), "text", "toxic")
    assert {r.score for r in toxicity.score_toxicity(odd, untaught).collect()} == {0.5}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
