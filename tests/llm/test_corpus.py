"""Operators that compare documents, against brute force, and the pipeline."""

import collections
import hashlib
import os
import random
import re

import pytest
from helpers import documents, empty
from pyspark.sql import functions as F

from loomgraph.llm import jaccard_join, suffix_dedup, warc

BIG = 1 << 62


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            both = len(sets[a] & sets[b])
            if same_id or (sets[a] and 100 * both >= 80 * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    least = collections.defaultdict(lambda: BIG)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], BIG if doc_id is None else doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = (least[find(i)] if least[find(i)] < BIG else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c))
    return sorted(map(str, out))


def test_similar_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.similar_documents(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain_components(rows)
    assert jaccard_join.similar_documents(empty(spark)).count() == 0


def test_similar_chains(spark):
    """Chains of near copies, whose ends aren't similar, and texts around the threshold."""
    rng = random.Random(2)
    rows, now = [], [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(60):
        rows.append((i * 3, " ".join(now)))
        now = list(now)
        at = rng.randrange(len(now))
        now[at : at + rng.choice([0, 1, 2])] = [f"w{rng.randrange(10**6)}"]
    rng.shuffle(rows)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain_components(rows)


def test_similar_without_ids(spark):
    """Near copies whose rows all have a null doc_id, of each other and of a named document."""
    rng = random.Random(8)
    base, other = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    changed = lambda words, at: " ".join([*words[:at], "changed", *words[at + 1 :]])
    rows = [(5, " ".join(base)), (None, changed(base, 30)), (None, changed(base, 30)), (4, changed(base, 50)), (None, " ".join(other)), (None, changed(other, 20)), (9, "some words of no other text")]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain_components(rows)


def test_count_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.poisson(5, (3000, jaccard_join.GROUPS)).astype(np.uint16)
    points[1500:] = np.maximum(points[:1500].astype(int) + rng.integers(-1, 2, (1500, jaccard_join.GROUPS)), 0)
    owner, sizes = rng.integers(0, 40, 3000), points.sum(1, dtype=np.int64)
    tree = jaccard_join.CountTree(points, sizes, owner)
    for i in range(0, 3000, 97):
        fits = jaccard_join.may_link(np.minimum(points, points[i]).sum(1, dtype=np.int64), sizes[i], sizes) & (owner != owner[i])
        assert sorted(tree.search(points[i], sizes[i], owner[i])) == list(np.flatnonzero(fits))


def test_hot_keys_in_blocks(spark):
    """Blocks of a hot key find the pairs that one block finds."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        mine = list(base)
        for _ in range(rng.randrange(6)):
            mine[rng.randrange(40)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(mine)))
    each = jaccard_join.describe(spark.createDataFrame(rows, "doc_id long, text string"))
    points = each.select("class", "n", "point").dropDuplicates(["class"])
    keys = points.select(F.lit(1).cast("long").alias("key"), "class", "n")
    none = spark.createDataFrame([], "class long, component long")
    whole = {(r.a, r.b) for r in jaccard_join.remaining_pairs(keys, none, points).collect()}
    assert whole == {(r.a, r.b) for r in jaccard_join.remaining_pairs(keys, none, points, block=20).collect()} and whole
    assert whole == {(r.a, r.b) for r in jaccard_join.remaining_pairs(keys, none, points, few=200).collect()}


def test_similar_with_shared_ids(spark):
    """Rows of one doc_id are linked with each other, whatever their texts."""
    rng = random.Random(18)
    one, two = ([f"w{rng.randrange(10**6)}" for _ in range(50)] for _ in range(2))
    rows = [(3, " ".join(one)), (7, " ".join([*one, "more"])), (7, " ".join(two)), (9, " ".join(two[1:])), (8, "nothing like the others at all")]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (7, 3), (7, 3), (8, 8), (9, 3)]


def test_large_group_of_near_copies(spark, monkeypatch):
    """600 near copies of one text, a third too far from it and from each other to be linked: right classes, and no more pairs compared than the bound leaves."""
    rng = random.Random(28)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        mine = list(base)
        for at in rng.sample(range(200), 12 if i % 3 == 0 else 2):
            mine[at] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(mine)))
    compared = []
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got.collect()) == plain_components(rows)
    assert sum(compared) < 600 * 599 / 2 / 4


def test_one_of_each_group_stays(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, one), (1, one + " z"), (1, one + " y"), (None, one), (None, two), (None, two + " q"), (4, three), (4, "z " + three), (5, None), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    for parts in (1, 7):
        kept = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), "").collect()
        assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == sorted([(1, one + " y"), (0, two), (4, three), (5, ""), (6, ""), (0, "")])


def plain_removal(rows, size=50):
    first = {}
    for doc_id, b in rows:
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            first[w] = min(first.get(w, BIG + 1), BIG if doc_id is None else doc_id)
    out = []
    for doc_id, b in rows:
        mask = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < (BIG if doc_id is None else doc_id):
                mask[s : s + size] = b"\1" * size
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        out.append((doc_id, len(b), sum(mask), sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_remove_repeats(spark, hot):
    docs = documents(spark)
    extra = [(1, "ab" * 300), (2, "x" + "ab" * 100 + "y"), (3, "é" * 30 + "q"), (4, "zé" + "é" * 30), (0, "z" * 49), (5, "z" * 50), (6, "z" * 51), (None, "z" * 60)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in more.collect()]
    got = suffix_dedup.remove_repeats(more, kept=True, hot=hot).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == plain_removal(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_levels():
    import numpy as np

    levels, seen, rng = suffix_dedup.Levels(), set(), np.random.default_rng(3)
    for batch in range(37):
        one = np.unique(rng.integers(0, 3000, 50).astype(np.uint64))
        got = levels.add(one, one.astype(np.uint32), batch)
        assert list(got) == [int(x) in seen for x in one]
        seen |= set(map(int, one))
    assert len(levels.levels) <= 6


def test_warc(spark, tmp_path):
    big, other = "<html>é\r\n\r\nWARC/1.1\r\n" + "b" * 2000, "<p>" + "c" * 999
    rows = [(1, "http://a\nb", big), (5, "http://b", big), (3, None, big), (2, "u", other), (4, "v", other), (6, "w", None), (7, "x", ""), (8, "y", "d" * 500), (9, "z", "d" * 500), (None, "n", big), (5, "http://b", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    html = collections.defaultdict(set)
    for i, _, h in rows:
        html[i].add((h or "").encode())
    for r in got:
        body = next(iter(html[r.page_id]))
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        original = {big.encode(): 5, other.encode(): 4}.get(body)
        revisit = original is not None and r.page_id not in (None, original)
        assert (r.record_type, r.refers_to) == (("revisit", original) if revisit else ("response", None))
        assert (r.payload is None) if revisit else (bytes(r.payload) == body)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from test_rowwise import plain_hits, plain_quality

    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    item = text(20)
    clean = [text(60) for _ in range(12)]
    near = clean[0].split()
    near[30] = "different"
    texts = [*clean, clean[0], " ".join(near), text(40) + " " + item, "short", text(10) + " mail me.you@mail.example.com " + text(30), "%%% " * 50, None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [*range(12), 16]
    assert all(out[i].text == clean[i] for i in range(12))
    assert "<EMAIL>" in out[16].text and "@" not in out[16].text and out[16].n_chars == len(out[16].text)
    assert plain_quality("short")[0] < 20 and plain_hits(texts[14], [(1, item)])[4]
    assert all(name in out[0].__fields__ for name in ("n_tokens", "ids_sha256", "decoded_sha256"))


def test_stages_with_clashing_columns(spark):
    import corpus_pipeline

    docs = documents(spark).withColumn("n_letters", F.lit("mine"))
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    assert {(r.n_words, r.kept, r.n_letters) for r in kept.collect()} == {("w", "k", "mine")}
    assert corpus_pipeline.quality_rules(spark, empty(spark), "").count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert os.path.exists(__spark_entry__.__file__)
