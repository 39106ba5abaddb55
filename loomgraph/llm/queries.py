"""The registered queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontam, divergence, jaccard_join, langid, merkle, pii, quality, secrets, suffix_dedup, token_counts, toxicity, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = langid.train(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    return langid.identify_language(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.find_personal_data(docs, pii.train(docs, "doc_id", "text")).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(spark, table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long")
    every = F.array_sort(F.concat("base_spans", "added_spans"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.shown(F.col("base_spans")), 256).alias("base_sha256"), secrets.shown(every).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE).drop("text")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.rule_ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    judged = quality.apply_policy(quality.apply_policy(ledger, "base", "base_kept"), "v1", "kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(touched, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": claimed})
    return merkle.verified(found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", held_out)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out)
    chosen = F.broadcast(toxicity.labelled_sample(labels, "doc_id", "toxic"))  # a bounded number of keys
    model = toxicity.train(docs.where(~F.col("held_out")).join(chosen, "doc_id"), "text", "toxic", by=("doc_id",))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_langid, op2_pii, op3_suffix_dedup, op4_secrets, op5_decontamination, op6_token_counts, op7_jaccard, op8_warc, op9_bpe, op10_quality, op11_merkle, op12_divergence, op13_toxicity)}



def _merkle_sql(arity: int = merkle.ARITY, levels: int = 18) -> str:
    """All levels of the parts' trees, then of the tree of subroots, up and down again; enough levels for 3 ** 18 rows of a part."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_concat([ascii(CAST(doc_id AS VARCHAR)[i])], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    # the sum is inverted at its end, so it is even where the last bit is set before
    parts = [
        f"d AS MATERIALIZED (SELECT *, CASE WHEN {crc} % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents)",
        f"a0 AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS node, {leaf('other')} AS claimed FROM d)",
        "s AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM a0))",
        "leaves AS MATERIALIZED (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS i, node, claimed FROM a0 JOIN s ON a0.source IS NOT DISTINCT FROM s.source)",
    ]

    def climb(name: str, first: str) -> None:
        parts.append(f"{name}0 AS MATERIALIZED (SELECT tree, i, node, count(*) OVER (PARTITION BY tree) AS n FROM {first})")
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // {arity} AS i, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node, (n + {arity - 1}) // {arity} AS n FROM {name}{k} GROUP BY tree, n, i // {arity})"
            )

    def fold(name: str, nodes: str, first: str) -> None:
        parts.append(f"{name}0 AS ({first})")
        for k in range(levels):
            side = lambda low, high: f"coalesce(string_agg(node, '') OVER (PARTITION BY tree, i // {arity} ORDER BY i ROWS BETWEEN {low} AND {high}), '')"
            parts.append(f"{name}s{k} AS MATERIALIZED (SELECT tree, i, n, {side('UNBOUNDED PRECEDING', '1 PRECEDING')} AS l, {side('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS r FROM {nodes}{k})")
            parts.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT id, p.tree, p.i // {arity} AS i, CASE WHEN n > 1 THEN sha256(l || node || r) ELSE node END AS node, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof FROM {name}{k} p JOIN {name}s{k} q ON p.tree = q.tree AND p.i = q.i)"
            )

    climb("x", "leaves")
    climb("y", f"(SELECT 0 AS tree, tree AS i, node FROM x{levels})")
    fold("u", "x", "SELECT tree || '-' || i AS id, tree, i, claimed AS node, '' AS proof FROM leaves")
    fold("v", "y", f"SELECT id, 0 AS tree, tree AS i, node, proof FROM u{levels}")
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaves.node AS leaf, x{levels}.node AS subroot, y{levels}.node AS root, sha256(proof) AS proof_sha256, v{levels}.node AS folded_root, v{levels}.node = y{levels}.node AS verified "
        f"FROM leaves JOIN x{levels} USING (tree) JOIN v{levels} ON id = leaves.tree || '-' || leaves.i JOIN y{levels} ON true"
    )


ORACLE_SQL = {
    "op11_merkle": _merkle_sql(),
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, c, 1 + (1000000000 * (CAST(c AS HUGEINT) + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM t),
l AS (SELECT lang, term, 1 + (1000000000 * (CAST(c AS HUGEINT) + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(c) AS c FROM t GROUP BY 1, 2)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM e
QUALIFY part = 'pair' OR rank <= 50""",
    "op3_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
w AS (SELECT doc_id, s, md5_number(substr(h, CAST(2 * s + 1 AS BIGINT), 100)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(n_bytes - 49, 0))) AS s FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY 1),
u AS (SELECT doc_id, s FROM w JOIN f USING (g) WHERE first < doc_id),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r
         FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM u)) GROUP BY doc_id, r),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY 1)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 2),
           lambda i: substr(h, CAST(CASE WHEN i = 1 THEN 0 ELSE 2 * ends[i - 1] END + 1 AS BIGINT), CAST(2 * (CASE WHEN i > len(starts) THEN n_bytes ELSE starts[i] END - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, lengths)),
f AS (SELECT doc_id, item_id, n, i FROM g JOIN p USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM f)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to FROM r""",
    "op10_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS x FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
      FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, """
    + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))
    + rf""" AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       bits & {quality.mask("v1")} = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits FROM f""",
}
