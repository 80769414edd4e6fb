"""The registered queries of the operators and the SQL of those that SQL can express.

Each query is a thin layer that reads the whole table, calls the operator with
its production parameters and derives the digest columns of the result. Rows of
null text, null id, ties and copies: see the operators' modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import (collocations, decontaminate, html_extract, language, licenses, mtree, packing, prefix_trie, quality, quality_rules,
                            sharding, simhash, token_counts)
from cohortflow.llm.common import remainder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id: SimHash of 3-word shingles, links within 2 bits."""
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, words=3, bits=2).select("doc_id", "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: labels are learned only where crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality.quality_scores(docs, labels, remainder(F.col("doc_id"), 3) != 1, remainder(F.col("id"), 3) != 1)
    return scores.select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, remainder(F.col("doc_id"), 5) != 0)
    return language.predicted(docs, model).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens at most."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law `rows`."""
    placed = sharding.feistel_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside any 10-word window of the benchmark."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate line of all documents with its confirmed licence, if any."""
    return licenses.license_blocks(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, whole documents encoded once."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of each vector whose id is divisible by 100."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    nodes = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language, phrases of two to four words seen 30 times or more."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, whether they fail, and the verdict of its group's robust estimate."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_quality, op3_language, op4_packing, op5_sharding, op6_decontamination,
                            op7_licenses, op8_html, op9_token_counts, op10_topk, op11_prefix_trie,
                            op12_collocations, op13_quality_rules)}

_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_decontamination": f"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
        item_window AS (
            SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win
            FROM (SELECT item_id, unnest([w[k : k + 9] FOR k IN range(1, greatest(1, len(w) - 9) + 1)]) AS win FROM item WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM item_window),
        doc AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
        doc_window AS (
            SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, sizes)),
        hit AS (SELECT DISTINCT doc_id, k, n, item_id FROM doc_window JOIN item_window USING (n, win)),
        hit_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
        hit_item AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit_word USING (doc_id) LEFT JOIN hit_item USING (doc_id)""",
    "op10_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pair AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pair
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS b
            FROM conversations WHERE conv_id IS NOT NULL),
        conv AS (
            SELECT c, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
                lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [CAST(0 AS BIGINT) FOR i IN range(8)]),
                    lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
            FROM (SELECT DISTINCT c FROM turns)),
        head AS (SELECT c, c - c % 5 AS base, xor(crc, 4294967295) % 9 AS h FROM conv),
        rebuilt AS (
            SELECT h.c, t.pos AS d, t.t, t.b FROM head h JOIN turns t ON t.c = h.base AND t.pos <= h.h
            UNION ALL
            SELECT h.c, least(h.h, coalesce(n.n, 0)) + t.pos - h.h, t.t, t.b
            FROM head h JOIN turns t ON t.c = h.c AND t.pos > h.h LEFT JOIN (SELECT c, max(pos) AS n FROM turns GROUP BY c) n ON n.c = h.base),
        path AS (
            SELECT c, d, b, sha256(string_agg(t, ',') OVER w) AS node
            FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT c, 0, 0, '' FROM head),
        step AS (SELECT c, d, b, node, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS ended FROM path),
        node AS (
            SELECT node, any_value(parent) AS parent, any_value(d) AS d, any_value(b) AS b, min(c) AS c, count(*) AS n,
                   sha256(coalesce(string_agg(CASE WHEN ended THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
            FROM step GROUP BY node),
        child AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
        below AS (
            SELECT s.node, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (WHERE k.n_children IS NULL) AS leaves
            FROM node u LEFT JOIN child k USING (node) JOIN step s ON s.c = u.c AND s.d <= u.d GROUP BY s.node)
        SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, p.c AS parent_conv_id, v.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
               below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM node v LEFT JOIN node p ON p.node = v.parent LEFT JOIN child k ON k.node = v.node JOIN below ON below.node = v.node""",
    "op12_collocations": r"""
        WITH doc AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents),
        piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
                  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM doc)),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
        gram AS (
            SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM piece, (SELECT unnest([1, 2, 3, 4]) AS m))),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
        words AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
        part AS (
            SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : m], ' ') AS rp
            FROM (SELECT *, unnest(range(1, m)) AS k FROM words)),
        cut AS (
            SELECT part.*, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score
            FROM part JOIN f l ON l.lang = part.lang AND l.phrase = lp JOIN f r ON r.lang = part.lang AND r.phrase = rp
            QUALIFY row_number() OVER (PARTITION BY part.lang, part.phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, array_to_string(w[k : k + size - 1], ' ') AS phrase, max(f) AS longer
            FROM (SELECT lang, w, f, size, unnest(range(1, m - size + 2)) AS k FROM words JOIN (SELECT unnest([2, 3]) AS size) ON size < m)
            GROUP BY ALL)
        SELECT cut.lang, row_number() OVER (PARTITION BY cut.lang ORDER BY score DESC, a DESC, cut.phrase) AS rank, cut.phrase, a, l, r, n, score
        FROM cut JOIN total ON total.lang = cut.lang LEFT JOIN inside i ON i.lang = cut.lang AND i.phrase = cut.phrase
        WHERE longer IS NULL OR 100 * longer < 80 * a
        QUALIFY row_number() OVER (PARTITION BY cut.lang ORDER BY score DESC, a DESC, cut.phrase) <= 2000""",
}
