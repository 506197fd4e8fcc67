"""The registered queries of the training-text operators and the SQL that checks them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from rotorline.llm import (
    conversation_trie, decontaminate, divergence, exact_dedup, html_text, language, licenses, packing, quality, secret_scan, simhash,
    token_counts, token_store)
from rotorline.llm.common import table
from rotorline.session import shared_dir


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs.filter(~language.held_out(docs["doc_id"]))))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.hit_report(hits)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid4().hex}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_store.read_tokens(spark, path, with_ids=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=0, limits=packing.Limits(tokens=1024, segments=1024, loss=1024))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select("doc_id", "fingerprint", "component_id")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs.filter(~language.held_out(docs["doc_id"])), table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality.score_quality(docs, machine, metadata=("n_chars",))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie.conversation_nodes(table(spark, sf_dir, "conversations"), block=100, most_shared=5)
    return nodes.withColumnRenamed("saved_chars", "saved_tokens")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_text": op2_html_text,
    "op3_token_counts": op3_token_counts,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_secrets": op7_secrets,
    "op8_token_store": op8_token_store,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_quality": op11_quality,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_divergence": op13_source_divergence,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_decontaminate": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
        i AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(10, len(words)) AS size,
                      array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS w
               FROM i, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS u(p) WHERE len(words) > 0),
        sizes AS (SELECT DISTINCT size FROM iw),
        dw AS (SELECT r, p, size, array_to_string(words[p:p + size - 1], ' ') AS w
               FROM d, sizes, unnest(range(1, len(words) - size + 2)) AS u(p)),
        hits AS (SELECT r, p, size, item_id FROM dw JOIN iw USING (size, w)),
        inside AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM hits, unnest(range(0, size)) AS u(k) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list
                  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN inside USING (r) LEFT JOIN items USING (r)
    """,
    "op6_licenses": licenses.windows_sql(),
    "op12_conversation_trie": conversation_trie.trie_sql(block=100, most_shared=5),
    "op13_source_divergence": divergence.divergence_sql(least_docs=10, top=10),
}
