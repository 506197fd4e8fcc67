"""The registered queries: the columns of their contracts, whole tables, and SQL where there is some."""

import pytest

from check import compare, open_tables
from rotorline.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op2_html_text": ["page_id", "url", "text", "n_chars"],
    "op3_token_counts": ["doc_id", "n_pretokens", "n_tokens", "log_probability"],
    "op4_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6_licenses": ["doc_id", "license", "shingles_found", "shingles_of_license"],
    "op7_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    "op11_quality": ["doc_id", "held_out", "score", "predicted"],
    "op12_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
}
FINDINGS = {"op6_licenses", "op12_conversation_trie", "op13_source_divergence"}  # these have no row per document


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, SF_DIR)
    assert out.columns == COLUMNS[name]
    table = "pages" if name.startswith("op2_") else "documents"
    whole = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    key = "page_id" if table == "pages" else "doc_id"
    if name not in FINDINGS:
        assert out.select(key).distinct().count() == whole
    if name not in FINDINGS | {"op9_packing"}:
        assert out.count() == whole


@pytest.mark.parametrize("name", ORACLE)
def test_sql(spark, name):
    _, rows, problem = compare(spark, open_tables(SF_DIR), name, SF_DIR)
    assert problem is None and rows
