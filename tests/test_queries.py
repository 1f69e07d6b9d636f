"""Registered queries against their SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "f6_keyword_tree",
    "u2_grid_cells",
    "j5_interval_containment",
    "w1_consecutive_pairs",
    "w4_merge_subwords",
    "n8_profile_classifier",
    "n21_tokenise_numbers",
    "h5_parse_table",
    "q1_similar_words",
    "q3_column_similarity_attribute_number_unit",
    "q4_column_similarity_decay",
    "q8_range_token_corpus",
    "q8_range_token_corpus_as_seen",
    "h3_span_fill_first_free",
    "q9_unit_tables_dictionary",
    "q11_interval_chain_384",
    "q12_header_data_rows",
    "m14_train_test_sets",
]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 120


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    state, rows, _, note = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert (state, rows > 0) == ("ok", True), note
