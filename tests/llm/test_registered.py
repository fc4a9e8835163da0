"""Each corpus query has SQL or a test against brute force, a round trip, fixed results or held-out accuracy."""

import importlib

from hookloom.llm import queries

# Query without SQL: the module and test that hold it to account instead.
TESTED_BY = {
    "op1_sharding": ("test_sharding", "test_report_is_balanced_and_gapless"),
    "op3_html_extraction": ("test_html", "test_texts"),
    "op4_personal_data": ("test_pii", "test_report"),
    "op5_quality_rules": ("test_quality", "test_counts_match_brute_force"),
    "op6_warc_capture_index": ("test_warc", "test_round_trip_and_order"),
    "op7_simhash_near_dedup": ("test_simhash", "test_fingerprints_and_components_match_brute_force"),
    "op8_soft_membership_mixing": ("test_mixing", "test_held_out_accuracy_and_rows"),
    "op10_benchmark_decontamination": ("test_decontaminate", "test_random_small_vocabulary"),
    "op11_document_fingerprints": ("test_winnowing", "test_report_matches_brute_force"),
}


def test_queries_without_sql_are_tested_otherwise():
    assert set(queries.queries()) - set(queries.oracle_sql()) == set(TESTED_BY)
    for module, test in TESTED_BY.values():
        found = importlib.import_module(f"tests.llm.{module}")
        assert hasattr(found, test)
