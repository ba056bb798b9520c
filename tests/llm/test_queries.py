import pytest
from oracle import compare
from tessella.llm.oracle import ORACLE_SQL
from tessella.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "page_id url text n_chars", 2: "doc_id n_words n_hit n_items items_sha256 contaminated", 3: "doc_id n_tokens", 4: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    5: "doc_id n_assign n_access n_hex base_sha256 spans", 6: "doc_id n_bytes n_removed n_spans kept_sha256", 7: "page_id payload_bytes payload_digest record_type refers_to",
    8: "doc_id n_shingles component_id", 9: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 10: "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF)


def test_repeated_bytes_of_more_documents(spark):
    compare(spark, "op6_suffix_dedup", QUERIES["op6_suffix_dedup"], ORACLE_SQL["op6_suffix_dedup"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    wanted = COLUMNS[int(name[2:].split("_")[0])].split()
    assert df.columns[: len(wanted)] == wanted and df.count() == (50 if "page_id" in wanted else 200)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == "bigint" for c in wanted if c.startswith("n_") or c.endswith("_id") or c == "payload_bytes")
