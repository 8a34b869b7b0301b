"""The registered queries against their SQL twins, whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from parity.check import rows_of
from waymark.llm import queries

# Beyond SQL; each is tested against brute force in its own file.
NO_TWIN = {"op2_ngram_join", "op4_pii", "op5_toxicity", "op6_html_extraction", "op7_quality_rules", "op8_packing", "op9_hnsw", "pipeline"}


def test_registered():
    mine = queries.queries()
    assert set(mine) - set(queries.oracle_sql()) == NO_TWIN
    assert sorted({int(name[2:].split("_")[0]) for name in mine if name != "pipeline"}) == list(range(1, 14))
    assert set(mine) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equal_to_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found = queries.queries()[name](spark, small)
    result = con.execute(queries.oracle_sql()[name])
    assert rows_of(found.columns, found.collect()) == rows_of([c[0] for c in result.description], result.fetchall())


COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_ngram_join": "doc_id n_shingles component_id n_links",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_pii": "doc_id text n_found kinds",
    "op6_html_extraction": "page_id url text n_chars",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_hnsw": "vec_id n_links component_id kept",
    "op11_url_filter": "page_id host path rule verdict score",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    assert queries.queries()[name](spark, small).columns == COLUMNS[name].split()
