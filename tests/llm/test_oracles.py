"""Registered queries against their SQL, and the columns their contracts name."""

import duckdb
import pytest

from sagewell.llm import registry

COLUMNS = {
    "op1_katz_backoff": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_winnow_decontam": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_html_template_removal": "page_id url text n_chars",
    "op4_bpe_speculative": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_spherical_caps": "vec_id n_links component_id kept",
    "op7_hypergeometric_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_simhash_golay": "doc_id fingerprint component_id",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op13_sentencepiece_agenda": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cursor = con.execute(registry.ORACLE_SQL[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*order).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    source = {"op3": "pages", "op6": "embeddings", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    assert df.count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
