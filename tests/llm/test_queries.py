"""The registered queries: against SQL where there is some, else their columns and rows; and the pipeline."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolecast.llm import quality
from rolecast.llm.oracles import ORACLES
from rolecast.llm.queries import REGISTERED
from tests.llm.test_chosen_path import plain_components
from tests.llm.test_content import plain_base

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_html_text": "page_id url text n_chars",
    "op4_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_langid": "doc_id held_out lang_pred score",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_token_counts": "doc_id n_tokens",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_chosen_path": "doc_id n_shingles component_id kept",
    "op12_ranked_search": "item_id rank doc_id score",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}
#: What has no row for each row of its table: pieces, and the best of a query.
OTHER_ROWS = {"op5_best_fit_packing": 200, "op12_ranked_search": 1, "op13_hard_negatives": 1}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{SMALL}/{name_of}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = REGISTERED[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = REGISTERED[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    source = "pages" if name == "op3_html_text" else "documents"
    rows = spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    assert found.count() >= OTHER_ROWS[name] if name in OTHER_ROWS else found.count() == rows


def test_chosen_path_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in REGISTERED["op11_chosen_path"](spark, SMALL).collect())
    assert got == sorted(plain_components(docs))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTERED) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == list(before[min(before)].__fields__), name
        kept.append({r.doc_id: r for r in docs.collect()})
    language, rules, lines, near = kept[1:]
    assert set(language) == set(before)  # every text there is clean text of a language
    failed = {i for i, r in language.items() if plain_base(r.text)[5]}
    assert failed.isdisjoint(rules) and len(rules) > 0.7 * len(before)
    assert set(lines) == set(rules) and all(r.n_chars == len(r.text) for r in lines.values())
    shingles = {i: {tuple(r.text.lower().split()[k : k + 5]) for k in range(len(r.text.split()) - 4)} for i, r in lines.items()}
    like = defaultdict(set)
    for a in lines:
        for b in lines:
            if a < b and shingles[a] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                like[b].add(a)
    assert set(like).isdisjoint(near)  # copies of a smaller id are gone
    alone = [i for i in lines if shingles[i] and not any(shingles[i] & shingles[j] for j in lines if j != i)]
    assert set(alone) <= set(near)  # and what has nothing in common with others stays
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == set(near)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_takes_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a few words", "en", None, 1), (3, "a few words", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # all too short
    assert not quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).fitted
