"""Queries and the pipeline over a small table, against plain versions where they have any."""

import collections

import pytest

from tagweave.llm import packing, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    text = {"en": "the quick brown fox jumps over the lazy dog near {} river bank", "de": "der schnelle braune fuchs springt über den {} faulen hund"}
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        words = " ".join(text[lang].format(f"{w}{k}") for w in ("alpha", "beta", "gamma"))
        rows.append((k, words, lang, f"src{k % 5}", len(words)))
    rows += [(100, rows[0][1], "en", "src0", 1), (101, None, None, None, None), (102, "12345 !!", "en", "src1", 8), (103, rows[1][1] + " card 4111111111111111.", "de", "src1", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, k % 3 == 0, int(k % 4 == 0)) for k in range(60)], "doc_id bigint, quality boolean, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_stages(spark, folder):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before), name
        if name == "language":
            assert set(before) - set(after) == {101, 102}
        if name == "near-dedup":
            assert 100 not in after and 0 in after
        if name == "pseudonyms":
            assert set(before) == set(after) and "4111111111111111" not in " ".join(r.text for r in after.values())
    pieces = c.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    lengths = collections.Counter(r["length"] for r in pieces)
    assert len({r.sequence_id for r in pieces}) == packing.best_fit_decreasing(lengths, 1024)[1]


def test_contract_columns(spark, folder):
    want = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op2_simhash_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op3_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"], "op5_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op9_bk_tree_near_dedup": ["doc_id", "fingerprint", "component_id"],
        "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, folder)
        assert df.columns[: len(columns)] == columns, name
        if name != "op10_best_fit_packing":
            assert df.count() == n, name
