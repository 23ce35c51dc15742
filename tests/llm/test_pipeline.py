"""The pipeline as a whole, and each stage on rows that are not as they should be."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIB = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EN = "the quick brown fox jumps over the lazy dog near the river bank of {} while the children of {} play in the green garden of {}"
DE = "der schnelle braune fuchs springt über den faulen hund am ufer von {} und die kinder von {} spielen im grünen garten von {}"


def rows():
    out = [(k, (EN, DE)[k % 2].format(f"alpha{k}", f"beta{k}", f"gamma{k}"), ("en", "de")[k % 2], f"src{k % 5}", 1) for k in range(40)]
    long = " ".join(EN.format(f"x{k}", f"y{k}", f"z{k}") + " " + DE.format(f"x{k}", f"y{k}", f"z{k}") for k in range(120))
    return [
        *out, (50, long, "en", "src0", 1), (51, out[0][1], "en", "src0", 1), (52, out[0][1] + " and more", None, None, None), (None, "the lazy dog of nobody runs over the river bank near the garden", "en", "src1", 1),
        (60, None, "en", "src1", None), (61, "", "en", "src1", 0), (62, "12 ½ !!", "en", "src1", 4), (3, "another text of the children near the river bank that has the same number", "en", "src2", 1), (5, out[5][1], "de", "src0", 1),
        (70, "der hund von nebenan hat die karte 4111 1111 1111 1111 und die kinder spielen im garten", "de", "src3", 1),
    ]


def test_whole_run_packs_what_the_stages_keep(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = c.run(spark, str(tmp_path)).collect()
    kept, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in c.STAGES[:-1]:
        docs = c.common.materialise(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
    assert {60, 61, 62}.isdisjoint({r.doc_id for r in kept["language"]}) and len(kept["language"]) == len(rows()) - 3
    stay = [r.doc_id for r in kept["near-dedup"]]
    assert len(stay) == len(set(stay)) and 51 not in stay and 52 not in stay and None in stay and {0, 3, 5, 50, 70} <= set(stay)
    assert len(kept["pseudonyms"]) == len(stay) and not any("4111 1111 1111 1111" in r.text for r in kept["pseudonyms"])
    want = defaultdict(list)  # the ids of every document of the last stage's input, by the library itself
    for r in kept["mixture"]:
        want[r.doc_id].append([*LIB.encode(r.text, add_special_tokens=False).ids, 2])
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert set(got) == set(want)
    for doc_id, own in got.items():
        (ids,) = want[doc_id]
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))] and sum(p["length"] for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p["length"]], "<u4").tobytes()) for p in own)
        assert all(p["length"] == 1024 for p in own[1:])
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


@pytest.mark.parametrize("at", range(5))
def test_stages_on_empty_tables_and_clashing_columns(spark, at):
    import corpus_pipeline as c

    name, stage = c.STAGES[at]
    empty = stage(spark, spark.createDataFrame([], SCHEMA), "")
    assert empty.count() == 0
    odd = [(None, None, None, None, None), (None, "the dog of the garden", None, None, None), (1, "the dog of the garden", "en", "src1", 21), (1, "the dog of the garden", "en", "src1", 21), (2, "", "en", "src1", 0)]
    df = spark.createDataFrame(odd, SCHEMA)
    for extra in ("score", "lang_pred", "sig", "n", "place", "take", "epoch", "pseudonyms", "length", "part", "component_id"):
        df = df.withColumn(extra, F.lit("x"))
    got = stage(spark, df, "")
    found = got.collect()
    if name != "sequences":
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    if name == "near-dedup":
        assert sorted((r.doc_id for r in found), key=str) == [1, 2, None, None]
    elif name == "pseudonyms":
        assert len(found) == 5
    elif name == "sequences":
        assert sorted((r.doc_id for r in found), key=str) == [1, 1, 2, None, None]
