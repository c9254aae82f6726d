"""Null and repeated ids, very long texts and ties, operator by operator."""

import zlib

import duckdb
import numpy as np
import test_small as plain
from pyspark.sql import functions as F

from tidemark.llm import chat_rotation, decontaminate, exact_dedup, mixing, substring_dedup, suffix_dedup, token_files


def test_sentence_runs_lower_each_letter_as_the_sql_does(spark, tmp_path):
    texts = ["\u03bf\u03b4\u03cc\u03c2.", "\u039f\u0394\u038c\u03a3.", "\u03bf\u03b4\u03cc\u03c3.", "\u0130zmir.", "izmir.", "i\u0307zmir.", "\u00c9t\u00c9.", "\u00e9t\u00e9."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ours = substring_dedup.op1_sentence_runs(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({substring_dedup.OP1_SQL})").fetchall()
    assert plain.rows(ours, *ours.columns) == sorted(theirs, key=repr)
    assert {r.doc_id for r in ours.collect() if r.n_removed} == {2, 4, 7}


def test_repeated_strings_of_null_and_repeated_ids(spark):
    long = plain.words(60, 1)
    out = suffix_dedup.repeated_strings(plain.docs(spark, [long, long, long, "x " + long, "short"], [1, 1, None, 2, 3])).collect()
    assert [(r.doc_id, r.n_removed, bytes(r.kept)) for r in out] == [(2, len(long), b"x ")]


def test_repeated_strings_of_a_very_long_text(spark):
    texts = {0: plain.words(150_000, 3), 1: plain.words(10, 4)}
    texts[1] += texts[0][400_000:401_000]
    want = plain.repeats_by_hand(texts)
    out = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated_strings(plain.docs(spark, list(texts.values()))).collect()}
    assert out == {i: w for i, w in want.items() if w[0]}


def test_token_files_of_null_and_repeated_ids(spark):
    rows = plain.rows(token_files.digests(plain.docs(spark, ["b", "a", "c", None], [5, 5, None, None]), token_files.tokenizer_path()), "doc_id", "n_tokens", "ids_crc32")
    one = lambda *ids: zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
    assert rows == sorted([(5, 2, one(65)), (5, 2, one(64)), (-1, 2, one(66)), (-1, 1, one())], key=repr)


def test_exact_dedup_of_null_and_repeated_ids(spark, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    plain.docs(spark, ["a", "a", "a ", "b", "b", "c"], [None, 3, 4, 7, 7, None]).repartition(2).write.parquet(path)
    out = exact_dedup.exact_dedup(spark, path)
    assert plain.rows(out, "doc_id", "keep_id", "group_size", "kept") == sorted([(None, None, 2, True), (3, None, 2, False), (4, 4, 1, True), (7, 7, 2, True), (7, 7, 2, True), (None, None, 1, True)], key=repr)


def test_mix_of_long_and_repeated_rows(spark):
    df = plain.docs(spark, [plain.words(30_000), "a b", "a b", "c d", None], [1, 2, 2, 3, None]).withColumn("domain", F.lit(None).cast("string"))
    out = mixing.mix(df, budget=10_000, weights={}, max_epochs=2).collect()
    assert sum(r.take_tokens for r in out) == 10_000 and {r.domain for r in out} == {"none"}
    assert sum(r.take_tokens < r.n_tokens for r in out) <= 1


def test_contaminated_long_text_and_repeated_ids(spark):
    items = spark.createDataFrame([(1, plain.ITEM), (1, plain.ITEM), (2, "nothing of the kind is in any of these documents at all")], "item_id long, text string")
    texts = [plain.words(40_000, 5) + " " + plain.ITEM, "clean words only here", plain.ITEM]
    out = {r.doc_id: r.item_ids for r in decontaminate.contaminated(plain.docs(spark, texts, [1, 2, 2]), items).collect()}
    assert out == {1: [1], 2: [1]}


def test_rotation_of_a_very_long_text(spark):
    long = "é" * 300_000
    df = spark.createDataFrame([(1, 0, "a", "q"), (1, 1, "b", long)], "conv_id long, turn long, role string, text string")
    out = {r.participant: r for r in chat_rotation.rotate(df).collect()}
    lo, hi = map(int, out["b"].mask.split(":"))
    assert out["b"].text[lo:hi] == long + "<|im_end|>"
