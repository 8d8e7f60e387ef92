"""Every operator: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from codexmill.llm import encoding, leakage, lookalike, packing, sentences, spans, splitting, terms

LONG = "Ein langer Satz über Wörter. " * 4000
ROWS = [
    (1, LONG, "de", "w:1", 1, "a"), (2, LONG, "de", "w:1", 1, "a"), (2, LONG, "de", "w:1", 1, "a"), (3, None, None, None, None, None), (4, "", "", "", 0, ""),
    (None, LONG + "x", None, None, None, None), (5, "x" * 5000, "en", None, None, "b"), (6, " \n", "xx", "w:2", 2, None),
]


@pytest.fixture(scope="module")
def records(spark):
    d = spark.createDataFrame(ROWS, "id long, raw_text string, language string, segment_id string, sequence_no long, witness string")
    d = d.withColumn("norm_text", F.col("raw_text")).withColumn("folded_text", F.col("raw_text")).withColumn("lemma_text", F.lower("raw_text"))
    for clash in ("h", "pos", "places", "text", "term", "field", "salt", "segment", "start", "_plain", "_cand", "_text", "token", "fixed", "n_tokens", "grp", "size", "_look", "start_char", "records", "look", "form", "key", "own", "dest", "shard", "part", "off", "cand", "chars", "left", "at", "word", "unified"):
        d = d.withColumn(clash, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def documents(records):
    return records.drop("text", "segment_id").select(F.col("id").alias("doc_id"), F.col("raw_text").alias("text"), *[c for c in records.columns if c not in ("id", "raw_text", "text", "segment_id")])


def items(spark):
    return spark.createDataFrame([(1, LONG[:200]), (1, LONG[:200]), (2, None), (None, LONG[:100]), (3, "")], "item_id long, text string").withColumn("h", F.lit("x"))


OPS = {
    "spans": lambda s, r, d: spans.shared_spans(r),
    "span report": lambda s, r, d: spans.shared_report(r),
    "terms": lambda s, r, d: terms.record_terms(r),
    "sentences": lambda s, r, d: sentences.split_sentences(r),
    "oversized": lambda s, r, d: splitting.oversized(r),
    "pieces": lambda s, r, d: splitting.split_oversized(r),
    "same look": lambda s, r, d: lookalike.same_look(r),
    "look classes": lambda s, r, d: lookalike.look_classes(r),
    "unified": lambda s, r, d: lookalike.unify_all(r),
    "fill": lambda s, r, d: packing.fill_report(d),
    "containers": lambda s, r, d: packing.fill_containers(d),
    "leakage": lambda s, r, d: leakage.leaked_passages(d, items(s)),
    "garbled": lambda s, r, d: encoding.garbled_texts(d),
}


@pytest.mark.parametrize("op", OPS)
def test_odd_rows_and_empty_tables(spark, records, documents, op):
    OPS[op](spark, records, documents).collect()
    assert OPS[op](spark, records.filter("false"), documents.filter("false")).count() == 0


def test_results_of_odd_rows(spark, records, documents):
    n = len(LONG)
    assert {tuple(r) for r in spans.shared_spans(records).collect()} == {(1, 0, n), (2, 0, n)}
    cuts = {r.id: r.cut for r in splitting.oversized(records).collect() if r.id}
    assert cuts == {1: "natural", 2: "natural", 5: "forced"}
    pieces = splitting.split_oversized(records).filter("id = 5").orderBy("piece_no").collect()
    assert [r.sequence_no for r in pieces] == [None] * 3 and sum(r.end_char - r.start_char for r in pieces) == 5000
    assert lookalike.same_look(records).count() == 0
    leaks = {tuple(r) for r in leakage.leaked_passages(documents, items(spark)).collect()}
    assert leaks == {(1, 1), (2, 1)}
    assert encoding.garbled_texts(documents).count() == 0
    s = sentences.split_sentences(records).filter("id = 1").agg(F.count("*").alias("n"), F.max("end_char").alias("e")).first()
    assert (s.n, s.e) == (4000, n - 1)
