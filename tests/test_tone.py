from tidemark.operators import stats, tone
from pyspark.sql import functions as F


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _lex(spark, *rows):
    return spark.createDataFrame([("fin", t, c) for t, c in rows], "lexicon string, term string, category string")


def test_negator_removes_positive_only(spark):
    docs = _docs(spark, "Sales did not in sum improve, costs did improve. Margins decline.")
    got = tone.hits(docs, _lex(spark, ("IMPROVE", "positive"), ("DECLINE", "negative")), ("NOT",)).collect()
    assert {(r["category"], r["tf"]) for r in got} == {("positive", 1), ("negative", 1)}


def test_nulls_and_empty_texts_have_no_tone(spark):
    got = tone.indices(_docs(spark, None, ""), _lex(spark, ("IMPROVE", "positive"))).collect()
    assert all(r["net"] == 0.0 for r in got) and len(got) == 2


def test_master_list_is_the_denominator(spark):
    docs = _docs(spark, "Prices fell and fell again", None)
    master = spark.createDataFrame([("FELL",), ("AGAIN",), ("UNUSED",)], "term string")
    got = {r["doc_id"]: (r["n_words"], r["neg"]) for r in tone.indices(docs, _lex(spark, ("FELL", "negative")), master=master).collect()}
    assert got == {0: (3, 2 / 3), 1: (0, 0.0)}


def test_tertiles_of_500_are_167_166_167(spark):
    x = stats.ranked(spark.range(500).select(F.col("id"), F.col("id").cast("double").alias("v")), ["v", "id"], "v", 7)
    got = x.groupBy(stats.tertile(F.col("rank"), F.col("n")).alias("t")).count().orderBy("t").collect()
    assert [r["count"] for r in got] == [167, 166, 167]


def test_queries_and_sql_have_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
