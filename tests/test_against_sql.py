"""Queries on small tables of odd rows, row by row against their own SQL."""

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry


def rows(spark: SparkSession, folder, query: str, **tables) -> tuple[list, list]:
    """Rows of the query and of its SQL over the tables, given as (schema, rows)."""
    sql = duckdb.connect()
    for name, (schema, given) in tables.items():
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    names = ", ".join(c for c, *_ in sql.execute(f"DESCRIBE {entry.oracle_sql()[query]}").fetchall())
    want = sql.execute(f"SELECT {names} FROM ({entry.oracle_sql()[query]})").fetchall()
    got = entry.queries()[query](spark, str(folder)).select(*names.split(", "))
    order = lambda xs: sorted((tuple(x) for x in xs), key=str)
    return order(got.collect()), order(want)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "The straße was great and the groß-und of that", "Groß THE Maße and maß-of", "ﬁnal oﬀ-the ﬂag of", "ǰab ŉab ƛab the", "été of a cafétéria the naïve", "caféthe of",
    "жof of×the of÷ ªof the²", "ab--cd -- ab- cd-_x _of 1of of1", "A B c", "",
]
TEXTS += ["the of and to was that in on at " * 12 + w for w in ("loss", "straße of", "of ß the")]


@pytest.mark.parametrize("query", ["docs_ok_filter", "en_token_count", "en_tone_master", "zscore", "tone_indices", "tone_panel", "tone_panel_join", "tone_tertiles", "tone_descriptive"])
def test_letters_that_grow_in_upper_case(spark, tmp_path, query):
    got, want = rows(spark, tmp_path, query, documents=(DOCUMENTS, [(i, t, "en", "web", len(t)) for i, t in enumerate(TEXTS)]))
    assert got and got == want


def test_entities_that_a_title_cuts_off(spark, tmp_path):
    pages = [(1, "<title>this &amp;&amp</title><p>a &amp; b &copy; c&amp</p>"), (2, "<p>&am &ampere; &quot;x&quot; &middot;</p>"), (3, "<p>&amp;copy; groß</p>")]
    got, want = rows(spark, tmp_path, "clean_html_pages", pages=("page_id long, html string", pages))
    assert got == want
