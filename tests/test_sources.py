"""Files written here and read back: headers, compression, names, nested data, word lists, the log."""

import gzip
import json

import pytest

from tidemark.sources import files


def test_csv_keeps_words_and_passes_the_byte_order_mark(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt", encoding="utf-8-sig") as f:
        f.write("Word,Negative\nNULL,1\nNA,0\n,2\n")
    got = files.read_csv(spark, str(tmp_path), "Word string, Negative int").collect()
    assert [(r["Word"], r["Negative"]) for r in got] == [("NULL", 1), ("NA", 0), (None, 2)]


def test_price_files_below_a_folder(spark, tmp_path):
    for place, ticker in (("a", "AAA"), ("b/c", "BBB")):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "p.csv").write_text(f"<Ticker>,<DTYYYYMMDD>,<Open>,<Close>,<Volume>\n{ticker},20200131,1,2.5,10\n", encoding="utf-8-sig")
    got = sorted((r["ticker"], str(r["date"]), r["close"], r["volume"]) for r in files.read_tree(spark, str(tmp_path)).collect())
    assert got == [("AAA", "2020-01-31", 2.5, 10.0), ("BBB", "2020-01-31", 2.5, 10.0)]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    for name, text in {
        "a": "<Ticker>,<DTYYYYMMDD>,<Close>,<Volume>\nAAA,20200131,2.5,10\n",
        "b": "\n<DTYYYYMMDD>,<Volume>,<Open>,<Close>,<Ticker>\n20200131,20,1,3.5,BBB\n20200201,,1,x,BBB\n",
        "c": '<Ticker>,"<Close>",<DTYYYYMMDD>\nCCC,4.5,20200131\n',
        "d": "<Ticker>,<DTYYYYMMDD>,<Close>,<Volume>\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8-sig" if name == "a" else "utf-8")
    want = [("AAA", "2020-01-31", 2.5, 10.0), ("BBB", "2020-01-31", 3.5, 20.0), ("BBB", "2020-02-01", None, None), ("CCC", "2020-01-31", 4.5, None)]
    got = lambda x: sorted((r["ticker"], str(r["date"]), r["close"], r["volume"]) for r in x.collect())
    assert got(files.read_tree(spark, str(tmp_path))) == want
    clean = lambda c: {"dtyyyymmdd": "date"}.get(c.strip("<>").lower(), c.strip("<>").lower())
    assert files.read_named(spark, str(tmp_path), "close double, ticker string", clean, most_files=1).count() == 4
    with pytest.raises(ValueError, match="absent"):
        files.read_named(spark, str(tmp_path), "absent string", clean)
    (tmp_path / "e.csv").write_text("<Ticker>,<ticker>\n1,2\n")
    with pytest.raises(ValueError, match="once"):
        files.read_tree(spark, str(tmp_path))


def test_an_empty_folder_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path), "a string, b int").count() == 0


def test_whole_texts_by_name(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a\nb\n")
    with gzip.open(tmp_path / "two.txt.gz", "wt") as f:
        f.write("c")
    assert {r["name"]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()} == {"one": "a\nb\n", "two": "c"}


def test_facts_take_the_first_unit(spark):
    fact = {"end": "2020-01-01", "filed": "2020-02-01", "val": 5}
    js = {"facts": {"dei": {"X": {"units": {"shares": [fact, fact | {"start": "2019-01-01"}], "other": [fact | {"val": 9}]}}}}}
    df = spark.createDataFrame([(1, json.dumps(js)), (2, '{"facts": {}}'), (3, None), (4, "broken")], "cik int, json string")
    got = files.facts(df, "cik", "json", "dei", "X").collect()
    assert [(r["cik"], r["val"], str(r["start"])) for r in got] == [(1, 5.0, "None"), (1, 5.0, "2019-01-01")]
    assert files.facts(df, "cik", "json", "dei", "Y").count() == 0


def test_filings_of_all_pages(spark):
    page = lambda a, form, day, doc: {"accessionNumber": a, "form": form, "filingDate": day, "acceptanceDateTime": day, "primaryDocument": doc, "reportDate": day}
    js = {"cik": "1", "sic": "7", "pages": [page(["a", "b"], ["10-K", "8-K"], ["2020-01-01"] * 2, ["x", "y"]), page(["c", "d", "a"], ["10-K"] * 3, ["2010-01-01", "2021-01-01", "2020-01-01"], ["z", "", "x"])]}
    df = spark.createDataFrame([(json.dumps(js),)], "json string")
    assert [(r["accession"], r["sic"]) for r in files.submissions(df, "json", ["10-K"], (2019, 2022)).collect()] == [("a", "7")]


def test_word_lists(spark):
    flags = spark.createDataFrame([("loss", 2009, 0, 0, 0), ("gain", -2011, 2009, 0, 1)], "Word string, Negative int, Positive int, Uncertainty int, Litigious int")
    entries = lambda x: {(r["term"], r["category"]) for r in x.collect()}
    base = {("LOSS", "master"), ("GAIN", "master"), ("LOSS", "negative"), ("GAIN", "positive"), ("GAIN", "litigious")}
    assert entries(files.flagged_words(flags)) == base and entries(files.flagged_words(flags, "nonzero")) == base | {("GAIN", "negative")}
    senses = spark.createDataFrame([("BAD#1", "x", None), ("bad#2", "x", None), ("fine", None, "x"), ("so", None, None)], "Entry string, Negativ string, Positiv string")
    assert entries(files.sense_words(senses)) == {("BAD", "negative"), ("FINE", "positive")}
    phrases = spark.createDataFrame([(" Nợ  Xấu", "negative"), ("x", "other")], "word string, category string")
    assert entries(files.phrase_words(phrases)) == {("nợ xấu", "negative")}
    lines = ["# note\tx\t1\t0\ta#1", "a\t1\t0.5\t0\ttốt_đẹp#1 hay#2", "a\t1\t0.6\t0.6\teven#1", "a\t1\t\t0.7\txấu#1", "short\tline"]
    got = entries(files.scored_words(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert got == {("tốt đẹp", "positive"), ("hay", "positive"), ("xấu", "negative")}


def test_log_appends_what_is_new(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], "id int, t string")
    assert files.append_new(first, path, "id", "t").count() == 2
    assert files.append_new(first, path, "id", "t").count() == 2
    assert files.append_new(spark.createDataFrame([(1, "b"), (2, "")], "id int, t string"), path, "id", "t").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345, "x")], "a int, b double, c string")
    files.write_table(df, str(tmp_path / "t"), 3)
    assert files.read_csv(spark, str(tmp_path / "t"), "a int, b double, c string").first()["b"] == 0.123
    files.write_sections(spark.createDataFrame([(1, "full", "t"), (1, "1a", "u")], "doc_id int, section string, text string"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("section = '1a'").first()["text"] == "u"
