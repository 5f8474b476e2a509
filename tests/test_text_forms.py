"""Unicode forms, cleaning, sections, quality, versions and parsers on small own inputs."""

import datetime
import difflib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import compare, html, parse, sections, spelling, unicode
from tidemark.functions import text as text_functions
from tidemark.functions.arrays import running
from tidemark.functions.text import character_error_rate, drop_numeric_tables, word_error_rate
from tidemark.operators import layout


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()
    return row["x"]


def test_unicode_forms(spark):
    t = F.col("t")
    assert one(spark, unicode.normal(t), t=" Été  \nLONG ") == "été long"
    assert one(spark, unicode.fold(t), t="Tiếng Đức") == "tieng duc"
    assert one(spark, unicode.plain_characters(t), t="“a”—b­c d e ﬁ") == '"a"-b-c d\ne fi'
    assert one(spark, unicode.unescape(t), t="a &eacute;&#8217;&amp;lt; b") == "a é’&lt; b"
    assert all(one(spark, f(t), t=None) is None for f in (unicode.nfc, unicode.normal, unicode.fold, unicode.unescape))


PAGE = (
    "<html><head><title>gone</title></head><style>x{}</style><body><ix:header>cik v:gone</ix:header><p><span>Ca</span><b>sh</b> flows</p>"
    "<table><tr><td>7,01</td><td>88</td></tr></table><table><tr><td>item one</td><td>is fine</td></tr></table>long-\n term &amp; caf&eacute;<ix:hidden>gone</ix:hidden></body></html>"
)


def test_pages_are_cleaned(spark):
    got = one(spark, html.clean_filing(F.col("t")), t=PAGE)
    assert [x.strip() for x in got.split("\n") if x.strip()] == ["CASH FLOWS", "ITEM ONE", "IS FINE", "LONG-TERM & CAFÉ"] and "\n\n\n" not in got
    assert one(spark, html.clean_filing(F.col("t")), t=None) is None and one(spark, html.clean_filing(F.col("t")), t="") == ""


def test_submissions_are_dispatched(spark):
    wrap = lambda kind, body: f"<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>1\n<TEXT>{body}</TEXT>\n</DOCUMENT>"
    clean = lambda t: one(spark, html.clean_filing(F.col("t")), t=t)
    assert clean(wrap("EX-21", "other") + wrap("10-K", "<html><p>wo<b>rd</b></p><p>two</p></html>")) == "WORD\n\nTWO"
    assert clean(wrap("10-K405", "plain <c>text</c> wi<i>de</i>\nbegin 644 a.gif\nM0\nend\nrest <PDF>x\ny</PDF>")) == "PLAIN TEXT WI DE \n REST"
    assert clean(wrap("10-KSB", "small")) == "" and clean(wrap("8-K", "news")) == ""


def test_tables_of_numbers(spark):
    nested = "<table a=1>12345<table>67</table>9 tail</table>"
    assert one(spark, drop_numeric_tables(F.col("t")), t="a" + nested) == "a 9 tail</table>"
    kept = "<TABLE></TABLE><table>abc1</table>"
    assert one(spark, drop_numeric_tables(F.col("t")), t=kept) == kept


BODY = "SALES FELL AGAIN. " * 120
HEAD = "ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS"


@pytest.mark.parametrize(
    "text, status, words",
    [
        (f"{HEAD}\n21\nITEM 8. OTHER\n30\n{HEAD}\n{BODY}\nITEM 7A. RISK", "ok_t1_10k_item7", 366),
        (f'AS ITEM 7 SAYS, "{HEAD}" OF\n{HEAD} (CONTINUED)\n{BODY}\nITEM 7A. RISK', "no_match", None),
        (f'{HEAD} ("MD&A")\n{BODY}\nREPORT OF INDEPENDENT X', "ok_t1_10k_item7", 367),
        (f"COMBINED MANAGEMENTS DISCUSSION\n{BODY}\nCONSOLIDATED BALANCE SHEET", "ok_t3_bare", 363),
        (f"{HEAD}\n{BODY[:1000]}\nITEM 7A. X", "no_match", None),
        (f"{HEAD}\n{BODY}\n{HEAD}\n{BODY}{BODY}\nITEM 7A. X", "ok_t1_10k_item7", 1092),
        ("", "no_match", None),
    ],
)
def test_discussion(text, status, words):
    got, told = sections.discussion(text, "10-K")
    assert told == status and (len(got.split()) if got else None) == words


def test_short_form_and_risk_factors(spark):
    short = f"ITEM 6. PLAN OR MANAGEMENT'S DISCUSSION\n{BODY}\nITEM 7. FINANCIAL STATEMENTS"
    assert sections.discussion(short, "10-KSB")[1] == "ok_t1_ksb_item6"
    assert sections.discussion(f"VI. MANAGEMENT'S DISCUSSION {BODY} CONSOLIDATED BALANCE SHEETS", "10-KSB")[1] == "ok_t2_roman"
    assert sections.discussion(short, "10-K")[1] == "no_match"
    risk = f"ITEM 1A. RISK FACTORS 5 ITEM 1B. NONE 6\nITEM 1A. RISK FACTORS\n{BODY}\nITEM 2. OUR PROPERTIES"
    got, told = sections.risk_factors(risk)
    assert told == "ok" and len(got.split()) == 364
    s = spark.createDataFrame([(short, "10-KSB"), (None, None)], "t string, f string").select(sections.extract_discussion(F.col("t"), F.col("f")).alias("s"), sections.extract_risk_factors(F.col("t")).alias("r"))
    assert [(r["s"]["status"], r["r"]["status"]) for r in s.collect()] == [("ok_t1_ksb_item6", "no_match"), ("no_match", "no_match")]


def test_syllables_and_quality():
    good, bad = ("nguời", "đường", "Quốc", "an"), ("strong", "té̀st", "b2", "")
    assert all(map(spelling.is_syllable, good)) and not any(map(spelling.is_syllable, bad))
    clean = "công ty đã đạt kết quả tốt trong năm nay và tiếp tục mở rộng thị trường sang nhiều tỉnh mới"
    score, valid, junk, broken, n = spelling.measure(clean)
    assert score == 1.0 and (valid, junk, broken, n) == (1.0, 0.0, 0.0, 21)
    spoilt = spelling.measure(clean.replace("ế", "«").replace("à", "1").replace("ộ", ""))
    assert spoilt[0] < score and spoilt[2] > 0 and spoilt[3] > 0
    assert spelling.measure("few words")[:4] == (0.0, 0.0, 0.0, 0.0)
    assert spelling.measure("12 3,5 7% " * 10)[:2] == (0.4, 0.0)  # numbers alone are neither words nor broken
    assert spelling.measure("zz " * 20, {"zz"})[1] == 1.0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_equal_plain_distances(spark):
    g = random.Random(4)
    pairs = [("Hello  World", "hello world"), ("", ""), ("a", None), (None, "a b"), ("é", "é")]
    pairs += [(" ".join(g.choices("ab cd ệ F".split(), k=g.randint(0, 9))), " ".join(g.choices("ab cd ệ F".split(), k=g.randint(0, 9)))) for _ in range(60)]
    x = spark.createDataFrame(pairs, "f string, w string").select("f", "w", word_error_rate(F.col("f"), F.col("w")).alias("wer"), character_error_rate(F.col("f"), F.col("w")).alias("cer"))
    for r in x.collect():
        f, w = (unicode._nfc((t or "").lower()).strip() for t in (r["f"], r["w"]))
        f, w = " ".join(f.split()), " ".join(w.split())
        assert r["cer"] == pytest.approx(edit(f, w) / max(len(w), 1)) and r["wer"] == pytest.approx(edit(f.split(), w.split()) / max(len(w.split()), 1))


def test_word_error_rate_of_many_words(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    assert one(spark, word_error_rate(F.col("f"), F.col("w")), f=a, w=a + " more") == pytest.approx(1 / 3001)


def test_word_distance_of_long_texts_takes_seconds():
    g = random.Random(7)
    for _ in range(200):
        a, b = (g.choices("abcd", k=g.randint(0, 14)) for _ in range(2))
        assert text_functions.word_distance(a, b) == edit(a, b)
    a = [f"w{g.randint(0, 4000)}" for _ in range(20_000)]
    b = a[:9_000] + ["new"] * 7 + a[9_010:]
    began = time.time()
    assert text_functions.word_distance(a, b) == 10 and time.time() - began < 20


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(row[j - 1], last[j])
    return row[-1]


def test_similarity(spark):
    g = random.Random(1)
    for _ in range(80):
        a, b = ("".join(g.choices("abc ", k=g.randint(0, 30))) for _ in range(2))
        assert compare.common_length(a, b) == longest_common(a, b)
    assert one(spark, compare.similarity(F.col("a"), F.col("b")), a="ABC  d", b="abc d") == 1.0
    assert one(spark, compare.similarity(F.col("a"), F.col("b")), a=None, b="") == 1.0


def test_word_differences(spark):
    g = random.Random(2)
    rows = [tuple(" ".join(g.choices("a b c D d".split(), k=g.randint(0, 12))) + g.choice(["", " ", "\n"]) for _ in range(2)) for _ in range(60)]
    rows += [("a  b c", "a  x y c"), ("x", "y"), (" x y ", " z "), ("", "")]
    got = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "old string, new string, i int").select("i", compare.differences(F.col("old"), F.col("new")).alias("d")).collect()
    for r in got:
        (old, new), d = rows[r["i"]], r["d"]
        assert "".join(p["text"] for p in d["old"]) == old and "".join(p["text"] for p in d["new"]) == new
        words = lambda side, kind: [w.lower() for p in d[side] if p["kind"] == kind for w in p["text"].split()]  # noqa: E731, B023
        assert words("old", "same") == words("new", "same")
        m = difflib.SequenceMatcher(None, old.lower().split(), new.lower().split(), autojunk=False)
        assert len(words("old", "same")) == sum(n for *_, n in m.get_matching_blocks())
        assert all(x["kind"] != y["kind"] and x["text"] for x, y in itertools.pairwise(d["old"]))
    shown = {r["i"]: [tuple(p) for p in r["d"]["new"]] for r in got}
    assert shown[60] == [("a  ", "same"), ("x y", "ins"), (" c", "same")] and shown[61] == [("y", "ins")] and shown[62] == [(" ", "same"), ("z", "ins"), (" ", "same")] and shown[63] == []
    none = spark.createDataFrame([(None, "a")], "old string, new string").select(compare.differences(F.col("old"), F.col("new")).alias("d")).first()["d"]
    assert none["old"] == [] and [tuple(p) for p in none["new"]] == [("a", "ins")]


def test_accept_rule(spark):
    rule = lambda mode, new, like, before, after: one(spark, compare.accepted(F.col("m"), F.col("n"), F.lit(like), F.lit(before), F.lit(after)), m=mode, n=new)
    assert rule("text_fix", " \n", 1.0, 0.1, 0.9) == "llm_empty" and rule("text_fix", "x", 0.79, 0.1, 0.9) == "rewrite_suspected"
    assert rule("vision", "x", 0.1, 0.5, 0.4) == "quality_not_improved" and rule("vision", "x", 0.1, 0.4, 0.4) == "accepted"


def test_parsers(spark):
    t = F.col("t")
    ask = lambda column, value: one(spark, column, t=value)
    assert ask(parse.clean_url(t), "/a/b?utm_x=1&y") == "https://cafef.vn/a/b" and ask(parse.clean_url(t), "https://x/y?z=1") == "https://x/y?z=1" and ask(parse.clean_url(t), None) == ""
    assert ask(parse.url_kind(t), "/du-lieu/x") == "cbtt" and ask(parse.url_kind(t), None) == "bai_bao"
    assert ask(parse.accession(t), "000123456789012345") == "0001234567-89-012345"
    assert tuple(ask(parse.coefficient(t), "-0.0017** (0.0019)")) == (-0.0017, 0.0019, "**") and tuple(ask(parse.coefficient(t), "N")) == (None, None, None)
    assert ask(parse.fiscal_year(t), "report 2019, of 2018") == 2018 and ask(parse.fiscal_year(t), "none") is None
    assert ask(parse.language(t), "bctn (EN).pdf") == "en" and ask(parse.language(t), "len.pdf") == "vi" and ask(parse.language(t), "bản tiếng Anh") == "en"
    for answer in ('```json\n{"a": 3}\n```', '{"a": 3}', 'so: {"a": 3} ok'):
        assert ask(parse.fenced_json(t, "a int"), answer)["a"] == 3
    assert ask(parse.epoch_date(t), "/Date(1700000000000)/") == datetime.datetime(2023, 11, 15, 5, 13, 20)
    day, late = parse.acceptance(t)
    assert (ask(day, "2020-02-03T16:00:01.000Z"), ask(late, "2020-02-03T16:00:01.000Z")) == (datetime.date(2020, 2, 3), True) and ask(day, "no") is None


def boxes(*rows):
    return [(x, y, x + w, y + h, t, n) for n, (x, y, w, h, t) in enumerate(rows)]


def test_reading_order(spark):
    page = boxes((0, 0, 200, 10, "title"), (110, 30, 90, 10, "r1"), (0, 30, 90, 10, "l1"), (0, 45, 90, 10, "l2"), (110, 45, 90, 10, "r2"), (0, 90, 200, 10, "foot"))
    assert [b[4] for b in layout.ordered(page)] == ["title", "l1", "l2", "r1", "r2", "foot"]
    narrow = boxes((0, 0, 50, 10, "a"), (55, 0, 50, 10, "b"), (0, 12, 50, 10, "c"))  # no column: under 8 points apart
    assert [b[4] for b in layout.ordered(narrow)] == ["a", "b", "c"]
    assert layout.ordered([]) == []
    df = spark.createDataFrame([(1, [(0.0, 9.0, 5.0, 12.0, "low", 0, 0), (0.0, 0.0, 5.0, 5.0, "top", 1, 0), (0.0, 0.0, 1.0, 1.0, "pic", 2, 1), (0.0, 0.0, 1.0, 1.0, " ", 3, 0)]), (2, None)], f"id int, blocks {layout.BLOCKS}")
    got = {r["id"]: (r["order"], r["text"]) for r in layout.reading_order(df, "id").collect()}
    assert got == {1: ([1, 0], "top\nlow"), 2: ([], "")}


def test_letters(spark):
    pages = [
        (1, 0, "Mục lục\nThông điệp 3"), (1, 1, "THÔNG ĐIỆP " + "từ " * 300), (1, 2, "tiếp tục. Trân trọng"), (1, 3, "sau"),
        (2, 0, "Letter to shareholders"), (2, 1, "General information about us"), (3, 0, "nothing here"), (4, 0, None),
    ]
    df = spark.createDataFrame(pages, "doc int, page int, text string")
    got = {r["doc"]: (r["start_page"], r["end_page"], r["flag"]) for r in layout.locate_letters(df, "doc").collect()}
    assert got == {1: (1, 2, "ok"), 2: (0, 0, "too_short"), 3: (None, None, "not_found"), 4: (None, None, "not_found")}


def test_machine_runs_and_readable_view(spark):
    run = " ".join(["us-gaap:Cash"] * 12 + ["and", "so"] + ["2020-01-31"] * 8)
    ranges = lambda t: [tuple(r) for r in one(spark, layout.machine_runs(F.col("t")), t=t)]
    assert ranges("Text " + run + " end") == [(5, 5 + len(run), 20)]
    assert ranges(run.replace("and so", "a b c")) == [] and ranges(None) == [] and ranges("") == []
    two = f"é {run}\n\n  a b c d {run} "
    assert [two[a:b] for a, b, _ in ranges(two)] == [run, run]
    text = "dòng một bị\nngắt giữa câu.\n1 2\n\n|\nTIÊU ĐỀ\nsau đó"
    view = lambda t, g="vi": one(spark, layout.readable_view(F.col("t"), F.lit(g)), t=t)
    shown, hidden = view(text)
    assert len(shown) == len(text) and shown.startswith("dòng một bị ngắt giữa câu.\n")
    assert [(text[a:b], n) for a, b, n in hidden] == [("1 2\n\n|\n", 2)] and "TIÊU ĐỀ\nsau" in shown
    assert view(None)["text"] == "" and tuple(view("a b", "fr")) == ("a b", []) and [tuple(h) for h in view(run, "en")["hidden"]] == [(0, len(run), 20)]
    for t in ("1\n2", "\n\n", "\n1\nmột hai ba\n\n-\nbốn năm\n9", "x", "một hai\n", "1\n\n2\nmột hai.\nBa bốn"):
        shown, hidden = view(t)
        lines = [(m.start(), m[0]) for m in re.finditer(r"(?:^|(?<=\n))[^\n]*", t)]
        worded = [(at, x) for at, x in lines if re.search(r"[^\W\d_]{2,}", x)]
        assert len(shown) == len(t) and all(shown[at : at + len(x)] == x for at, x in worded)
        marked = {i for a, b, _ in hidden for i in range(a, b)}
        junk = {i for at, x in lines if x.strip() and (at, x) not in worded for i in range(at, at + len(x))}
        assert junk <= marked and not any(i in marked for at, x in worded for i in range(at, at + len(x)))


def test_running_sums_and_many_runs_in_one_text(spark):
    n = [1, 2, 3, 4, 5, 16, 17, 64, 65, 300]
    df = spark.createDataFrame([(list(range(k, 2 * k)),) for k in n] + [([],), (None,)], "a array<int>")
    got = [(r[0], r[1]) for r in df.select("a", running(F.col("a"))).collect()]
    assert all(sums == (None if a is None else [sum(a[: i + 1]) for i in range(len(a))]) for a, sums in got)
    text = " é bb  ccc d ".join(["2020-01-31 " * 19 + "2020-02-28"] * 4000)  # by sums up to each run: 4000 times 96,000 words
    began = time.monotonic()
    runs = [tuple(r) for r in one(spark, layout.machine_runs(F.col("t")), t=text)]
    assert time.monotonic() - began < 60 and len(runs) == 4000
    assert all(text[a:b].split() == ["2020-01-31"] * 19 + ["2020-02-28"] and k == 20 for a, b, k in runs)
