"""Phrase spans against a plain loop, by the trie and by the join, and what they shuffle."""

import random
import re

import pytest

from tidemark.operators import phrases

WORD = re.compile("[a-zà-ỹđ]+")


def plain(text, entries, longest, negators):
    """Tries every length at every word, the longest first."""
    found, i = [], 0
    words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text.lower())]
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            term = " ".join(w for w, _, _ in words[i : i + n])
            if term in entries:
                off = any(w in negators for w, _, _ in words[max(0, i - 3) : i])
                kept = sorted(c for c in entries[term] if c != "positive" or not off)
                if kept:
                    found.append((words[i][1], words[i + n - 1][2], term, kept))
                break
        else:
            n = 1
        i += n
    return found


@pytest.mark.parametrize("most", [100_000, 3])
def test_random_texts_equal_a_plain_loop(spark, most):
    r = random.Random(4)
    names = ["nợ", "xấu", "tăng", "không", "a", "de", "la"]
    entries: dict[str, set[str]] = {}
    for _ in range(40):
        entries.setdefault(" ".join(r.choices(names, k=r.randint(1, 4))), set()).add(r.choice(phrases.CATEGORIES))
    gaps = [" ", ", ", "-", ". ", "\n", " 12 ", "é_"]
    texts = ["".join(r.choice(names).upper() if r.random() < 0.2 else r.choice(names) + r.choice(gaps) for _ in range(r.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "...", "İ de la", "de la " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lexicon = spark.createDataFrame([(t, c) for t, cs in entries.items() for c in cs] + [("nợ", "negative")] * 2, "term string, category string")
    entries.setdefault("nợ", set()).add("negative")
    got = {x["doc_id"]: x["spans"] for x in phrases.phrase_spans(docs, lexicon, 3, ("không",), most).collect()}
    for i, text in enumerate(texts):
        if text is None or len(text.lower()) != len(text):
            assert got[i] is None
        else:
            assert [tuple(x) for x in got[i]] == plain(text, entries, 3, ("không",)), text


def test_published_examples(spark):
    text = "Nợ xấu tăng nhưng doanh thu tăng trưởng; công ty không tăng trưởng mảng khác. Nợ phải trả ổn định."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    own = spark.createDataFrame([("nợ xấu", "negative"), ("tăng trưởng", "positive")], "term string, category string")
    spans = phrases.phrase_spans(docs, own, 2, ("không",)).first()["spans"]
    assert [(text[s["start"] : s["end"]].lower(), s["categories"]) for s in spans] == [("nợ xấu", ["negative"]), ("tăng trưởng", ["positive"])]
    general = spark.createDataFrame([("nợ", "negative")], "term string, category string")
    assert len(phrases.phrase_spans(docs, general, 1).first()["spans"]) == 2


def test_long_texts_are_walked_in_place(spark):
    docs = spark.createDataFrame([(i, "la de una cosa que el " * 700) for i in range(8)], "doc_id int, text string")
    lexicon = spark.createDataFrame([("de una", "negative")], "term string, category string")
    spans = phrases.phrase_spans(docs, lexicon, 3)
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
    assert all(len(r["spans"]) == 700 for r in spans.collect())


def test_joined_spans_shuffle_in_proportion(spark):
    """Rows of twice as many words carry twice the bytes into the join, not four times."""
    lexicon = spark.createDataFrame([(f"w{i}", "negative") for i in range(5)] + [("de una", "negative")], "term string, category string")

    def size(words: int) -> int:
        docs = spark.createDataFrame([(i, "la de una cosa " * (words // 4)) for i in range(4)], "doc_id int, text string")
        t = phrases._worded(docs, phrases.F.lower("text"), "[a-z]+")
        plan = phrases._joined_spans(t, lexicon, 2, ())
        plan.collect()
        found, nodes = 0, [plan._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                nodes.append(node.executedPlan())
            elif name.endswith("QueryStageExec"):
                nodes.append(node.plan())
            elif name == "ShuffleExchangeExec":
                found += node.metrics().apply("dataSize").value()
            kids = node.children()
            nodes += [kids.apply(i) for i in range(kids.size())]
        return found

    small, large = size(1000), size(4000)
    assert 0 < large < 5 * small
