"""The pipeline's stages, each against a plain form, and the whole."""

import collections
import re

import pytest

from tidemark.llm import line_runs, private_data, quality
from tidemark.llm.token_bpe import default_path, encode

from .test_contracts import prose, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def rows():
    texts = [prose(200, 500 + i) for i in range(30)]
    near = texts[1].split(" ")
    near[100] = "changed"
    near[150] = "changed"
    texts += [texts[0], texts[0], " ".join(near), texts[2] + "\n" + "short tail", prose(80, 900) + "\n" + texts[3], "mail jane.doe@example.com or +1 (988) 555-2485\n" + prose(150, 901)]
    texts += [None, "", "too short", "menu | " * 200, "same words again " * 100]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def runs_left(texts, least=50):
    """Line dedup by the definition: a line goes if it lies in a run of enough words that stands earlier too."""
    places = []
    for i, t in texts:
        lines = t.split("\n")
        worded = [(k, x) for k, x in enumerate(lines) if words(x)]
        for a in range(len(worded)):
            n = 0
            for b in range(a, len(worded)):
                n += len(words(worded[b][1]))
                if n >= least:
                    places.append(((i, worded[a][0]), tuple(x for _, x in worded[a : b + 1]), i, worded[a][0], worded[b][0]))
    first = {}
    for place, content, *_ in sorted(places):
        first.setdefault(content, place)
    gone = collections.defaultdict(set)
    for place, content, i, a, b in places:
        if place > first[content]:
            gone[i].update(range(a, b + 1))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts}


def test_stages_and_the_whole(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(path + "/documents.parquet")
    docs = spark.read.parquet(path + "/documents.parquet")
    held = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{number}")
        before, docs = {r["doc_id"]: r["text"] for r in docs.collect()}, spark.read.parquet(f"{path}/{number}")
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            held[name] = after
        if name == "quality rules":
            good = {r["doc_id"] for r in quality.quality_rules(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect() if r["kept"]}
            assert set(after) == good and set(range(30)) <= good and not good & {36, 37, 38, 39, 40}
        elif name == "line dedup":
            want = {i: t for i, t in runs_left(before.items()).items() if words(t)}
            assert after == want and 30 not in after and 31 not in after
        elif name == "n-gram Jaccard join":
            sets = {i: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} for i, t in before.items()}
            like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            assert set(after) == {i for i in before if not any(j < i and like(i, j) for j in before)}
            assert all(after[i] == before[i] for i in after)
        elif name == "PII":
            model = private_data.learn(spark.createDataFrame(list(before.items()), "doc_id long, text string"))
            assert after == {i: private_data.mask_text(t, model) for i, t in before.items()}
            assert "<EMAIL>" in after[35] and "<PHONE>" in after[35] and not re.search("jane|988", after[35])
        else:
            want = {i: len(encode(t, default_path())) + 1 for i, t in held["PII"].items()}
            tokens = collections.Counter()
            for r in docs.collect():
                tokens[r["doc_id"]] += r["length"]
            assert tokens == want and all(n > 1 for n in want.values())
    whole = corpus_pipeline.run(spark, path)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, docs.collect()))


def test_line_dedup_applies_to_its_own_output(spark):
    docs = spark.createDataFrame([(1, prose(120, 1), 5, None), (2, prose(120, 1), 6, None)], "doc_id long, text string, __runs int, __N_LINES string")
    once, n, runs = line_runs.marked(docs)
    assert len(set(map(str.lower, once.columns))) == 6
    twice, *_ = line_runs.marked(once)
    assert {r["doc_id"]: r["text"] for r in twice.collect()} == {1: prose(120, 1), 2: ""}
    assert line_runs.drop_emptied(docs).count() == 1
