"""Operator 12 against a plain alignment with the libraries themselves."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.token_links import align_tokenizers, link_documents, op12_token_links


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(coders, texts):
    """The contract, one text and one byte offset at a time."""
    a, b = coders
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    found = []
    for text in texts:
        sides = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            sides.append([(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids])
            ids = b.encode(text)
            sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
        if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
            found.append([])
            continue
        ends = []
        for side in sides:
            at, own = 0, set()
            for _, x in side:
                own.add(at := at + len(x))
            ends.append(own)
        groups = {e: ([], []) for e in sorted(ends[0] & ends[1])}
        for k, side in enumerate(sides):
            at = 0
            for i, x in side:
                at += len(x)
                groups[min(e for e in groups if e >= at) if at not in groups else at][k].append(i)
        found.append(list(groups.values()))
    holds = Counter(pair for groups in found for pair in {(x, y) for g in groups for x in g[0] for y in g[1]})
    highest = defaultdict(int)
    for (x, _), n in holds.items():
        highest[x] = max(highest[x], n)
    out = []
    for groups in found:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(holds[x] == highest[x[0]] for x in links), sum(holds[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\n b\t c", "▁", "a ▁ b", "don't 12,345 x", "é ☃ 𝄞", "　 a", "<|endoftext|> </s> <0x41>", "a\x1c b \x00", "\u0085 x", "aaaa" * 3000, "word " * 5000, "x" * 400 + " y", "同じ 文 です。", "a", "don't 12,345 x"]
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limit,most", [(200_000, 1 << 19), (40, 3)])
def test_odd_rows_equal_the_plain_form(spark, coders, limit, most):
    rows = [(i // 2 if i % 5 else None, x, -1, "mine") for i, x in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int, row string").repartition(3)
    got = align_tokenizers(docs, limit=limit, digest=True, most=most).select("doc_id", "row", *NAMES).collect()
    want = Counter((r[0], "mine", *p) for r, p in zip(rows, plain(coders, ODD), strict=True))
    assert Counter(map(tuple, got)) == want


def test_query_equals_the_plain_form(spark, coders):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: p for r, p in zip(docs, plain(coders, [r.text for r in docs]), strict=True)}
    got = op12_token_links(spark, path)
    assert dict(got.dtypes) == {"doc_id": "bigint"} | dict.fromkeys(NAMES[:-1], "bigint") | {"groups_sha256": "string"}
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in got.collect()} == want


def test_groups_as_text_and_an_empty_table(spark):
    docs = spark.createDataFrame([("k", "hello hello")], "doc_id string, text string")
    r = link_documents(docs).first()
    assert r.groups.count(";") == r.n_groups - 1 and sum(r.links) == r.n_links and r.doc_id == "k"
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert align_tokenizers(empty).count() == 0
    assert align_tokenizers(docs.withColumn("text", F.lit(None).cast("string"))).select("n_a", "n_best", "groups").first() == (0, 0, "")
