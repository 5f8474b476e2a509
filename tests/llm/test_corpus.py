"""The corpus operators against brute force, on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import fingerprints, line_runs, near_copies, packing, piece_coding, private_data, quality, seating, token_files, toxicity
from tidemark.llm.common import shared_dir
from tidemark.llm.token_bpe import default_path, encode

BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("word30", "other")), (4, None), (5, ""), (6, "a b c"), (7, "a b c"),
    (8, "head line\n" + BASE + "\ntail"), (9, "Mail x.y@mail.example.com or +1 (988) 555-2485, 78.118.65.158, 4041894974608795 é"),
    (10, "  two  spaces ▁ and <|endoftext|> \t\n tabs é漢字 "), (11, "long " * 3000), (12, "x" * 5000), (None, "no id " * 30), (13, BASE), (13, "same id, other text"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n string")


def test_bpe_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_path())
    rng = np.random.default_rng(1)
    random = ["".join(map(chr, rng.choice([32, 9, 10, 39, 65, 97, 233, 0x6F22, 0x1F600, 48, 0x2581], 60))) for _ in range(300)]
    for text in [t or "" for _, t in TEXTS] + random:
        assert encode(text, default_path()).tolist() == own.encode(text, add_special_tokens=False).ids


def test_pieces_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_coding.default_path())
    want = sorted((hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(model.decode(i).encode()).hexdigest()) for i in (model.encode(t or "") for _, t in TEXTS))
    got = piece_coding.coding_digest(docs).collect()
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_packing_places_each_id_once(docs):
    got = packing.pack(docs, size=64).collect()
    whole = collections.defaultdict(int)
    used = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        whole[r["doc_id"]] += r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.defaultdict(int)
    for i, t in TEXTS:
        want[i] += len(encode(t or "", default_path())) + 1
    assert whole == want
    for pieces in used.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64


def test_token_files_round_trip(spark, docs):
    for kind in ("byte", "bit"):
        path = shared_dir(spark, "test")
        token_files.write_tokens(docs, path, block_ids=50, kind=kind, parts=3)
        got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(spark, path).collect())
        assert len(got) == len(TEXTS)
        assert [s for s, _, _ in got] == np.concatenate([[0], np.cumsum([n for _, n, _ in got])[:-1]]).tolist()
        crcs = collections.Counter(zlib.crc32(np.append(encode(t or "", default_path()), np.array([2], "<u4")).tobytes()) for _, t in TEXTS)
        assert collections.Counter(c for _, _, c in got) == crcs


def test_fingerprints_agree_for_equal_texts(docs):
    got = fingerprints.fingerprint(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (13, None)}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[4]["fingerprint"] == by[5]["fingerprint"] and by[4]["n_chars"] == 0
    edited = BASE[: len(BASE) - len(BASE) // 4] + BASE.replace("word30", "other")[: len(BASE) // 4]
    assert by[2]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_line_runs_leave_the_first_copy(spark, docs):
    got = {r["doc_id"]: r["text"] for r in line_runs.delete_line_runs(docs).collect() if r["doc_id"] not in (13, None)}
    assert got[1] == BASE and got[2] == "" and got[8] == "head line\ntail" and got[4] is None and got[6] == "a b c"


def test_near_copies_equal_brute_force(docs):
    got = {r["doc_id"]: r for r in near_copies.near_copies(docs.where("doc_id < 13 OR doc_id IS NULL")).collect()}
    sets = {}
    for i, t in TEXTS:
        w = (t or "").split()
        if w and i is not None and i < 13:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    for i, a in sets.items():
        links = sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in sets.items())
        assert got[i]["n_links"] == links, i
    assert got[3]["class_id"] == 1 and got[7]["class_id"] == 6 and got[4]["class_id"] == 4 and got[None]["class_id"] is None


def test_private_spans_equal_plain_patterns():
    text = TEXTS[8][1]
    kinds = [k for _, _, k in private_data.base_spans(text)]
    assert kinds == ["email", "phone", "ip", "card"]
    masked = private_data.mask_text(text, private_data.fit_model([]))
    assert not re.search("[0-9]{3}", masked) and masked.startswith("Mail <EMAIL> or <PHONE>")


def test_quality_counts(spark, docs):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and not got[4]["kept"]
    assert got[11]["n_repeat_words"] == 3000 and got[11]["base_failed"]
    rng = np.random.default_rng(2)
    plain = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(300))
    measured = spark.createDataFrame([(1, plain), (2, "menu | " * 300)], "doc_id long, text string")
    assert [r["kept"] for r in quality.quality_rules(measured).orderBy("doc_id").collect()] == [True, False]
    assert quality.keep_good(docs).columns == docs.columns


def test_seating_base_scores(docs):
    got = seating.score_texts(docs, seating.Seating(hot=5, contexts=2, least_buckets=4)).collect()
    assert len(got) == len(TEXTS)
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in TEXTS if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)) for _, t in TEXTS)
    assert np.allclose(sorted(r["base_score"] for r in got), want) and all(r["score"] < 0 for r in got)


def test_toxicity_learns_a_word(spark):
    rows = [(i, ("scum " if i % 3 == 0 else "") + " ".join(f"w{i * j % 97}" for j in range(1, 20)), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    p = toxicity.Ftrl()
    got = toxicity.score_toxicity(docs, toxicity.train(docs, docs.select("doc_id", "toxic"), p), p.bits).where("held_out").collect()
    assert got and all((r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in got)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert not near_copies.near_copies(none).count() and not packing.pack(none).count() and not fingerprints.fingerprint(none).count()
    assert not seating.score_texts(none).count() and not line_runs.delete_line_runs(none).count() and not quality.quality_rules(none).count()
