"""The registered queries against brute force, on a table of odd rows: nulls, empty and very long texts,
ties, repeated rows, other columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import near_copies, packing, quality, seating, toxicity
from tidemark.llm import queries as llm
from tidemark.llm.token_bpe import default_path

RNG = np.random.default_rng(11)
VOCABULARY = ["".join(RNG.choice(list("etaoinshrdlucmfw"), RNG.integers(2, 9))) for _ in range(900)]


def prose(n, seed):
    g = np.random.default_rng(seed)
    words = [VOCABULARY[int(i)] for i in (g.random(n) ** 2 * len(VOCABULARY)).astype(int)]
    return "\n".join(" ".join(words[i : i + 14]) for i in range(0, n, 14))


def rows():
    texts = [prose(int(60 + 40 * (i % 7)), i) for i in range(60)]
    texts += [texts[3], texts[3], texts[4] + " more words here", texts[5][: len(texts[5]) // 2] + "\n" + texts[6]]
    texts += [None, "", " \n\t ", "one", "# $ % & | < > *", "x" * 9000, "same line here\n" * 40, prose(30_000, 99), "é ß 漢字 ▁ " * 30, texts[7].upper(), "scum " * 4 + texts[8]]
    found = [(i, t, ("en", None)[i % 5 == 0], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*found, found[2]]  # a repeated row


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path + "/documents.parquet")
    labels = [(i, 1, int("scum" in (t or "")) if i % 2 else None) for i, t, *_ in data[:-1]] + [(1, 0, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path, data


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def got(spark, name, path):
    return llm.QUERIES[name](spark, path).collect()


def test_op1(spark, table):
    path, data = table
    out = got(spark, "op1_compression_bands", path)
    assert len(out) == len(data)
    texts = {i: t for i, t, *_ in data}
    for r in out:
        t = texts[r["doc_id"]] or ""
        ws = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        repeat = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        want = (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(repeat) > 50 * len(ws))
        assert not (r["base_failed"] and r["kept"])
        raw = t.encode()
        if raw:
            import zstandard

            ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
            assert r["ratio"] == pytest.approx(ratio(raw))
            bands, parts = quality.Bands(), [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
            parts = parts[:-1] if len(parts) > 1 and len(parts[-1]) < 2048 else parts
            bad = sum(bands.outside(ratio(p), len(p)) for p in parts)
            assert (r["n_chunks"], r["n_bad_chunks"]) == (len(parts), bad)
            assert r["kept"] == (not r["base_failed"] and not bands.outside(ratio(raw), len(raw)) and 2 * bad <= len(parts))
    assert sum(r["kept"] for r in out) > 40


def test_op2_op3_op7_hold_each_id(spark, table):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path, data = table
    bpe = Tokenizer.from_file(default_path())
    ids = {i: bpe.encode(t or "", add_special_tokens=False).ids for i, t, *_ in data}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    out = got(spark, "op3_pack_best_fit", path)
    taken, windows = collections.Counter(), collections.defaultdict(list)
    for r in out:
        whole = [*ids[r["doc_id"]], 1]
        part = whole[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(whole) and len(part) == r["length"] and crc(part) == r["ids_crc32"]
        taken[r["doc_id"]] += r["length"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = collections.Counter(i for i, *_ in data)
    assert taken == {i: n * (len(ids[i]) + 1) for i, n in copies.items()}
    for pieces in windows.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(windows) <= sum(taken.values()) / 2048 + 2  # tightly filled

    order = sorted(data, key=lambda r: r[0])
    starts = np.cumsum([0, *[len(ids[i]) + 1 for i, *_ in order]])
    want = sorted((i, int(s), len(ids[i]) + 1, crc([*ids[i], 2])) for (i, *_), s in zip(order, starts))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got(spark, "op7_token_planes", path)) == want

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    spelt = {i: model.encode(t or "") for i, t, *_ in data}
    want = sorted((i, len(spelt[i]), sha(",".join(map(str, spelt[i]))), sha(model.decode(spelt[i]))) for i, *_ in data)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got(spark, "op2_sentencepiece_chunks", path)) == want


def test_best_fit_takes_the_tightest_window():
    g = np.random.default_rng(5)
    lengths = g.integers(1, 60, 400)
    window, offset = packing.best_fit_decreasing(lengths, 64)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [c for c in room if c >= lengths[i]]
        used = 64 - int(offset[i])
        assert used == (min(fits) if fits else 64)
        if fits:
            room.remove(min(fits))
        room.append(used - int(lengths[i]))


def test_op4_edits(spark, table):
    path, data = table
    out = got(spark, "op4_closed_syncmers", path)
    assert len(out) == len(data)
    texts = {i: t or "" for i, t, *_ in data}
    ids = sorted(texts)
    for r in out:
        i = r["doc_id"]
        t, after = texts[i], texts[ids[(ids.index(i) + 1) % len(ids)]]
        if i == 2:
            after = t if r["near_next"] == 1.0 else after  # the repeated row follows its like
        q = len(t) // 4
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest(), i
    by = collections.defaultdict(set)
    for r in out:
        by[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    long = [r for r in out if 500 < r["n_chars"] < 100_000 and r["doc_id"] < 60]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9


def direct_seating(pairs, strength, discount, parent, sweeps, rng):
    """A plain Chinese-restaurant sampler of one restaurant: table sizes by word, one customer at a time."""
    tables = {w: [c] for w, c in pairs.items() if c}
    seen = collections.Counter()
    for k in range(sweeps):
        for w, c in pairs.items():
            for _ in range(c):
                t = tables[w]
                j = rng.choice(len(t), p=np.array(t) / sum(t))
                t[j] -= 1
                if not t[j]:
                    t.pop(j)
                total = sum(map(len, tables.values()))
                weight = np.array([*(n - discount for n in t), (strength + discount * total) * parent[w]])
                j = rng.choice(len(weight), p=weight / weight.sum())
                if j == len(t):
                    t.append(1)
                else:
                    t[j] += 1
        if k >= sweeps // 5:
            for w, t in tables.items():
                seen[w, len(t)] += 1
    return seen


def test_op6_draws_tables_as_a_direct_sampler(spark):
    rng = np.random.default_rng(7)
    seen = direct_seating({"a": 6}, 1.0, 0.6, {"a": 0.3}, 4000, rng)
    own = collections.Counter()
    tables = seating.seats(np.full(4000, 6), 0.6, np.full(4000, 1.0), np.full(4000, 0.3), rng)
    own.update(tables.tolist())
    for t in range(1, 7):
        assert own[t] / 4000 == pytest.approx(seen["a", t] / 3200, abs=0.04)


class FakeBucket:
    """All pairs of a small model in one bucket."""

    def __init__(self, c):
        self.word, self.context = (x.ravel() for x in np.indices(c.shape))
        self.c = c.ravel().astype(np.int64)
        self.words = np.arange(c.shape[0])
        self.of_word = c.sum(1)


def test_op6_predictions_sum_to_one():
    rng = np.random.default_rng(2)
    b = FakeBucket(rng.poisson(3, (40, 5)) * rng.integers(0, 2, (40, 5)))
    p, history, v = seating.Seating(), [], 40
    for _ in range(3):
        *_, (tables, t, s) = seating.sweep_states(b, 1, history, p)
        n = lambda x: np.bincount(b.context, weights=x, minlength=5)
        history.append(seating.Totals(n(b.c), n(tables), float(t.sum()), float(s.sum()), (0.6, 0.7), v))
        x = history[-1]
        known = seating.parent_chance(t, s, x, 1.0).sum()
        unknown = (1.0 + 0.7 * x.parent_tables) / (v + 1) / (1.0 + x.parent_customers)
        assert known + unknown == pytest.approx(1)
        context = np.maximum(b.c - 0.6 * tables, 0) + (1.0 + 0.6 * x.tables[b.context]) * seating.parent_chance(t, s, x, 1.0)[b.word]
        total = np.bincount(b.context, weights=context / (1.0 + x.customers[b.context]), minlength=5)
        left = (1.0 + 0.6 * x.tables) * unknown / (1.0 + x.customers)
        assert np.allclose(total + left, 1)


def test_op6(spark, table):
    path, data = table
    out = got(spark, "op6_pitman_yor", path)
    assert len(out) == len(data)
    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t, *_ in data if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    texts = {i: t for i, t, *_ in data}
    for r in out:
        ws = split(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    free = [r for r in out if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in free) > sum(r["base_score"] for r in free)


def test_op9(spark, table):
    path, data = table
    sets = {}
    for i, t, *_ in data:
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    near = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    out = got(spark, "op9_jaccard_forest", path)
    assert len(out) == len(data)
    for r in out:
        seen, todo = {r["doc_id"]}, [r["doc_id"]]
        while todo:
            todo += [j for j in near[todo.pop()] - seen if not seen.add(j)]
        assert r["class_id"] == min(seen), r["doc_id"]
        if r["doc_id"] != 2 and 2 not in near[r["doc_id"]]:  # a repeated row counts as another copy
            assert r["n_links"] == len(near[r["doc_id"]])


def test_op9_shortens_prefixes_until_the_recall(spark):
    base = [prose(200, 1000 + i).split() for i in range(40)]
    close = [(2 * i + k, " ".join(w if k == 0 else [*w[:-1], "end"])) for i, w in enumerate(base) for k in (0, 1)]
    far = [(2 * i + k, " ".join(w if k == 0 else [*w[:-20], *(f"o{i}x{j}" for j in range(20))])) for i, w in enumerate(base) for k in (0, 1)]
    p = near_copies.Forest()
    depth = {}
    for name, texts in (("close", close), ("far", far)):
        signed = near_copies.sketches(spark.createDataFrame(texts, "doc_id long, text string"), p).selectExpr("doc_id AS rep", "signature")
        depth[name] = near_copies.chosen_depth(signed, p)
    assert depth["close"] == p.deepest and p.depth <= depth["far"] < p.deepest


def test_op10(spark, table):
    path, data = table
    out = got(spark, "op10_toxicity_ftrl", path)
    assert len(out) == len(data)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def direct_ftrl(rows, p):
    """The update written per coordinate with dictionaries."""
    z, n, l1 = collections.Counter(), collections.Counter(), p.l1
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    for _ in range(p.epochs):
        for text, y in rows:
            x = toxicity.features(text, p.bits).tolist()
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_op10_weights_equal_the_plain_update():
    rows = [("scum " * (i % 3 == 0) + prose(12, i), int(i % 3 == 0)) for i in range(60)]
    p = toxicity.Ftrl()
    slots, w = toxicity.fit(rows, p)
    want = direct_ftrl(rows, p)
    assert sorted(want) == sorted(slots.tolist()) and np.allclose(w, [want[i] for i in slots.tolist()])


def test_op10_without_labels_calls_nothing_toxic(spark, table):
    path, _ = table
    docs = spark.read.parquet(path + "/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    p = toxicity.Ftrl()
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, none, p), p.bits)
    assert scored.where("predicted = 1").count() == 0


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(path + "/embeddings.parquet")
    for name, query in llm.QUERIES.items():
        assert query(spark, path).count() == 0, name


def plain_spans(text):
    """The base kinds by the contract's own patterns, leftmost and not overlapping per kind."""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    )
    found = [(m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m[0])]
    return [(name, s, e) for s, k, e, name in sorted(found)]


def test_op5(spark, tmp_path):
    g = np.random.default_rng(4)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1", "4041894974608795", "4041 8949 7460 8796", "+1 (988) 555-2485", "+12", "é 漢", "jane [at] example.com", "12-", ".", "\n", " "]
    texts = ["".join(g.choice(parts, 25)) for _ in range(120)] + [None, "", "\x00 a@b.c"] + [" ".join(g.choice(parts, 4000))]
    rows5 = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2)]
    spark.createDataFrame(rows5, "doc_id long, text string, spans int").write.parquet(str(tmp_path) + "/documents.parquet")
    out = got(spark, "op5_private_spans", str(tmp_path))
    assert len(out) == len(rows5)
    for r in out:
        want = plain_spans(texts[r["doc_id"]] or "")
        counts = collections.Counter(k for k, *_ in want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        spelt = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(spelt).encode()).hexdigest()
        assert set(spelt) <= set(r["spans"].split(",")) if spelt else True
