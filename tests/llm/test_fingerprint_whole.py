"""Operator 4 keeps every anchor: its sketches and likeness against a plain form."""

import numpy as np

from tidemark.llm import fingerprints


def anchors(spelt):
    a = [int(spelt[i : i + 16], 16) for i in range(0, len(spelt), 16)]
    return {x >> 24: x & 0xFFFFFF for x in a}


def test_all_anchors_and_their_likeness(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    passage = draw(60)
    one, two = [*draw(1500), *passage, *draw(1500)], [*draw(1500), *passage, *draw(1500)]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(passage))]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b, c = (anchors(got[i]["fingerprint"]) for i in (1, 2, 3))
    assert len(a) > 1000 and len(c) > 15
    assert set(c) <= set(a) and set(c) <= set(b)  # a passage's anchors stand wherever it does
    far = lambda x, y: max(16, abs(max(x.values()) - max(y.values())))
    like = lambda x, y: sum(h in y and abs(p - y[h]) <= far(x, y) for h, p in x.items()) / len(set(x) | set(y))
    for i, (x, y) in {1: (a, b), 2: (b, c), 3: (c, a)}.items():
        assert abs(got[i]["near_next"] - like(x, y)) < 1e-9 and got[i]["near_next"] > 0
        assert abs(got[i]["near_edited"] - like(x, anchors(got[i]["edited_fingerprint"]))) < 1e-9
