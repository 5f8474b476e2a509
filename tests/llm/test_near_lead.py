"""Near copies in trie nodes that a stranger leads."""

import numpy as np

from tidemark.llm import near_copies

#: Nodes left with more than 4 members are split here.
SMALL = {"node": 4, "levels": 1}


def test_pairs_that_meet_behind_a_strange_lead_are_linked(spark):
    lines = [[f"l{i}w{j}" for j in range(12)] for i in range(24)]
    rng = np.random.default_rng(2)

    def drawn(i, own):
        return [w for j in rng.choice(24, 3, replace=False) for w in lines[j]] + [f"own{i}w{j}" for j in range(own)]

    rows = [(i, " ".join(drawn(i, 40))) for i in range(200)]
    for i in range(60):
        words = drawn(1000 + i, 20)
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join([*words[:-3], "x", "y", "z"]))]
    p = near_copies.Forest(trees=4, deepest=2, recall=0.5, **SMALL)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(docs, p).collect()}
    a, b = near_copies.permutations(p.trees * p.depth)
    sets = {i: near_copies.shingles(t, p.shingle) for i, t in rows}
    met = lost = 0
    for i in range(1000, 1120, 2):
        x, y = (near_copies.signature(sets[j], a, b) for j in (i, i + 1))
        shared = (x == y).reshape(p.trees, p.depth).all(1).any() and (x == y).mean() >= 0.625
        if shared and len(np.intersect1d(sets[i], sets[i + 1])) >= 0.8 * len(np.union1d(sets[i], sets[i + 1])):
            met += 1
            lost += links[i] != links[i + 1]
    assert met == 60 and not lost, (met, lost)


def test_node_ties_connect_what_agrees():
    sign = np.array([[0] * 8, [1] * 8, [1] * 6 + [2] * 2, [1] * 5 + [2] * 3, [3] * 8, [3] * 7 + [4]], np.uint8)
    assert near_copies.node_ties(sign, 0.75) == [(2, 1), (3, 2), (5, 4)]


def test_blocks_bring_any_two_members_together(spark):
    rows = [(7, i, 30) for i in range(30)] + [(8, i, 3) for i in range(3)]
    got = near_copies.in_blocks(spark.createDataFrame(rows, "prefix long, rep long, met long"), 4).collect()
    nodes: dict[int, set[int]] = {}
    for r in got:
        nodes.setdefault(r["prefix"], set()).add(r["rep"])
    assert nodes[8] == {0, 1, 2} and max(map(len, nodes.values())) < 20
    together = {(a, b) for members in nodes.values() for a in members for b in members}
    assert all((a, b) in together for a in range(30) for b in range(30))
