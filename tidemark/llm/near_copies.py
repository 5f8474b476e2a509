"""Operator 9: similarity join on word n-gram Jaccard by a MinHash LSH forest and exact verification.

A text's label in a tree is a string of `deepest` bytes, one per hash function: the last byte of its
least value over the shingles. The labels of a tree, in order, are a prefix trie: a node of depth d is
the texts whose labels agree in d bytes. Matching starts with whole labels. What meets there tells, by
the agreement of its signatures, how similar linked texts are in these data, and so which share of the
links would meet in some tree at each depth; matched prefixes are shortened until that share reaches
`recall` (`chosen_depth`), at most to the depth that serves pairs which are all just at `least`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, join_spread, map_text, mix, tasks, word_hashes, words, written
from .graph import components


@dataclass(frozen=True)
class Forest:
    """shingle: words per n-gram; least: the Jaccard similarity of a link; trees and deepest: the
    forest's prefix tries; recall: the share of links wanted to meet in some tree;
    plausible: signatures' agreement below which a meeting is taken as chance; sure: the agreement
    that a pair at `least` all but surely reaches (0.8 of 256 bytes expected); block: most
    sets on a side of a verification task; node: most members of a trie node compared all with all;
    splits: functions by which a larger node's members are dealt to smaller ones; levels: most such
    splits of a node."""

    shingle: int = 5
    least: float = 0.8
    trees: int = 32
    deepest: int = 8
    recall: float = 0.99999
    plausible: float = 0.4
    sure: float = 0.625
    block: int = 512
    node: int = 1024
    splits: int = 12
    levels: int = 6

    def met(self, similarity, depth: int):
        """The chance that a pair of that similarity shares a prefix of `depth` in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    @property
    def depth(self) -> int:
        """The depth at which the recall is reached if all links are just at `least`."""
        for d in range(self.deepest, 1, -1):
            if self.met(self.least, d) >= self.recall:
                return d
        return 1


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    A text of fewer than n words is one shingle of all its words; one without words has none.
    """
    h = word_hashes(words(text))
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed multipliers (odd) and offsets of n hash functions, from a counter."""
    k = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return k[:n] | np.uint64(1), k[n:]


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        part = (s[at : at + 1024, None] ^ b) * a
        out = np.minimum(out, (part ^ (part >> np.uint64(31))).min(0))
    return out


def sketches(docs: DataFrame, p: Forest) -> DataFrame:
    """doc_id, n (shingles), set_a, set_b (a digest of the set), signature (the labels of all trees,
    p.deepest bytes each). Texts without words have n = 0."""
    a, b = permutations(p.trees * p.deepest)

    def compute(texts: list[str]) -> dict[str, object]:
        rows: dict[str, list] = {k: [] for k in ("n", "set_a", "set_b", "signature")}
        for text in texts:
            s = shingles(text, p.shingle)
            m = mix(s)
            rows["n"].append(len(s))
            rows["set_a"].append(int((m.sum(dtype=np.uint64)).view(np.int64)))
            rows["set_b"].append(int((np.bitwise_xor.reduce(mix(m)) if len(m) else np.uint64(0)).view(np.int64)))
            rows["signature"].append(signature(s, a, b).astype(np.uint8).tobytes())
        return rows

    fields = [("n", T.LongType()), ("set_a", T.LongType()), ("set_b", T.LongType()), ("signature", T.BinaryType())]
    return map_text(docs, compute, fields)


def trie_nodes(signed: DataFrame, depth: int, p: Forest) -> DataFrame:
    """rep, prefix: each text's node of that depth in every tree; signed: rep, signature."""
    labels = [F.xxhash64(F.lit(t), F.substring("signature", t * p.deepest + 1, depth)) for t in range(p.trees)]
    return signed.select("rep", F.explode(F.array(*labels)).alias("prefix"))


def chosen_depth(signed: DataFrame, p: Forest) -> int:
    """The greatest depth at which p.recall of the links meet, as whole labels show them.

    Each text that shares a whole label with others is held against the node's least one. A tie whose
    signatures agree as a link's would counts for as many links as whole labels miss for each they
    find. Without such ties the depth is p.depth.
    """
    if p.depth == p.deepest:
        return p.depth
    width = p.trees * p.deepest
    hung = trie_nodes(signed, p.deepest, p)
    lead = hung.groupBy("prefix").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("met")).where("met > 1")
    pairs = written(hung.join(lead, "prefix").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), "near-whole")
    agreed = agreement(with_signatures(pairs, signed), width).groupBy("agree").agg(F.count(F.lit(1)).alias("n"))
    seen = agreed.where(F.col("agree") >= p.least - 0.05).toPandas()  # a row per share of equal bytes: width + 1 at most
    if not len(seen):
        return p.depth
    similarity = np.clip(seen["agree"].to_numpy(), p.least, 1)
    links = seen["n"].to_numpy() / p.met(similarity, p.deepest)
    for d in range(p.deepest, p.depth, -1):
        if (links * p.met(similarity, d)).sum() >= p.recall * links.sum():
            return d
    return p.depth


def with_signatures(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Written pairs (a, b) with sig_a, sig_b; a text that leads many others is joined by broadcast."""
    return join_spread(pairs.join(signed.toDF("a", "sig_a"), "a"), signed.toDF("b", "sig_b"), "b", pairs)


def agreement(pairs: DataFrame, width: int) -> DataFrame:
    """pairs (a, b, sig_a, sig_b) with `agree`, the share of equal signature bytes."""

    def run(batches):
        for x in batches:
            one, two = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("sig_a", "sig_b"))
            agree = (one == two).mean(1) if len(one) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(agree)], names=["a", "b", "agree"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, agree double")


def node_ties(sign: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (i, j), j < i, that connect all of a node's members whose signatures agree in `least` or more."""
    out, need, group = [], least * sign.shape[1], np.arange(len(sign))
    for j in range(len(sign) - 1):
        hits = j + 1 + np.flatnonzero(np.count_nonzero(sign[j + 1 :] == sign[j], axis=1) >= need)
        fresh, at = np.unique(group[hits], return_index=True)
        new = fresh != group[j]
        if new.any():
            out += [(int(i), j) for i in hits[at[new]]]
            group[np.isin(group, fresh[new])] = group[j]
    return out


def in_blocks(members: DataFrame, size: int) -> DataFrame:
    """prefix, rep: members (prefix, rep, met) in nodes of at most about 2 * size. One of `met` members over
    `size` becomes a node for each pair of its blocks, so that any two of its members meet in one."""
    blocks = F.ceil(F.col("met") / size).cast("int")
    x = members.select("prefix", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("mine"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    node = F.xxhash64("prefix", F.least("mine", "other"), F.greatest("mine", "other"))
    return x.select(F.when(F.col("blocks") == 1, F.col("prefix")).otherwise(node).alias("prefix"), "rep")


def met_ties(hung: DataFrame, signed: DataFrame, p: Forest) -> DataFrame:
    """a, b: ties among the members (prefix, rep) of the tries' nodes; signed: rep, signature.

    A node's members are tied to its lead where they agree plausibly. Two members that agree in
    p.sure differ in their agreement with the lead by at most 1 - p.sure; so where one agrees with
    it in `near` or more, both are tied to it. The members below that are compared all with all; a
    node left with more than p.node of them is dealt to smaller ones by the values of p.splits
    functions, where a pair at p.least stays together but for (1 - p.least) ** p.splits, and led anew.
    What is still larger after p.levels is cut into blocks of p.node, each pair of which is compared.
    Small nodes share buckets of about four times p.node members.
    """
    width, near, found = p.trees * p.deepest, p.plausible + 1 - p.sure, []

    def compare(table: pa.Table) -> pa.Table:
        key, rep = table["prefix"].to_numpy(), table["rep"].to_numpy()
        sign = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(-1, width)
        order = np.lexsort((rep, key))
        key, rep, sign = key[order], rep[order], sign[order]
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        out, start = set(), 0
        for end in ends.tolist():
            out.update((int(rep[start + i]), int(rep[start + j])) for i, j in node_ties(sign[start:end], p.sure))
            start = end
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    for level in range(p.levels + 1):
        rank = F.xxhash64("prefix", "rep") if level else F.col("rep")
        lead = hung.groupBy("prefix").agg(F.min(F.struct(rank.alias("rank"), "rep"))["rep"].alias("lead"), F.count(F.lit(1)).alias("met")).where("met > 1")
        led = written(hung.join(lead, "prefix").where("rep <> lead").select("prefix", "met", F.col("rep").alias("a"), F.col("lead").alias("b")), "near-led")
        pairs = written(led.select("a", "b").distinct(), "near-pairs")
        agreed = written(agreement(with_signatures(pairs, signed), width), "near-agreed")
        found.append(agreed.where(F.col("agree") >= p.plausible).select("a", "b"))
        rest = led.where("met > 2").join(agreed.where(F.col("agree") < near), ["a", "b"]).select("prefix", F.col("a").alias("rep"))
        sizes = rest.groupBy("prefix").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
        rest = written(rest.join(sizes, "prefix"), "near-rest")
        small = in_blocks(rest, p.node) if level == p.levels else rest.where(F.col("met") <= p.node).select("prefix", "rep")
        n_buckets = max(tasks(hung, 64), small.count() // (4 * p.node))
        bucket = F.pmod(F.xxhash64("prefix"), F.lit(n_buckets)).alias("bucket")
        dealt = small.select(bucket, "prefix", "rep").join(signed, "rep").groupBy("bucket")
        found.append(written(dealt.applyInArrow(compare, "a long, b long"), "near-compared"))
        large = rest.where(F.col("met") > p.node)
        if level == p.levels or not large.take(1):
            break
        at = [(level * p.splits + i) * 7 % width for i in range(p.splits)]
        keys = F.array(*[F.xxhash64("prefix", F.lit(level), F.lit(i), F.substring("signature", i + 1, 1)) for i in at])
        hung = written(large.select("prefix", "rep").join(signed, "rep").select("rep", F.explode(keys).alias("prefix")), "near-nodes")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (or left, if None), by matrix
    products over slices of the shingles that occur in two sets or more."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right or left)), np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(left)] @ (m[len(left) :] if right else m).T
    return out


def verified(cell: list[tuple[int, int, int, np.ndarray]], across: bool, least: float) -> list[tuple[int, int, int]]:
    """Links within a cell: (rep, linked documents, least rep it is connected to).

    cell: (rep, copies, side, set). across: only pairs of side 0 and side 1 count.
    """
    cell = sorted(cell, key=lambda x: (x[2], x[0]))
    reps, copies = [x[0] for x in cell], np.array([x[1] for x in cell], np.float64)
    split = sum(x[2] == 0 for x in cell) if across else len(cell)
    sets = [x[3] for x in cell]
    if across and split in (0, len(cell)):
        return [(r, 0, r) for r in reps]
    common = overlaps(sets[:split], sets[split:] if across else None)
    size = np.array([len(s) for s in sets], np.float32)
    union = size[:split, None] + (size[split:] if across else size)[None, :] - common
    linked = common >= least * union - 1e-4
    if not across:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(cell))
    links[:split] += linked @ copies[split:] if across else linked @ copies
    if across:
        links[split:] += linked.T @ copies[:split]
    root = list(range(len(cell)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(int(i)), find(int(j) + (split if across else 0))
        if x != y:
            x, y = (x, y) if reps[x] <= reps[y] else (y, x)
            root[y] = x
    return [(r, int(n), reps[find(i)]) for i, (r, n) in enumerate(zip(reps, links.tolist(), strict=True))]


def near_copies(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """doc_id, class_id, n_links, copy_id of every document.

    n_links counts the other documents whose shingle sets have a Jaccard similarity of p.least or
    more with this one's; class_id is the least doc_id of all documents connected by links; copy_id
    the least doc_id with an equal set. Equal sets are one node from the start, and only nodes are
    compared; so groups of copies are never paired. Candidates meet in a tree of the forest; those
    whose signatures agree plausibly with a node's first, or surely with each other, join to components, and all pairs inside a component are
    verified exactly, large components in pairs of blocks. Only counts and one edge per node leave
    a verification task.

    Texts without words, null ones too, link to nothing: class_id and copy_id are their doc_id. A
    null doc_id gives nulls and 0 links. Rows of one doc_id are one document: different texts of it
    fall into one class. Other columns are dropped; an empty table gives no rows.
    """
    base = written(sketches(docs, p), "near-sketches")
    keyed = base.where("n > 0 AND doc_id IS NOT NULL")
    key = ["set_a", "set_b", "n"]
    classes = written(keyed.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-classes")
    reps = keyed.join(classes.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi")
    signed = written(reps.select(F.col("doc_id").alias("rep"), "signature").dropDuplicates(["rep"]), "near-signed")
    hung = trie_nodes(signed, chosen_depth(signed, p), p)
    groups = written(components(met_ties(hung, signed, p), "a", "b"), "near-components")

    checked = written(_verify(docs, groups, classes, p), "near-checked")
    linked = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(checked, "rep", "root")
    known = classes.join(linked, "rep", "left").join(joined.toDF("rep", "component"), "rep", "left")
    known = known.select(
        *key, "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    named = base.select("doc_id", *key).join(known, key, "left")
    has = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return named.select(
        "doc_id",
        F.when(has, F.col("component")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has, F.col("links")).otherwise(F.lit(0)).alias("n_links"),
        F.when(has, F.col("rep")).otherwise(F.col("doc_id")).alias("copy_id"),
    )


def _verify(docs: DataFrame, groups: DataFrame, classes: DataFrame, p: Forest) -> DataFrame:
    """rep, links, root of all members of candidate components, by cell."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # Small components share cells of about a block; large ones are cut into blocks, paired.
    cells = max(1, 2 * groups.count() // p.block)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / p.block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = (
        groups.join(sizes, "component")
        .join(classes.select(F.col("rep").alias("node"), "copies").groupBy("node").agg(F.sum("copies").alias("copies")), "node")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
    )
    texts = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("node"))

    def shingled(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                x = whole.slice(at, 512)
                sets = [shingles(t or "", p.shingle).tobytes() for t in x.column("text").to_pylist()]
                names = ["component", "node", "copies", "blocks", "mine"]
                yield pa.RecordBatch.from_arrays([*(x.column(n) for n in names), pa.array(sets, pa.binary())], names=[*names, "set"])

    ready = texts.select("text", "component", "node", "copies", "blocks", "mine").mapInArrow(
        shingled, "component long, node long, copies long, blocks int, mine int, set binary"
    )
    # Block m of k meets every other block: its cells are (min, max) of itself and each other.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = ready.select("*", other).select(
        "component", "node", "copies", "set",
        F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(cells))).otherwise(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other"))).alias("cell"),
        (F.col("blocks") == 1).alias("whole"),
    )

    def check(table: pa.Table) -> pa.Table:
        by: dict[tuple, dict] = {}
        columns = (table[c].to_pylist() for c in ("component", "lo", "hi", "node", "copies", "side", "set"))
        for component, lo, hi, node, copies, side, s in zip(*columns, strict=True):
            cell = by.setdefault((component, lo, hi), {})
            if (node, side) not in cell or len(s) > len(cell[node, side][3]):  # repeated rows of a doc_id
                cell[node, side] = (node, copies, side, np.frombuffer(s, np.uint64))
        out = [r for (_, lo, hi), cell in by.items() for r in verified(list(cell.values()), lo != hi, p.least)]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("rep", "links", "root"))})

    return dealt.groupBy("whole", "cell").applyInArrow(check, "rep long, links long, root long")


def keep_one(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """`docs` without the documents of a class other than its least doc_id; all columns stay."""
    name = fresh(docs, "__gone")
    gone = near_copies(docs, p).where("class_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


def op9_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))
