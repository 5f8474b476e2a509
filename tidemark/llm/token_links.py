"""Operator 12: alignment of two tokenizers' ids over the bytes of each text, by pointer jumping."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import piece_coding, token_bpe
from .common import documents, fresh, written

#: A single space between two characters that are no white space: both tokenizers cut a text there.
CUT = re.compile(r"(?<=\S) (?=\S)")


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of two segmentations of the same bytes, numbered from 0 in order.

    a_ends, b_ends: ascending end offsets that reach the same last byte. Every token points to the
    token that reaches farthest right among those that overlap it, itself included (of two that end
    alike, to the one of the first segmentation). Doubling the pointers until they settle brings
    every token to the terminal token of its component.
    """
    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends)  # the token of B that holds the last byte of each token of A
    succ = np.concatenate(
        [np.where(b_ends[over_a] > a_ends, n + over_a, np.arange(n)), np.searchsorted(a_ends, b_ends)]
    )
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            break
        succ = further
    group = np.cumsum(succ[:n] == np.arange(n)) - 1  # terminals are tokens of A, in order
    return group[succ[:n]], group[succ[n:]]


def _runs(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1 of every i, in order."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class LinkTable:
    """Alignments of distinct chunks of text between two places where CUT finds a space.

    Both tokenizers end a token at such a place wherever it stands, so a text's alignment is that of
    its chunks in order, and each distinct chunk is encoded and aligned once. The table holds at most
    `limit` chunks: a full one is emptied, which costs repeated work, never a result.
    """

    def __init__(self, a_path: str, b_path: str, limit: int) -> None:
        self.a, self.b, self.limit = token_bpe.encoding(a_path), piece_coding.table(b_path, 1).model, limit
        a_bytes = {i: x for x, i in self.a._mergeable_ranks.items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # Ids as text with what follows them inside a group and at the end of its side.
        self.a_shown = np.array([[f"{i}," for i in range(self.n_a)], [f"{i}|" for i in range(self.n_a)]], object)
        self.b_shown = np.array([[f"{i}," for i in range(self.n_b)], [f"{i};" for i in range(self.n_b)]], object)
        self.clear()

    def _piece(self, i: int) -> bytes:
        spelt = self.b.id_to_piece(i)
        return bytes([int(spelt[3:5], 16)]) if self.b.is_byte(i) else spelt.replace("▁", " ").encode()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.shown: list[str] = []  # a chunk's groups in decimal, each followed by ";"
        self.whole = np.zeros(0, bool)  # whether both sides' bytes are the chunk's
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.at = np.zeros(1, np.int64)  # where each chunk's pairs start
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all chunks, how many each chunk has, and whether their bytes are the chunk's."""
        raw = [(" " + x).encode() for x in chunks]
        a_ids, b_ids = list(map(self.a._core_bpe.encode_ordinary, [" " + x for x in chunks])), self.b.encode(chunks, num_threads=1)
        spell_a, spell_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        whole = np.ones(len(chunks), bool)
        if not b"".join(map(spell_a, chain.from_iterable(a_ids))) == b"".join(map(spell_b, chain.from_iterable(b_ids))) == b"".join(raw):
            whole[:] = [b"".join(map(spell_a, a)) == b"".join(map(spell_b, b)) == x for a, b, x in zip(a_ids, b_ids, raw, strict=True)]
            a_ids, b_ids = [[x if w else [] for x, w in zip(y, whole, strict=True)] for y in (a_ids, b_ids)]
        many = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(m.sum())) for x, m in zip((a_ids, b_ids), many, strict=True))
        return a, b, *many, whole

    def _add(self, new: list[str]) -> None:
        """Encodes and aligns chunks that the table does not hold, all at once."""
        if not new:
            return
        a, b, many_a, many_b, whole = self._encode(new)
        counts = np.zeros((len(new), 4), np.int64)
        counts[:, 0], counts[:, 1] = many_a, many_b
        many, pairs, times = np.zeros(len(new), np.int64), a[:0], a[:0]
        if len(a):
            ga, gb = terminals(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]))
            in_a, in_b = np.bincount(ga), np.bincount(gb)
            last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
            chunk = np.repeat(np.arange(len(new)), many_a)[last_a]  # of each group
            counts[:, 2] = np.bincount(chunk, minlength=len(new))
            np.add.at(counts[:, 3], chunk, in_a * in_b)
            # Distinct ids of each group first, so that a long group of few ids makes few pairs.
            ka, ta = _runs(ga * self.n_a + a, np.ones(len(a), np.int64))
            kb, tb = _runs(gb * self.n_b + b, np.ones(len(b), np.int64))
            group, per_group = ka // self.n_a, np.bincount(kb // self.n_b)
            right = _spread((np.cumsum(per_group) - per_group)[group], per_group[group])
            left = np.repeat(np.arange(len(ka)), per_group[group])
            pair = ka[left] % self.n_a * self.n_b + kb[right] % self.n_b
            key, times = _runs(chunk[group[left]] * (self.n_a * self.n_b) + pair, ta[left] * tb[right])
            many, pairs = np.bincount(key // (self.n_a * self.n_b), minlength=len(new)), key % (self.n_a * self.n_b)
            # Groups as text: the tokens of A of a group, then those of B, then the next group's.
            parts = np.empty(len(a) + len(b), object)
            end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            end_a[last_a], end_b[last_b] = 1, 1
            parts[np.arange(len(a)) + (last_b - in_b + 1)[ga]] = self.a_shown[end_a, a]
            parts[np.arange(len(b)) + (last_a + 1)[gb]] = self.b_shown[end_b, b]
            ends, parts, join = np.cumsum(many_a + many_b).tolist(), parts.tolist(), "".join
            self.shown += [join(parts[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
        else:
            self.shown += [""] * len(new)
        self.code.update(zip(new, range(len(self.whole), len(self.shown)), strict=True))
        self.whole, self.counts = np.concatenate([self.whole, whole]), np.concatenate([self.counts, counts])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(many)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's chunks in the table; none for a text without tokens."""
        cut = [CUT.split(x) if x else [] for x in texts]
        distinct = set(chain.from_iterable(cut))
        if len(self.code) + len(distinct) > self.limit:
            self.clear()
        self._add([x for x in distinct if x not in self.code])
        got, number = [], self.code.__getitem__
        for text, chunks in zip(texts, cut, strict=True):
            codes = np.fromiter(map(number, chunks), np.int64, len(chunks))
            if not self.whole[codes].all() and len(chunks) > 1:
                # Bytes that differ chunk by chunk could still agree over the whole text.
                if text not in self.code:
                    self._add([text])
                codes = np.array([number(text)])
            got.append(codes if self.whole[codes].all() else codes[:0])
        return got

    def link(self, texts: list[str], digest: bool = False) -> dict[str, pa.Array]:
        """The columns of `link_documents` for some texts."""
        found = self.codes(texts)
        codes, text_of = np.concatenate([np.zeros(0, np.int64), *found]), np.repeat(np.arange(len(texts)), [len(c) for c in found])
        sums = np.zeros((len(texts), 4), np.int64)
        np.add.at(sums, text_of, self.counts[codes])
        held, space = max(1, len(self.shown)), self.n_a * self.n_b
        key, times = _runs(text_of * held + codes, np.ones(len(codes), np.int64))
        many = (self.at[1:] - self.at[:-1])[key % held] if len(key) else key
        place = _spread(self.at[key % held], many)
        key, links = _runs(np.repeat(key // held, many) * space + self.pairs[place], np.repeat(times, many) * self.times[place])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(key // space, minlength=len(texts)))]).astype(np.int32)
        groups = ["".join(map(self.shown.__getitem__, c.tolist()))[:-1] for c in found]
        if digest:
            groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
        return {
            **{name: pa.array(sums[:, i]) for i, name in enumerate(COUNTS)},
            "groups_sha256" if digest else "groups": pa.array(groups, pa.string()),
            "pairs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(key % space)),
            "links": pa.ListArray.from_arrays(pa.array(offsets), pa.array(links)),
        }


@lru_cache(maxsize=1)
def link_table(a_path: str, b_path: str, limit: int) -> LinkTable:
    return LinkTable(a_path, b_path, limit)


def link_documents(docs: DataFrame, a: str | None = None, b: str | None = None, limit: int = 200_000, digest: bool = False) -> DataFrame:
    """The columns of `docs` but for its text, and the alignment of each text's ids by two tokenizers.

    a: a byte-level BPE file, applied to a space and the text; b: a sentencepiece model, which puts
    that space itself. n_a, n_b, n_groups, n_links: tokens, groups between the byte offsets where both
    end a token, and pairs of occurrences that share a group. groups: ids as `a1,a2|b1;a3|b2,b3` (with
    `digest` its SHA-256 in hex as groups_sha256). pairs, links: each distinct id pair that is linked,
    as id of A times the pieces of B plus id of B, ascending, and how many links it has.
    Null and empty texts, and those whose tokens' bytes are not the text's, have no tokens: zeros, ""
    and empty arrays. Rows stay as they are, repeated ones and null ids too; a text is aligned whole.
    Columns of `docs` that bear one of these names are left out.
    """
    path_a, path_b = a or token_bpe.default_path(), b or piece_coding.default_path()
    groups = "groups_sha256" if digest else "groups"
    longs = T.ArrayType(T.LongType())
    made = T.StructType([T.StructField(n, T.LongType()) for n in COUNTS] + [T.StructField(groups, T.StringType()), T.StructField("pairs", longs), T.StructField("links", longs)])
    keep = [c for c in docs.columns if c != "text" and c.lower() not in {x.lower() for x in made.names}]
    schema = T.StructType([docs.schema[c] for c in keep] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                got = link_table(path_a, path_b, limit).link([x or "" for x in batch.column(batch.num_columns - 1).to_pylist()], digest)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [got[n] for n in made.names], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(run, schema)


def pair_counts(linked: DataFrame, pieces: int) -> DataFrame:
    """pair, n, best: how many rows of `linked` hold a pair, and whether no pair of its id of A has more."""
    counts = written(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    of_a = F.floor(F.col("pair") / pieces)
    highest = counts.groupBy(of_a.alias("of_a")).agg(F.max("n").alias("highest"))  # at most the ids of A, hence broadcast
    return counts.withColumn("of_a", of_a).join(F.broadcast(highest), "of_a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def link_agreement(linked: DataFrame, row: str, pieces: int, most: int = 1 << 19) -> DataFrame:
    """`linked`, a written table, without pairs and links, and with n_best and count_sum.

    row: the column that tells its rows apart, which is dropped.
    n_best: a row's links whose pair is held by as many rows as any pair of its id of A; count_sum: over
    a row's links, how many rows hold the pair. The pairs that most rows hold, at most `most`, are
    broadcast; the others, each of which few rows hold, are joined by a shuffle.
    """
    counts = written(pair_counts(linked, pieces), "pair-table")
    power = F.floor(F.log2("n")).cast("int")
    held, least = 0, 64
    for r in sorted(counts.groupBy(power.alias("power")).count().collect(), reverse=True):  # at most 64 rows
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["power"]
    links = linked.select(row, F.inline(F.arrays_zip("pairs", "links")).alias("pair", "times"))
    hot = F.broadcast(counts.where(power >= least))
    found = links.join(hot, "pair")
    if held < counts.count():
        found = found.unionByName(links.join(hot, "pair", "left_anti").join(counts.where(power < least), "pair"))
    sums = found.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return linked.drop("pairs", "links").join(sums, row, "left").select(*[c for c in linked.columns if c not in ("pairs", "links", row)], *zero)


def align_tokenizers(docs: DataFrame, a: str | None = None, b: str | None = None, limit: int = 200_000, digest: bool = False, most: int = 1 << 19) -> DataFrame:
    """`link_documents` and `link_agreement` of the same rows; columns named like theirs are left out."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_best", "count_sum")])
    linked = link_documents(docs, a, b, limit, digest)
    row = fresh(linked, "row")
    pieces = piece_coding.table(b or piece_coding.default_path(), 1).model.get_piece_size()
    return link_agreement(written(linked.withColumn(row, F.monotonically_increasing_id()), "links"), row, pieces, most)


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
