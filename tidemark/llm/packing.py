"""Operator 3: packing documents into sequences of bounded length, best fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow, documents, map_text  # noqa: F401
from .token_bpe import default_path, encode


class OpenWindows:
    """Open sequences by remaining capacity: a segment tree over capacities 0..size.

    A node holds how many open windows its range of capacities has; `tightest(n)` descends to the
    least capacity of n or more that has one. Windows of one capacity are a stack.
    """

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        self._add(capacity, 1)

    def pop(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.stacks[capacity].pop()

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need with an open window, or None."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1 and (at & 1 or not self.count[at + 1]):  # up until a right neighbour has some
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:  # down to its leftmost
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are taken longest first, ties in order given."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, made = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = opened.tightest(n)
        if capacity is None:
            window[i], capacity, made = made, size, made + 1
        else:
            window[i] = opened.pop(capacity)
        offset[i] = size - capacity
        if capacity > n:
            opened.push(capacity - n, int(window[i]))
    return window, offset


def pack(
    docs: DataFrame,
    size: int = 2048,
    end_id: int = 1,
    tokenizer: str | None = None,
    docs_per_shard: int = 1024,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset and, unless
    with_ids is false, ids (binary, little-endian uint32), which then need not be shuffled.

    A document is its ids and `end_id`. It is cut into full windows of `size` ids, which are
    sequences by themselves, and a rest, which best fit decreasing places. Documents are dealt by a
    hash of (doc_id, text) to shards of about `docs_per_shard`; each shard is packed alone, so
    memory and time per task are bounded at any corpus size and at most one loosely filled
    sequence or two per shard is the price. sequence_id is shard * 2**32 + the window's number.

    Null or empty texts are a single end id. Repeated rows are packed each by itself. A null doc_id
    stays null. Other columns are dropped. Empty tables give no rows. ids are never split between
    pieces. A sequence is padded to `size`, unless its length is a power of two.
    """
    path = tokenizer or default_path()
    shards = max(1, -(-docs.count() // docs_per_shard))
    id_type = docs.schema["doc_id"].dataType
    cut = f"doc_id {id_type.simpleString()}, shard long, start long, doc_tokens long, length long, ids_crc32 long"
    cut += ", ids binary" if with_ids else ""
    id_arrow = _arrow(id_type)

    def pieces(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = ([], [], [], [], [], [], [])
                for doc, shard, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    ids = np.append(encode(text or "", path), np.array([end_id], "<u4"))
                    for start in range(0, len(ids), size):
                        part = ids[start : start + size]
                        for column, x in zip(out, (doc, shard, start, len(ids), len(part), zlib.crc32(part), part.tobytes()), strict=True):
                            column.append(x)
                names = ["doc_id", "shard", "start", "doc_tokens", "length", "ids_crc32"]
                arrays = [pa.array(out[0], id_arrow), *(pa.array(c, pa.int64()) for c in out[1:6])]
                if with_ids:
                    names, arrays = [*names, "ids"], [*arrays, pa.array(out[6], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    def place(table: pa.Table) -> pa.Table:
        # Within a shard rows come in any order; a fixed one makes a recomputed task place alike.
        table = table.combine_chunks()
        known = [zlib.crc32(repr(x).encode()) for x in table["doc_id"].to_pylist()]
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["doc_tokens"].to_numpy(), table["start"].to_numpy(), known))
        table = table.take(pa.array(order))
        window, offset = best_fit_decreasing(table["length"].to_numpy(), size)
        shard = table["shard"].to_numpy()
        placed = {"sequence_id": pa.array((shard << np.int64(32)) + window), "offset": pa.array(offset)}
        return pa.table({c: table[c] for c in ("doc_id", "start", "length", "doc_tokens", "ids_crc32")} | placed | ({"ids": table["ids"]} if with_ids else {}))

    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    out = f"doc_id {id_type.simpleString()}, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, offset long"
    out += ", ids binary" if with_ids else ""
    return docs.select("doc_id", shard.alias("shard"), "text").mapInArrow(pieces, cut).groupBy("shard").applyInArrow(place, out)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir), with_ids=False))
