"""Operator 7: token-id files of bit-plane (or byte-plane) shuffled, zstandard-compressed blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow, documents, shared_dir, tasks
from .token_bpe import default_path, encode

#: The file format: a Parquet file per part, a row per block, blocks in order. `planes` holds each
#: plane's own zstandard frame; `docs` is the chunk index: documents that have ids in the block.
BLOCK = (
    "part int, block long, first long, n_ids int, kind string, planes array<binary>, "
    "docs array<struct<row: long, start: long, n_tokens: long>>, doc_ids array<{id}>"
)


def shuffle_planes(ids: np.ndarray, kind: str, level: int = 3) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first, each compressed; planes of zeros are b""."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        planes = octets
    else:
        planes = [np.packbits((octets[b // 8] >> np.uint8(b % 8)) & np.uint8(1)) for b in range(32)]
    return [compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]


def unshuffle_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The uint32 ids of a block; the exact inverse of shuffle_planes."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    octets = np.zeros((4, n), np.uint8)
    for i, p in enumerate(planes):
        if p:
            plane = np.frombuffer(expand(p), np.uint8)
            if kind == "byte":
                octets[i] = plane
            else:
                octets[i // 8] |= np.unpackbits(plane, count=n) << np.uint8(i % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


def write_tokens(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    tokenizer: str | None = None,
    block_ids: int = 65536,
    kind: str = "byte",
    parts: int | None = None,
) -> None:
    """Write the ids of `docs`, each document closed by `end_id`, in ascending doc_id order.

    The texts are range-partitioned by doc_id (equal ids by a hash of the text), so that parts
    follow each other; within a part ids run on through blocks of `block_ids`, whatever the
    documents' bounds. Spark's committer makes the write atomic; a lost task is redone alone.
    Null texts are empty ones (the end id alone); null ids come first; repeated rows are kept;
    an empty table gives files without rows. kind: "byte" (4 planes) or "bit" (32 planes).
    """
    source = tokenizer or default_path()
    id_type = docs.schema["doc_id"].dataType
    id_arrow = _arrow(id_type)
    struct = pa.struct([("row", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def blocks(batches):
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        spans: list[tuple[int, int, int]] = []  # documents with ids not yet written: row, start, n
        ids_of: list[object] = []
        have, first, row, end = 0, 0, 0, 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal held, have, first, spans, ids_of
            ids = np.concatenate(held)
            held, have = ([ids[n:]] if len(ids) > n else []), len(ids) - n
            inside = [i for i, (_, start, _) in enumerate(spans) if start < first + n]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([first // block_ids], pa.int64()), pa.array([first], pa.int64()),
                    pa.array([n], pa.int32()), pa.array([kind]), pa.array([shuffle_planes(ids[:n], kind)], pa.list_(pa.binary())),
                    pa.array([[dict(zip(("row", "start", "n_tokens"), spans[i], strict=True)) for i in inside]], pa.list_(struct)),
                    pa.array([[ids_of[i] for i in inside]], pa.list_(id_arrow)),
                ],
                names=["part", "block", "first", "n_ids", "kind", "planes", "docs", "doc_ids"],
            )
            first += n
            on = [i for i, (_, start, size) in enumerate(spans) if start + size > first]
            spans, ids_of = [spans[i] for i in on], [ids_of[i] for i in on]
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", source), np.array([end_id], "<u4"))
                spans.append((row, end, len(ids)))
                ids_of.append(doc)
                row, end, have = row + 1, end + len(ids), have + len(ids)
                held.append(ids)
                while have >= block_ids:
                    yield block(block_ids)
        if have:
            yield block(have)

    tie = F.xxhash64("text")
    (
        docs.select("doc_id", "text")
        .repartitionByRange(parts or tasks(docs), F.col("doc_id"), tie)
        .sortWithinPartitions(F.col("doc_id"), tie)
        .mapInArrow(blocks, BLOCK.format(id=id_type.simpleString()))
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """What each block holds of each document: part, row, doc_id, doc_start (in the part),
    n_tokens (of the document), at (the fragment's place in it), ids (binary, uint32)."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    id_arrow = _arrow(id_type)

    def fragments(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = unshuffle_planes(b["planes"], b["n_ids"], b["kind"])
                rows, cut, at = b["docs"], [], []
                for d in rows:
                    lo = max(d["start"], b["first"])
                    hi = min(d["start"] + d["n_tokens"], b["first"] + b["n_ids"])
                    cut.append(ids[lo - b["first"] : hi - b["first"]].tobytes())
                    at.append(lo - d["start"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b["part"]] * len(rows), pa.int32()), pa.array([d["row"] for d in rows], pa.int64()),
                        pa.array(b["doc_ids"], id_arrow), pa.array([d["start"] for d in rows], pa.int64()),
                        pa.array([d["n_tokens"] for d in rows], pa.int64()), pa.array(at, pa.int64()), pa.array(cut, pa.binary()),
                    ],
                    names=["part", "row", "doc_id", "doc_start", "n_tokens", "at", "ids"],
                )

    schema = f"part int, row long, doc_id {id_type.simpleString()}, doc_start long, n_tokens long, at long, ids binary"
    return files.mapInArrow(fragments, schema)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: the ids in the parts before; a row per part, from the chunk index alone."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


@F.pandas_udf(T.LongType())
def _crc_of_list(parts):
    def crc(fragments) -> int:
        value = 0
        for x in fragments:
            value = zlib.crc32(x["ids"], value)
        return value

    return parts.map(crc)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    Documents inside one block, nearly all, are digested where they are read. Only documents cut
    by a block's end meet in a shuffle.
    """
    fragments = read_fragments(spark, path)
    cut = (F.col("at") > 0) | (F.length("ids") < 4 * F.col("n_tokens"))
    key = ["part", "row", "doc_id", "doc_start", "n_tokens"]
    whole = fragments.where(~cut).select(*key, F.crc32("ids").alias("ids_crc32"))
    joined = (
        fragments.where(cut)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        .select(*key, _crc_of_list("parts").alias("ids_crc32"))
    )
    starts = part_starts(spark, path)
    return (
        whole.unionByName(joined)
        .join(F.broadcast(starts), "part")  # a row per part: bounded by the number of files
        .select("doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-planes")
    write_tokens(documents(spark, sf_dir), path)
    return read_digests(spark, path)
