"""What the corpus operators share: Arrow mapping over texts, words, hashes, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as every contract of these operators has it: a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_text(
    docs: DataFrame,
    compute: Callable[[list[str]], dict[str, object]],
    fields: Sequence[tuple[str, T.DataType]],
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    rows: int = 512,
) -> DataFrame:
    """The columns `keep` and what `compute` makes of each text, as a narrow Arrow map.

    A null text reaches `compute` as "". Other columns are pruned before the scan. `compute`
    gets at most `rows` texts at a time, so that a task's memory does not follow its input.
    """
    kept = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(n, t) for n, t in fields])
    arrow = [_arrow(t) for _, t in fields]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
                got = compute(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(batch.num_columns - 1)]
                    + [pa.array(got[n], type=t) for n, t in zip(names, arrow, strict=True)],
                    names=[*keep, *names],
                )

    return kept.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def words(text: str) -> list[bytes]:
    """The words of WORD: bytes.split() splits at exactly its six ASCII white-space bytes."""
    return text.encode().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    return np.fromiter(map(digest, ws), dtype=np.uint64, count=len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a folder of /tmp serves, on a local master only.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "/tmp/tidemark-checkpoints"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, least: int = 1) -> int:
    """The session's shuffle partition count, for repartition calls that take a number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_spread(rows: DataFrame, table: DataFrame, key: str, counted: DataFrame, share: int = 512, least: int = 1000) -> DataFrame:
    """Inner join of `rows` with `table`, which has one row per key, so that no hot key meets one task.

    counted: a written table with the rows' keys. Keys with more than one in `share` of its rows, and
    more than `least`, are at most `share` many; their table rows are broadcast, the others shuffled.
    """
    limit = max(least, counted.count() // share)
    hot = [r[0] for r in counted.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    here = F.col(key).isin(hot)
    return rows.where(here).join(F.broadcast(table.where(here)), key).unionByName(rows.where(~here).join(table.where(~here), key))
