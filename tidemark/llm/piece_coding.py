"""Operator 2: SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, map_text


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Ids of distinct marked words.

    A model whose pieces never hold a whitespace marker after another character cannot merge across
    the start of a marker run. So a text, with its dummy prefix, falls into chunks of markers and
    what follows them, each of which is segmented alike wherever it stands. Each distinct chunk is
    segmented once and its ids are put back by position. The table holds at most `limit` chunks: a
    full one is emptied, which costs repeated segmentation, never a result.
    """

    def __init__(self, path: str, limit: int) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            if "▁" in self.model.id_to_piece(i).lstrip("▁"):
                raise ValueError("this model's pieces cross whitespace markers")
        if [self.model.encode(x, out_type=str) for x in ("", "a", " a")] != [[], ["▁a"], self._spelt(" a")]:
            raise ValueError("this model normalises white space; chunks would not be exact")
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        """Empty but for the chunk of a marker alone, which ends a text that ends in a space."""
        marker = self.model.piece_to_id("▁")
        self.ids, self.spelt = {"": [marker]}, {"": str(marker)}

    def _spelt(self, text: str) -> list[str]:
        got = self.model.encode(text, out_type=str)
        return got if "".join(got) == "▁" + text.replace(" ", "▁") else []

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text's chunks in order, each without its first marker, as encode() puts that back."""
        if not text:
            return []
        text = text.replace("▁", " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of each text, and the same in decimal, joined by commas."""
        cut = [self.chunks(x) for x in texts]
        distinct = set(chain.from_iterable(cut))
        if len(self.ids) + len(distinct) > self.limit:
            self.clear()
        new = [x for x in distinct if x not in self.ids]
        got = self.model.encode(new, num_threads=1) if new else []
        self.ids.update(zip(new, got, strict=True))
        self.spelt.update((x, ",".join(map(str, y))) for x, y in zip(new, got, strict=True))
        ids, spelt = self.ids.__getitem__, self.spelt.__getitem__
        return [list(chain.from_iterable(map(ids, c))) for c in cut], [",".join(map(spelt, c)) for c in cut]


@lru_cache(maxsize=1)
def table(path: str, limit: int) -> ChunkTable:
    return ChunkTable(path, limit)


def encode_pieces(docs: DataFrame, model: str | None = None, limit: int = 200_000) -> DataFrame:
    """doc_id, ids array<int>: each text's ids, without begin or end ids.

    Null and empty texts have no ids; nulls in doc_id and repeated rows stay as they are; other
    columns are dropped. A text is processed whole, whatever its length.
    """
    path = model or default_path()
    return map_text(
        docs, lambda texts: {"ids": table(path, limit).encode(texts)[0]}, [("ids", T.ArrayType(T.IntegerType()))], rows=256
    )


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of encode_pieces' rows, by the library's decode(ids). Null ids give ""."""
    import pyarrow as pa

    path = model or default_path()
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            texts = [table(path, 1).model.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def coding_digest(docs: DataFrame, model: str | None = None, limit: int = 200_000) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, then decoded from its ids."""
    path = model or default_path()

    def compute(texts: list[str]) -> dict[str, object]:
        coder = table(path, limit)
        ids, spelt = coder.encode(texts)
        decoded = coder.model.decode(ids, num_threads=1)
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in spelt],
            "decoded_sha256": [hashlib.sha256((x or "").encode()).hexdigest() for x in decoded],
        }

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_text(docs, compute, fields, rows=256)


def op2_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_digest(documents(spark, sf_dir))
