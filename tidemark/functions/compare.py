"""Two versions of a text: similarity, word differences and whether the new one is taken."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import islands, let
from .unicode import normal


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: rows of the table as the bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([2 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence over both lengths, of texts in normal form; 1 for two empty
    ones. Nulls count as empty."""
    return _ratio(normal(F.coalesce(a, F.lit(""))), normal(F.coalesce(b, F.lit(""))))


KEPT = T.StructType([T.StructField(n, T.ArrayType(T.BooleanType())) for n in ("old", "new")])


@F.pandas_udf(KEPT)
def _kept(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Which words of two lists stand in their matching blocks."""
    rows = []
    for a, b in zip(old, new, strict=True):
        flags = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for i, j, n in difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_matching_blocks():
            flags[0][i : i + n] = flags[1][j : j + n] = True
        rows.append([f.tolist() for f in flags])
    return pd.DataFrame(rows, columns=["old", "new"])


def differences(old: Column, new: Column) -> Column:
    """struct(old, new) of arrays of (text, kind): both texts in pieces that alternate between `same` and `del` in
    the old or `ins` in the new one. Words are matched in lower case; white space inside a run of changed
    words changes with it, other white space is the same. Nulls count as empty."""
    old, new = (F.coalesce(x, F.lit("")) for x in (old, new))
    words = lambda x: F.regexp_extract_all(x, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))
    low = lambda x: F.transform(words(x), lambda w: F.lower(w))
    kept = _kept(low(old), low(new))

    def pieces(x: Column, flags: Column, kind: str) -> Column:
        spaces = F.split(x, r"(?U)[^\s\x1c-\x1f]+")
        # Parts in order: space 0, word 0, space 1, word 1, ..., the last space; word i is part 2 i + 1.
        parts = F.flatten(F.transform(spaces, lambda g, i: F.array_compact(F.array(g, F.get(words(x), i)))))
        return let(F.struct(parts.alias("p"), F.filter(F.transform(flags, lambda f, i: F.when(~f, i)), lambda i: i.isNotNull()).alias("c")), lambda p: cut(p, kind))

    def cut(p: Column, kind: str) -> Column:
        return let(F.struct(p["p"].alias("p"), islands(p["c"], 1).alias("r")), lambda q: joined(q, kind))

    def joined(q: Column, kind: str) -> Column:
        text = lambda lo, hi: F.array_join(F.slice(q["p"], lo + 1, hi - lo), "")  # parts lo to hi - 1

        def run(r: Column, j: Column) -> Column:
            before = F.coalesce(2 * F.get(q["r"], j - 1)["last"] + 2, F.lit(0))
            lo, hi = 2 * r["first"] + 1, 2 * r["last"] + 2
            return F.array(F.struct(text(before, lo).alias("text"), F.lit("same").alias("kind")), F.struct(text(lo, hi).alias("text"), F.lit(kind).alias("kind")))

        rest = F.coalesce(2 * F.get(q["r"], F.size(q["r"]) - 1)["last"] + 2, F.lit(0))
        end = F.array(F.struct(text(rest, F.size(q["p"])).alias("text"), F.lit("same").alias("kind")))
        return F.filter(F.concat(F.flatten(F.transform(q["r"], run)), end), lambda x: x["text"] != "")

    # The marks are made once: a lambda names them.
    return let(F.struct(old.alias("a"), new.alias("b"), kept.alias("k")), lambda p: F.struct(pieces(p["a"], p["k"]["old"], "del").alias("old"), pieces(p["b"], p["k"]["new"], "ins").alias("new")))


def accepted(mode: Column, new: Column, likeness: Column, before: Column, after: Column, least: float = 0.8) -> Column:
    """Why a corrected text is taken or not: accepted, llm_empty, rewrite_suspected (a correction that is
    less like the old text than `least`) or quality_not_improved, in order of precedence."""
    empty = F.trim(F.regexp_replace(F.coalesce(new, F.lit("")), r"(?U)\s+", " ")) == ""
    return (
        F.when(empty, "llm_empty")
        .when((mode == "text_fix") & (likeness < least), "rewrite_suspected")
        .when(after < before, "quality_not_improved")
        .otherwise("accepted")
    )
