"""Unicode forms and HTML entities, which Spark has no functions for: Arrow-batched, one pass each."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Typographic characters and what stands for them after NFKC.
PLAIN = str.maketrans({
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00ad": "-", "\u00a0": " ", "\u2028": "\n", "\u2029": "\n",
})


def _mapped(change):
    """A column function that applies `change` to every text; nulls stay null."""

    @F.pandas_udf(T.StringType())
    def mapped(texts: pd.Series) -> pd.Series:
        return texts.map(change, na_action="ignore")

    return mapped


def _nfc(x: str) -> str:
    return x if x.isascii() else unicodedata.normalize("NFC", x)


def _plain(x: str) -> str:
    return x if x.isascii() else unicodedata.normalize("NFKC", x).translate(PLAIN)


def _unmarked(x: str) -> str:
    if x.isascii():
        return x
    return "".join(c for c in unicodedata.normalize("NFD", x.replace("đ", "d")) if unicodedata.category(c) != "Mn")


def _unescaped(x: str) -> str:
    return html.unescape(x) if "&" in x else x


_WHOLE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _character(reference: re.Match) -> str:
    x = reference[0]
    return html.unescape(x) if x[1] == "#" or x[1:] in html5 else x


def _unescaped_whole(x: str) -> str:
    return _WHOLE.sub(_character, x) if "&" in x else x


nfc = _mapped(_nfc)
plain_characters = _mapped(_plain)
unescape = _mapped(_unescaped)
#: Those that end in a semicolon only: `&amp` cut off before it stays as it is.
unescape_whole = _mapped(_unescaped_whole)
_without_marks = _mapped(_unmarked)


def normal(text: Column) -> Column:
    """NFC, lower case, white space runs (NBSP too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(nfc(text)), r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """`normal` without diacritics; đ is d."""
    return _without_marks(normal(text))
