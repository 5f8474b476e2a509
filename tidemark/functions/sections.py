"""Sections of annual reports: management's discussion, also in the short form, and risk factors.

Input is clean upper-case text (see `html.clean_filing`). A section runs from a heading to an end mark;
tables of contents, cross references and repeated page headings must not be taken for headings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words a section must have at least and at most, and how far behind its heading an end may stand.
LEAST, MOST, AHEAD = 250, 100_000, 100

#: Headings and ends, as filings spell them.
PHRASE = r"MANAGEMENT(?:\s*['’]\s*S|S)?\s+DISCUSSION(?:\s+AND\s+ANALYSIS)?"
MARK = r"[\.\s\-:\)]"
ENDS = (
    rf"ITEM\s*7\s*A{MARK}",
    rf"ITEM\s*8{MARK}+(?:.{{0,200}}?)FINANCIAL\s+STATEMENTS",
    rf"ITEM\s*7{MARK}+(?:.{{0,200}}?)FINANCIAL\s+STATEMENTS",
    r"QUANTITATIVE\s+AND\s+QUALITATIVE\s+DISCLOSURES",
    r"REPORT\s+OF\s+(?:INDEPENDENT|MANAGEMENT)",
    r"CONSOLIDATED\s+BALANCE\s+SHEETS?",
)
RISK_START = rf"ITEM\s*1\s*A{MARK}+(?:.{{0,100}}?)RISK\s+FACTORS"
RISK_END = rf"ITEM\s*1\s*B{MARK}|ITEM\s*1\s*C{MARK}|ITEM\s*2{MARK}+(?:.{{0,50}}?)PROPERTIES"

FLAGS = re.IGNORECASE | re.DOTALL
FREE_ENDS = [re.compile(e, FLAGS) for e in ENDS]
LINE_ENDS = [re.compile(r"\n[ \t]*" + e, FLAGS) for e in ENDS]

#: What shows, behind a heading on its line, that it is a quotation, a repeat or a reference; and that
#: a page number follows, as in a table of contents.
NO_HEADING = re.compile(r"[\"']|\(CONTINUED\)|\bSEE\b|\bREFER\b|\bPAGES?\s*\d")
OWN_NAME = re.compile(r"\(\s*[\"']?MD&A[\"']?\s*\)")
PAGE_NUMBER = re.compile(r"[ \t]*(?:[IVX]{1,4}-)?\d{1,3}[ \t]*")


def is_heading(text: str, end: int) -> bool:
    """Whether what follows place `end` lets the match before it be a heading."""
    lines = text[end : end + 300].split("\n")
    if NO_HEADING.search(OWN_NAME.sub("", lines[0])):
        return False
    # A page number on one of the next two lines that hold anything; the last one may be cut off.
    later = [x for x in lines[1:-1] if x.strip(" \t")][:2]
    return not any(PAGE_NUMBER.fullmatch(x) for x in later)


@dataclass(frozen=True)
class Rule:
    """A kind of heading: its name, pattern, the ends that close it in order of precedence, the order
    in which its places are tried, and what makes a place a heading."""

    name: str
    start: re.Pattern
    ends: tuple[re.Pattern, ...]
    longest: bool
    heading: Callable[[str, int], bool] = lambda text, end: True

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Sections of allowed length. For `longest` the first end found decides about a place;
        otherwise an end that gives no allowed length yields to the next, and the last place leads."""
        places = [m for m in self.start.finditer(text) if self.heading(text, m.end())]
        for m in places if self.longest else reversed(places):
            found = (e.search(text, m.start() + AHEAD) for e in self.ends)
            for end in (f.start() for f in found if f):
                if LEAST <= len(text[m.start() : end].split()) <= MOST:
                    yield m.start(), end
                    break
                if self.longest:
                    break

    def section(self, text: str) -> str | None:
        spans = self.spans(text)
        best = max(spans, key=lambda s: s[1] - s[0], default=None) if self.longest else next(spans, None)
        return text[slice(*best)].strip() if best else None


ANNUAL = (
    Rule("t1_10k_item7", re.compile(rf"(?:^|\n)[ \t]*(?:PART\s+II[\s,\.\-]*)?ITEM\s*7\s*[\.\-:\)]*\s*{PHRASE}", FLAGS), tuple(LINE_ENDS), True, is_heading),
    Rule("t3_bare", re.compile(rf"(?:^|\n)[ \t]*(?:COMBINED\s+)?{PHRASE}", FLAGS), tuple(LINE_ENDS), True, is_heading),
)
SHORT_FORM = (
    Rule("t1_ksb_item6", re.compile(rf"ITEM\s*6{MARK}+(?:.{{0,400}}?){PHRASE}", FLAGS), tuple(FREE_ENDS), False),
    Rule("t2_roman", re.compile(rf"(?:^|\n)\s*(?:[IVX]+\.)\s*(?:.{{0,200}}?){PHRASE}", FLAGS), tuple(FREE_ENDS), False),
    Rule("t3_bare", re.compile(rf"(?:^|\n)\s*{PHRASE}", FLAGS), tuple(FREE_ENDS), False),
)
SECTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType())])


def discussion(text: str, form: str) -> tuple[str | None, str]:
    for rule in SHORT_FORM if "KSB" in form.upper() else ANNUAL:
        found = rule.section(text)
        if found is not None:
            return found, f"ok_{rule.name}"
    return None, "no_match"


def risk_factors(text: str) -> tuple[str | None, str]:
    """From the last heading back: the first that has an end behind it and words enough."""
    for m in reversed(list(re.finditer(RISK_START, text, FLAGS))):
        end = re.compile(RISK_END, FLAGS).search(text, m.start() + AHEAD)
        if end and len(text[m.start() : end.start()].split()) >= LEAST:
            return text[m.start() : end.start()].strip(), "ok"
    return None, "no_match"


@F.pandas_udf(SECTION)
def _discussion(texts: pd.Series, forms: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([discussion(t or "", f or "") for t, f in zip(texts, forms, strict=True)], columns=["text", "status"])


@F.pandas_udf(SECTION)
def _risk(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([risk_factors(t or "") for t in texts], columns=["text", "status"])


def extract_discussion(text: Column, form: Column | None = None) -> Column:
    """struct(text, status) of management's discussion; form: the filing's type (10-K if not given).
    status: ok_<rule>, or no_match with a null text, for null and empty texts too."""
    return _discussion(text, F.lit("10-K") if form is None else form)


def extract_risk_factors(text: Column) -> Column:
    """struct(text, status) of the risk factors: ok, or no_match with a null text."""
    return _risk(text)
