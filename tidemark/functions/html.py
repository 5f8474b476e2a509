"""Plain upper-case text of HTML pages and of filings wrapped in SGML, as one chain of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import plain_characters, unescape, unescape_whole

#: Tags that join what they divide, tags that break the line, and the filing types taken.
INLINE = "span|font|b|i|u|strong|em|a|sup|sub|small|ix:[a-z]+"
BLOCK = "p|div|br|tr|li|h[1-6]|table|td|th"
FILING_TYPES = "10-K405|10K405|10-K|10K"
BINARY = "PDF|GRAPHIC|ZIP|EXCEL|JSON|XML|XBRL"

#: A noncharacter that parts tables from the text around them.
CUT = "\ufdd0"
PRIMARY = rf"(?is)<DOCUMENT>\s*<TYPE>(?:{FILING_TYPES})\s+.*?<TEXT>(.*?)(?:</TEXT>|</DOCUMENT>)"


def drop_numeric_tables(html: Column, limit: float = 0.25) -> Column:
    """html with a space for each table of which over `limit` of the visible, non-blank characters are
    digits. Tables with nothing visible stay. A table ends at the first closing tag."""
    marked = F.regexp_replace(F.replace(html, F.lit(CUT), F.lit(" ")), r"(?is)(<table[^>]*>.*?</table>)", f"{CUT}$1{CUT}")

    def shown(piece: Column) -> Column:
        visible = F.regexp_replace(F.regexp_replace(piece, r"<[^>]+>", " "), r"(?U)\s+", "")
        digits = F.length(visible) - F.length(F.regexp_replace(visible, r"\p{Nd}", ""))
        numeric = piece.rlike(r"(?is)^<table[^>]*>.*</table>$") & (digits > F.length(visible) * limit)
        return F.when(numeric, F.lit(" ")).otherwise(piece)

    return F.array_join(F.transform(F.split(marked, CUT), shown), "")


def primary_body(filing: Column) -> Column:
    """The text of the first annual report in an SGML submission, "" if it has none."""
    return F.regexp_extract(filing, PRIMARY, 1)


def clean_filing(raw: Column, cut_entities: bool = True) -> Column:
    """Upper-case text of a page or filing, lines kept; null for null.

    A submission of several documents is taken by its annual report alone ("" without one). Where that
    is plain text every tag is a space; in HTML inline tags vanish, so that no word is cut, block tags
    break the line and other tags are a space. Scripts, styles, heads, inline XBRL headers and hidden
    facts, encoded files and tables of numbers go. Entities without their semicolon are read as a browser
    does, unless `cut_entities` is false: then they stay as they stand.
    """
    sgml = raw.rlike(r"(?is)<DOCUMENT>\s*<TYPE>")
    body = F.when(sgml, primary_body(raw)).otherwise(raw)
    plain = sgml & ~body.rlike(r"(?i)<(?:html|body|div|p|font|table)\b")

    def either(x: Column, in_plain: Column, in_html: Column) -> Column:
        return F.when(plain, in_plain).otherwise(in_html)

    files = F.regexp_replace(F.regexp_replace(body, rf"(?is)<({BINARY})>.*?</\1>", " "), r"(?s)begin\s+\d{3}\s+\S+\n.*?\nend\s*\n", " ")
    x = either(body, files, F.regexp_replace(body, r"(?is)<(style|script|head)\b.*?</\1>", " "))
    for hidden in ("ix:header", "ix:hidden"):
        x = F.regexp_replace(x, rf"(?is)<{hidden}\b[^>]*>.*?</{hidden}>", " ")
    x = drop_numeric_tables(unescape(x) if cut_entities else unescape_whole(x))
    joined = F.regexp_replace(F.regexp_replace(x, rf"(?i)</?(?:{INLINE})\b[^>]*>", ""), rf"(?i)</?(?:{BLOCK})\b[^>]*>", "\n")
    x = F.regexp_replace(either(x, x, joined), r"-\s*\n\s*", "-")
    x = F.upper(plain_characters(F.regexp_replace(x, r"<[^>]+>", " ")))
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t\f\x0B]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
