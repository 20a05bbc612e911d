"""Cleaning of page text, and the dates and dockets in it, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.tokens import composed_column

# What a date and a docket look like in a listing.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE = rf"\b({'|'.join(MONTHS)})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})\b"
#: Letters and digits by turns, with nothing between kind and number, are a key or a digest (`ac04fe8a83`), no docket.
CITATION = r"\b(?!(?:GR|AC|AM|BM|UDK)[A-Z]?\d+[A-Z]+\d)(?:G\.?\s?R\.?|A\.?\s?C\.?|A\.?\s?M\.?|B\.?\s?M\.?|OCA\s+IPI|UDK)(?:\s*Nos?\.?)?\s*[A-Z]?[\d][\w\-–.]*"
TAIL = r"\b(?:Concurring|Dissenting|Separate)\b[\w\s]*\bOpinion\b"
_BLANKS = "[ \t   ]+"


def clean(text: str) -> str:
    """NFC, plain spaces, lines stripped, one blank line at most."""
    text = unicodedata.normalize("NFC", text)
    text = re.sub(_BLANKS, " ", re.sub("\r\n?", "\n", text))
    return re.sub("\n{3,}", "\n\n", "\n".join(map(str.strip, text.split("\n")))).strip()


def squash(text: str) -> str:
    return re.sub(r"\s+", "", text).upper()


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, _BLANKS, " "), r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def clean_column(text: Column) -> Column:
    return _tidy(composed_column(text))


def squash_column(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"(?U)\s+", ""))


def titled_column(text: Column) -> Column:
    """Every run of letters with a capital at its beginning alone, whatever stands between them."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def date_column(text: Column) -> Column:
    """The first `Month d, yyyy` of a text; null without one, or if there is no such day."""
    part = lambda k: F.regexp_extract(text, f"(?iU){DATE}", k)
    return F.try_to_date(F.concat_ws(" ", F.initcap(part(1)), part(2), part(3)), "MMMM d yyyy")


def citations_column(text: Column) -> Column:
    """All dockets of a text, each once, in their order."""
    found = F.regexp_extract_all(text, F.lit(f"(?iU){CITATION}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.rtrim(_tidy(x), F.lit(".,;"))))


def without_tail_column(caption: Column) -> Column:
    """A caption without the opinion that is named behind it."""
    return F.rtrim(clean_column(F.element_at(F.split(caption, f"(?iU){TAIL}", 2), 1)), F.lit(" ,;"))


def find_date(text: str) -> str | None:
    """The first date of a text as yyyy-mm-dd."""
    import datetime

    found = re.search(DATE, text, re.IGNORECASE)
    try:
        return found and datetime.date(int(found[3]), MONTHS.index(found[1].lower()) + 1, int(found[2])).isoformat()
    except ValueError:
        return None


def find_citations(text: str) -> list[str]:
    return list(dict.fromkeys(clean(x).rstrip(".,;") for x in re.findall(CITATION, text, re.IGNORECASE)))


def without_tail(caption: str) -> str:
    return clean(re.split(TAIL, caption, maxsplit=1, flags=re.IGNORECASE)[0]).rstrip(" ,;")
