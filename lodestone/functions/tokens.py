"""Text to terms: normalising, scanning, filtering.

Over tables documents are scanned where they are read, in Arrow batches, with a remembered table of
words; the same as a plan of built-in expressions took twenty times as long. `scan` is the same for
single strings on the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.lexicon import PROTECTED, SCANNER, STOPWORDS
from lodestone.functions.stemming import stem

_SCANNER = re.compile(SCANNER)
#: What NFC can change: marks, conjoining jamo, and characters that stand for others.
_UNSURE = (
    r"[\p{M}\x{0374}\x{037E}\x{0387}\x{0900}-\x{0FFF}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}"
    r"\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


@dataclass(frozen=True)
class Token:
    text: str
    position: int
    start: int = 0
    end: int = 0


def normalize(text: str) -> str:
    """NFC, lower case, straight single quotes."""
    return unicodedata.normalize("NFC", text).lower().translate({0x2018: "'", 0x2019: "'"})


def structured(term: str) -> bool:
    return ":" in term or term == "vs"


def scan(text: str) -> Iterator[Token]:
    """Every token, those included that are no terms; positions and offsets are of the normal text."""
    for position, found in enumerate(_SCANNER.finditer(normalize(text))):
        kind, number, section, clause, subs, versus, word = found.groups()
        if kind is not None:
            value = re.sub("[^a-z]", "", kind) + ":" + number.strip("-")
        elif section is not None:
            value = ("rule" if section.startswith("rule") else section[:3]) + ":" + clause + re.sub(r"\s+", "", subs)
        else:
            value = "vs" if versus is not None else word
        yield Token(value, position, *found.span())


def term_of(value: str, *, stemming: bool = True) -> str | None:
    """The index term of a scanned token, or None if it is noise."""
    if structured(value):
        return value
    if re.search(r"\d", value) or value in STOPWORDS:
        return None
    return stem(value) if stemming and value not in PROTECTED else value


def tokenize(text: str, *, stemming: bool = True) -> list[Token]:
    """The terms of a text, at the positions that they have among all tokens."""
    found = ((t, term_of(t.text, stemming=stemming)) for t in scan(text))
    return [Token(term, t.position, t.start, t.end) for t, term in found if term]


def terms(text: str, *, stemming: bool = True) -> list[str]:
    """The terms of a text in their order, repeats included."""
    return [t.text for t in tokenize(text, stemming=stemming)]


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed_column(text: Column) -> Column:
    """NFC of a column. Only texts that it could change go to Python; of others, nulls do."""
    return F.coalesce(_nfc(F.when(text.rlike(_UNSURE), text)), text)


def normal_column(text: Column) -> Column:
    return F.translate(F.lower(composed_column(text)), "’‘", "''")


_TERMS: dict[bool, dict[str, str | None]] = {True: {}, False: {}}


def _values(text: str) -> list[str]:
    """The tokens of a text in their order, as scan() gives them.

    The last group of a match tells which alternative it was: words, by far the most, end with the seventh.
    """
    plain = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    found = _SCANNER.finditer(plain.lower().replace("’", "'").replace("‘", "'"))
    return [m[7] if m.lastindex == 7 else "vs" if m.lastindex == 6 else next(scan(m[0])).text for m in found]


def _terms(values: list[str], stemming: bool = True) -> list[str | None]:
    """The term of each token, None for noise. A worker remembers those of words."""
    known = _TERMS[stemming]
    if len(known) > 1 << 18:
        known.clear()
    for word in set(values).difference(known):
        known[word] = term_of(word, stemming=stemming) or None
    return [known[v] for v in values]


def places(text: str) -> dict[str, list[int]]:
    """The terms of a text with their positions; what tokenize() gives, grouped."""
    found: dict[str, list[int]] = {}
    for position, term in enumerate(_terms(_values(text))):
        if term is not None:
            if (own := found.get(term)) is None:
                found[term] = [position]
            else:
                own.append(position)
    return found


#: Characters of texts whose tokens go out as one batch.
_CHARS = 1 << 21


def _parts(batches):
    """(keys, texts) of so many documents at a time as come to _CHARS."""
    for batch in batches:
        keys, texts, start, size = batch.column(0), batch.column(1).to_pylist(), 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= _CHARS or i == len(texts):
                yield keys[start:i], texts[start:i]
                start, size = i, 0


def _rows(docs: DataFrame, key: str, text: str, name: str, made: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(key, position, name): what is made of each token of docs, where they are read; without what comes to None."""

    def of(batches):
        for keys, texts in _parts(batches):
            values, sizes = [], []
            for x in texts:
                own = made(_values(x)) if x else []
                values += own
                sizes.append(len(own))
            ends, out = np.cumsum(sizes), pa.array(values, pa.string())
            at = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
            rows = pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(at.astype(np.int32)), out], names=[key, "position", name])
            yield rows.filter(out.is_valid()) if out.null_count else rows

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(of, f"`{key}` {kind}, position int, {name} string")


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, value), a row for each token that the scanner sees in docs."""
    return _rows(docs, key, text, "value", lambda values: values)


def term_table(docs: DataFrame, key: str, text: str, *, stemming: bool = True) -> DataFrame:
    """(key, position, term), a row for each token that is a term."""
    return _rows(docs, key, text, "term", lambda values: _terms(values, stemming))


def _counted(batches):
    for _, texts in _parts(batches):
        found: dict[str, list[int]] = {}
        for x in texts:
            for position, value in enumerate(_values(x) if x else ()):
                own = found.setdefault(value, [0, position])
                own[0] += 1
                own[1] = min(own[1], position)
        counts, firsts = zip(*found.values()) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int32())], names=["value", "n", "first"])


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(value, n, first) of each distinct token: how many there are, and the least of its positions; summed where documents are read first."""
    rows = docs.select(key, text).mapInArrow(_counted, "value string, n long, first int")
    return rows.groupBy("value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def terms_column(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms), a row for each key whose documents have any: their terms in their order.

    A document is one row from the beginning. Rows that share a key are merged by position.
    """

    def of(batches):
        for keys, texts in _parts(batches):
            positions, terms, offsets = [], [], [0]
            for x in texts:
                for position, term in enumerate(_terms(_values(x)) if x else ()):
                    if term is not None:
                        positions.append(position)
                        terms.append(term)
                offsets.append(len(terms))
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(positions, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(terms, pa.string()))], names=[key, "p", "t"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(of, f"`{key}` {kind}, p array<int>, t array<string>").where("size(t) > 0")
    rows = rows.groupBy(key).agg(F.collect_list(F.struct("p", "t")).alias("a"))
    merged = F.transform(F.array_sort(F.flatten(F.transform("a", lambda x: F.arrays_zip(x.p, x.t)))), lambda x: x.t)
    return rows.select(key, F.when(F.size("a") == 1, F.col("a")[0].t).otherwise(merged).alias("terms"))
