"""Suffix stripping as ordered tables of regular expressions.

A rule is a pattern whose first group stays, with what is put after it. Conditions on what stays
are patterns too: with an initial `y` written `Y`, runs of consonants and vowels are regular, and so
is their count. One set of tables gives a Python function, Spark columns and SQL; the last two serve
vocabularies, that is, each distinct word once.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME = f"(?:{_C})?{_V}{_C}"  # at least one vowel-consonant pair, as a beginning
_MORE = f"(?:{_C})?{_V}{_C}{_V}{_C}"
_ONE = f"(?:{_C})?{_V}{_C}(?:{_V})?"  # exactly one, as a whole
_VOWEL = f"(?:{_C})?[aeiouy]"
_SHORT = f"{_C}[aeiouy][^aeiouwxy]"  # with one pair: consonant, vowel, consonant other than w, x, y

# Suffixes in the order in which they are tried, and what takes their place.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]




def _ends(letters: str) -> str:
    """At least two pairs, and one of `letters` at the end."""
    return f"(?:{_C})?{_V}{_C}{_V}(?:[{letters}]|[^aeiou].*[{letters}])"


#: Consonants that lose their double before -ed and -ing; of a run of y every second one is a vowel.
_DOUBLED = [(f"^(.*{c}){c}_$", "") for c in "bcdfghjkmnpqrtvwxñáéíóúü"]
_DOUBLED += [("^(.*[^aeiouy](?:yy)*y)y_$", ""), ("^(.*[aeiou]y(?:yy)*y)y_$", "")]

#: In each table the first rule that matches is the one applied; a mark `_` says that a word has
#: lost -ed or -ing and gets its shape back.
TABLES: list[list[tuple[str, str]]] = [
    [(f"^(.*){old}$", new) for old, new in PLURALS],
    [(f"^({_SOME}.*)eed$", "ee"), ("^(.*eed)$", ""), (f"^({_VOWEL}.*)ed$", "_"), (f"^({_VOWEL}.*)ing$", "_")],
    [("^(.*(?:at|bl|iz))_$", "e"), *_DOUBLED, (f"^({_SHORT})_$", "e"), ("^(.*)_$", "")],
    [(f"^({_VOWEL}.*)y$", "i")],
    [(f"^({_SOME}.*){old}$", new) for old, new in STEP_2],
    [(f"^({_SOME}.*){old}$", new) for old, new in STEP_3],
    [*[(f"^({_MORE}.*){old}$", "") for old in STEP_4], (f"^({_ends('st')})ion$", "")],
    [(f"^({_MORE}.*)e$", ""), (f"^({_SHORT}e)$", ""), (f"^({_ONE})e$", "")],
    [(f"^({_ends('l')})l$", "")],
]
#: The same with the letters that each pattern ends with, which rule out most words at once.
_COMPILED = [[(re.search(r"\)([^()]*)\$$", pattern)[1], re.compile(pattern), tail) for pattern, tail in table] for table in TABLES]


def measure(word: str) -> int:
    """The number of vowel-consonant pairs."""
    return len(re.findall(f"{_V}{_C}", re.sub("^y", "Y", word)))


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    word = re.sub("^y", "Y", word)
    for table in _COMPILED:
        for end, pattern, tail in table:
            if word.endswith(end) and (found := pattern.match(word)):
                word = found[1] + tail
                break
    return re.sub("^Y", "y", word)


def stem_column(df: DataFrame, word: str, out: str) -> DataFrame:
    """df with the stem of a column of distinct words; one projection a table, no Python at run time."""
    df = df.withColumn(out, F.regexp_replace(word, "^y", "Y"))
    for table in _COMPILED:
        value = F.col(out)
        step: Column | None = None
        for end, pattern, tail in table:
            made = F.concat(F.regexp_extract(value, pattern.pattern, 1), F.lit(tail))
            fits = F.endswith(value, F.lit(end)) & value.rlike(pattern.pattern) if end else value.rlike(pattern.pattern)
            step = F.when(fits, made) if step is None else step.when(fits, made)
        df = df.withColumn(out, step.otherwise(value))
    return df.withColumn(out, F.when(F.length(word) <= 2, F.col(word)).otherwise(F.regexp_replace(out, "^Y", "y")))


def stem_sql(source: str, word: str = "word") -> str:
    """SQL for (word, stem) of a relation of distinct words, for engines with RE2 expressions."""
    sql = f"SELECT {word}, regexp_replace({word}, '^y', 'Y') AS s FROM {source}"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    for table in TABLES:
        cases = " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN concat(regexp_extract(s, {quote(p)}, 1), {quote(t)})" for p, t in table)
        sql = f"SELECT {word}, CASE {cases} ELSE s END AS s FROM ({sql})"
    return f"SELECT {word}, CASE WHEN length({word}) <= 2 THEN {word} ELSE regexp_replace(s, '^Y', 'y') END AS stem FROM ({sql})"
