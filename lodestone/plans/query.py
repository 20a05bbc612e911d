"""The query language: words, quoted phrases, fields, dockets, and OR."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from lodestone.functions.lexicon import DOCKET_PREFIXES, FIELDS
from lodestone.functions.tokens import Token, tokenize

_QUOTED = re.compile(r'"([^"]*)"')
_FIELD = re.compile(r'\b(\w+):("[^"]*"|\S+)')
_EITHER = re.compile(r"\bOR\b")


@dataclass
class Query:
    """All of `terms`, any of `should` if there are some, each of `phrases`, and all `filters`."""

    raw: str
    terms: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    phrases: list[list[Token]] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)

    @property
    def is_empty(self) -> bool:
        return not any((self.terms, self.should, self.phrases, self.filters))

    @property
    def all_terms(self) -> list[str]:
        """What is scored; a term that is asked for twice counts twice."""
        return self.terms + self.should + [t.text for phrase in self.phrases for t in phrase]

    @property
    def weights(self) -> Counter:
        return Counter(self.all_terms)

    def slots(self) -> list[list[tuple[str, int]]]:
        """Each phrase as terms and their distance from its first."""
        return [[(t.text, t.position - phrase[0].position) for t in phrase] for phrase in self.phrases]


def parse(raw: str, *, quoted_fields: bool = False) -> Query:
    """Phrases are taken out first, then fields, then what is left is all-of, or any-of around OR.

    As quotes belong to phrases, a field with a quoted value becomes a word and a phrase; with
    quoted_fields it is a filter.
    """
    query, rest = Query(raw), raw

    def fields(text: str, pattern: re.Pattern) -> str:
        parts, at = [], 0
        for found in pattern.finditer(text):
            name, value = found[1].lower(), found[2].strip('"')
            if name in FIELDS:
                query.filters[name] = value
            elif name in DOCKET_PREFIXES:
                query.terms.append(f"{name}:{value.lower()}")
            else:
                continue
            parts.append(text[at : found.start()])
            at = found.end()
        return " ".join([*parts, text[at:]])

    if quoted_fields:
        rest = fields(rest, re.compile(r'\b(\w+):("[^"]*")'))
    query.phrases = [tokens for quoted in _QUOTED.findall(rest) if (tokens := tokenize(quoted))]
    rest = fields(_QUOTED.sub(" ", rest), _FIELD)
    parts = _EITHER.split(rest)
    target = query.should if len(parts) > 1 else query.terms
    target += [token.text for part in parts for token in tokenize(part)]
    return query


def build_query(words: str = "", *, ponente: str = "", division: str = "", year: str = "", until: str = "") -> str:
    """The query of the search form; its last year is not used, and divisions of several words are quoted.

    Give a ponente's last name alone: what follows a space would become a word of the query.
    """
    del until
    quoted = f'"{division}"' if " " in division else division
    fields = [("ponente", ponente), ("division", quoted), ("year", year)]
    return " ".join([words.strip(), *[f"{name}:{value}" for name, value in fields if value]]).strip()
