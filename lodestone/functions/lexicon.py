"""Word lists and patterns that decide what is a term."""

from __future__ import annotations

# Results depend on exactly these words and patterns.
STOPWORDS = frozenset(
    """
    a an the and or but if then than that this these those
    of to in on at by for with from as into onto upon
    is are was were be been being am
    it its they them their there here he she his her him we us our you your
    which who whom whose what when where while
    such so also thus hence however moreover furthermore
    have has had having do does did done
    said same other another any each both all some more most
    """.split()
)
PROTECTED = frozenset(
    """
    certiorari mandamus prohibition quo warranto habeas corpus
    res judicata litis pendentia forum shopping
    prima facie mala prohibita se
    dolo culpa delicto flagrante
    amicus curiae stare decisis obiter dictum dicta ratio decidendi
    ultra vires nunc pro tunc pro hac vice
    ex parte ex post facto ipso facto de facto de jure
    quo alibi animus mens rea actus reus
    ponente ponencia en banc
    """.split()
)
DOCKET_KIND = r"g\.?\s?r\.?|a\.?\s?m\.?|a\.?\s?c\.?|b\.?\s?m\.?|oca\s+ipi|udk"
DOCKET_LINK = r"\s*(?:nos?\.?)?\s*"
DOCKET_NUMBER = r"[a-z]{0,4}-?\d[\w\-]*"
SECTION_KIND = r"sections?|secs?\.?|articles?|arts?\.?|rules?|pars?\.?|paragraphs?"
SECTION_NUMBER = r"\d+[a-z]?"
SECTION_SUBS = r"(?:\s*\(\s*[\da-z]{1,4}\s*\))*"
VERSUS = r"\bvs?\.(?=\s)|\bvs\b"
WORD = r"[a-z0-9ñáéíóúü]+(?:['’][a-z]+)?"
FIELDS = frozenset({"ponente", "year", "division", "docket"})
DOCKET_PREFIXES = frozenset({"gr", "am", "ac", "bm", "udk", "ocaipi"})

#: One pass over a text: seven groups, of which a docket fills two, a section three, the rest one.
SCANNER = rf"({DOCKET_KIND}){DOCKET_LINK}({DOCKET_NUMBER})|\b({SECTION_KIND})\s*({SECTION_NUMBER})({SECTION_SUBS})|({VERSUS})|({WORD})"
