import unicodedata

import pytest

from lodestone.functions.stemming import measure, stem, stem_column
from lodestone.functions.tokens import scan, term_table, terms_column, token_counts, tokenize


def terms(text, **how):
    return [t.text for t in tokenize(text, **how)]


@pytest.mark.parametrize("text", ["G.R. No. 192393", "G.R. no. 192393", "GR No 192393", "G. R. No. 192393"])
def test_docket_spellings(text):
    assert terms(text) == ["gr:192393"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("G.R. Nos. 192393-95", ["gr:192393-95"]), ("G.R. No. L-45081", ["gr:l-45081"]), ("A.M. No. RTJ-19-2552", ["am:rtj-19-2552"]),
        ("A.C. No. 9218", ["ac:9218"]), ("B.M. No. 3288", ["bm:3288"]), ("Sec. 5", ["sec:5"]), ("Section 5", ["sec:5"]), ("sec 5", ["sec:5"]),
        ("SECS. 5", ["sec:5"]), ("Art. 315(2)(a)", ["art:315(2)(a)"]), ("Article 315 (2) (a)", ["art:315(2)(a)"]), ("Rule 65", ["rule:65"]),
        ("Sec. 5, Rule 65", ["sec:5", "rule:65"]), ("People v. Santos", ["peopl", "vs", "santo"]), ("People vs. Santos", ["peopl", "vs", "santo"]),
        ("the of and a an", []), ("certiorari mandamus habeas corpus res", ["certiorari", "mandamus", "habeas", "corpus", "res"]),
        ("P1,500,000.00 paid on 12 March", ["paid", "march"]), ("Section 5th", ["sec:5t", "h"]), ("I am 5", ["i", "am:5"]), ("bmw320", ["bm:w320"]),
    ],
)
def test_terms(text, expected):
    assert terms(text) == expected


def test_positions_keep_gaps():
    assert [(t.text, t.position) for t in tokenize("grave abuse of discretion")] == [("grave", 0), ("abus", 1), ("discret", 3)]
    assert len(list(scan("grave abuse of discretion"))) == 4


def test_stemming_off_and_composition():
    assert terms("petitions", stemming=False) == ["petitions"]
    assert terms(unicodedata.normalize("NFD", "Piñas")) == terms("Piñas")


@pytest.mark.parametrize("word, n", [("tr", 0), ("ee", 0), ("tree", 0), ("y", 0), ("by", 0), ("trouble", 1), ("oats", 1), ("trees", 1), ("ivy", 1), ("troubles", 2), ("private", 2), ("oaten", 2), ("orrery", 2)])
def test_measure(word, n):
    assert measure(word) == n


STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "matting": "mat", "mating": "mate", "meeting": "meet",
    "milling": "mill", "messing": "mess", "meetings": "meet", "falling": "fall", "sing": "sing", "controll": "control", "roll": "roll", "is": "is", "v": "v",
    "element": "elem", "document": "docum", "judgment": "judgment", "employment": "employ", "party's": "party'", "adoption": "adopt", "yes": "ye",
    "constitutional": "constitut", "notarizing": "notar", "syzygy": "syzygi", "béén": "béén", "playyed": "playi",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS
    assert len({stem(w) for w in ("connect", "connected", "connecting", "connection", "connections")}) == 1


def test_stem_column_agrees(spark):
    words = sorted(STEMS) + ["relational", "hopping", "happy", "y", "yy", "generalizations", "oscillators", "flies", "ties"]
    rows = stem_column(spark.createDataFrame([(w,) for w in words], "w string"), "w", "s").collect()
    assert {r.w: r.s for r in rows} == {w: stem(w) for w in words}


def test_table_agrees_with_strings(spark):
    texts = [
        "G.R. No. 192393 and Sec. 5(a) of the Rules, People v. Santos", "", "ça vs öart5 art 5 Überprüfung naïve", unicodedata.normalize("NFD", "Piñas café"),
        "It’s the party's ‘own’ \u0001\u0002 control gr\u00015", "a covid19 sec. 5 ( b )", "OCA IPI No. 17-4663-P udk-16666 §", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for stemming in (True, False):
        found = sorted(map(tuple, term_table(df, "doc_id", "text", stemming=stemming).collect()))
        assert found == sorted((i, t.position, t.text) for i, x in enumerate(texts) if x for t in tokenize(x, stemming=stemming))


def test_tables_are_made_where_documents_are_read(spark):
    """No row for each token is generated from split texts or shuffled; rows that share a key are merged by position."""
    docs = [(1, "grave abuse of discretion v. courts"), (2, ""), (3, None), (4, "the of"), (5, "courts courts Sec. 5"), (5, "appealed judgments")] * 2
    df = spark.createDataFrame([(k + 10 * (i > 5), t) for i, (k, t) in enumerate(docs)], "doc_id long, text string").repartition(3)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    words = terms_column(df, "doc_id", "text")
    for rows in (words, term_table(df, "doc_id", "text"), token_counts(df, "doc_id", "text")):
        assert "Generate" not in plan(rows) and "MapInArrow" in plan(rows)
    own = ["grave", "abus", "discret", "vs", "court"], ["appeal", "court", "court", "judgment", "sec:5"]
    assert {r.doc_id: r.terms for r in words.collect()} == {1: own[0], 11: own[0], 5: own[1], 15: own[1]}
    counted = {r["value"]: (r["n"], r["first"]) for r in token_counts(df, "doc_id", "text").collect()}
    assert counted["courts"] == (6, 0) and counted["of"] == (4, 1) and counted["sec:5"] == (2, 2) and counted["judgments"] == (2, 1)
