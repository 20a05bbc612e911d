import pytest

from lodestone.plans.query import build_query, parse

TRACES = [
    ("grave abuse of discretion", "grave abus discret", "", [], {}),
    ('"doctrine of condonation"', "", "", [[("doctrin", 0), ("condon", 2)]], {}),
    ("res judicata", "res judicata", "", [], {}),
    ("constructive dismissal illegal dismissal backwages", "construct dismiss illeg dismiss backwag", "", [], {}),
    ('"real party in interest"', "", "", [[("real", 0), ("parti", 1), ("interest", 3)]], {}),
    ("G.R. No. 192393", "gr:192393", "", [], {}),
    ("gr:176831", "gr:176831", "", [], {}),
    ("Rule 65 certiorari", "rule:65 certiorari", "", [], {}),
    ("ponente:Caguioa year:2019", "", "", [], {"ponente": "Caguioa", "year": "2019"}),
    ('division:"En Banc" constitutional', "divis constitut", "", [[("en", 0), ("banc", 1)]], {}),
    ("People v. Santos", "peopl vs santo", "", [], {}),
    ("can a lawyer be disbarred for notarizing a document without a commission", "can lawyer disbar notar docum without commiss", "", [], {}),
    ("mandamus OR certiorari", "", "mandamus certiorari", [], {}),
    ("sec:5", "sec", "", [], {}),
    ("the of and", "", "", [], {}),
]


@pytest.mark.parametrize("raw, terms, should, phrases, filters", TRACES)
def test_traces(raw, terms, should, phrases, filters):
    q = parse(raw)
    assert (" ".join(q.terms), " ".join(q.should), q.slots(), q.filters) == (terms, should, phrases, filters)


def test_more():
    assert parse("the of and").is_empty
    assert parse('division:"En Banc" x', quoted_fields=True).filters == {"division": "En Banc"}
    assert parse("year:2010 year:2011").filters == {"year": "2011"}
    assert parse("dismissal dismissal").weights == {"dismiss": 2}
    assert build_query("estafa", ponente="Leonen", division="En Banc", year="2019", until="2020") == 'estafa ponente:Leonen division:"En Banc" year:2019'
