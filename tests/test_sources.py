from pyspark.sql import functions as F

from lodestone.functions import cleaning as C
from lodestone.functions.cleaning import clean, find_citations, find_date
from lodestone.queries import QUERIES
from lodestone.sources import decision as D
from lodestone.sources import html as H
from lodestone.sources import records as X
from lodestone.streaming.landing import ingest

MONTH = """<table><tr><td><a href="gr_1.html">G.R. Nos. 1-2</a>, March 27, 2019</td><td>A v. B, <br>Concurring and Dissenting Opinion <a href="gr_1_x.html">Justice X</a></td><td><a href="gr_1.pdf">pdf</a></td></tr>
<tr><td>heading</td></tr><tr><td><a href="../up.html">x</a></td><td>y</td></tr><tr><td><a href="am_2.html">first</a></td><td>C v. D A.M. No. 12 April 1 2019</td></tr></table>"""
PAGE = """<html><head><title>Case EN BANC</title><style>p{}</style></head><body><p>G.R. No. 1</p><p>A LONG CAPTION OF PARTIES, PETITIONERS, v. OTHERS</p><p>March 27, 2019</p><p>R E S O L U T I O N</p>
<p>PERLAS-BERNABE, <i>S.A.J.</i>:</p><p>The fac<cite>zz</cite>ts.<br>Next line.</p><p>WHEREFORE, denied.</p><p class="jn">1 note</p><p>2 note</p>
<div id="so">♦ Concurring Opinion, <a href="op.html">Caguioa, [J]</a></div></body></html>"""


def test_decode_and_clean():
    assert H.decode(b"\xef\xbb\xbfa") == "a" and H.decode(b"it\x92s") == "it’s" and H.decode(b"\x81") == "\x81"
    assert clean(" a  b \r\n\r\n\r\n\r\n c ") == "a b\n\nc" and clean(clean("a \t\n b")) == "a\nb"
    assert find_date("on MARCH 5 2019, and May 1, 2020") == "2019-03-05" and find_date("February 30, 2019") is None
    assert find_citations("G.R. No. 5, A.C. No. 9218; G.R. No. 5.") == ["G.R. No. 5", "A.C. No. 9218"]
    assert H.links("<a href=' x '>1</a><a name=y>2</a>") == ["x"]
    assert H.page_text("<p>a<script>b</script></p><p>c") == "a c"


def test_listing():
    first, second = D.listing_rows(MONTH)
    assert first == {"row": 0, "decision_file": "gr_1.html", "citations": ["G.R. Nos. 1-2"], "caption": "A v. B", "promulgated": "2019-03-27", "opinion_files": ["gr_1_x.html"]}
    assert (second["citations"], second["promulgated"]) == (["A.M. No. 12"], "2019-04-01")


def parsed(spark, *pages):
    rows = spark.createDataFrame([(k, "mar", file, html) for k, (file, html) in enumerate(pages)], "year int, month string, file string, html string")
    return X.parsed_pages(rows).orderBy("year").collect()


def test_decision(spark):
    page, own, empty = parsed(spark, ("", PAGE), ("OP.html", PAGE), ("x", ""))
    assert (page.kind, page.division, page.ponente) == ("RESOLUTION", "En Banc", "Perlas-Bernabe, S.A.J.")
    assert page.caption == "A LONG CAPTION OF PARTIES, PETITIONERS, v. OTHERS" and page.citations == ["G.R. No. 1"]
    assert page.body == "The fac\nts.\nNext line.\n\nWHEREFORE, denied." or page.body == "The fac ts.\nNext line.\n\nWHEREFORE, denied."
    assert page.footnotes == "1 note\n2 note" and D.outline(PAGE)["siblings"] == [{"kind": "Concurring Opinion", "justice": "Caguioa, [J]", "href": "op.html"}]
    assert (own.kind, own.ponente) == ("CONCURRING OPINION", "Caguioa, J.")
    assert (empty.body, empty.kind, empty.caption, empty.citations, empty.division, empty.ponente) == ("", "", "", [], None, None)


def page_of(*paragraphs, title="", before=""):
    return f"<title>{title}</title>{before}" + "".join(p if p.startswith("<p") else f"<p>{p}" for p in paragraphs)


def test_roles_of_paragraphs(spark):
    """Headings, notes, divisions, bylines and captions of every form, from rules taken one by one."""
    cases = [
        # without a heading, six paragraphs are the header and all of them the body
        (page_of("one", "two", "three", "four", "five", "G.R. No. 6", "G.R. No. 7"), {"kind": "", "citations": ["G.R. No. 6"], "body": "one\n\ntwo\n\nthree\n\nfour\n\nfive\n\nG.R. No. 6\n\nG.R. No. 7"}),
        (page_of("D E C I S I O N", "PER CURIAM:", "text", "O R D E R"), {"kind": "DECISION", "ponente": "Per Curiam", "body": "text\n\nO R D E R"}),
        (page_of("SEPARATE CONCURRING OPINION", "DE LOS SANTOS, J.:", "x"), {"kind": "SEPARATECONCURRINGOPINION", "ponente": "De Los Santos, J.", "body": "x"}),
        (page_of("ORDER", "O'BRIEN-CRUZ, C.J.:", "x"), {"ponente": "O'Brien-Cruz, C.J."}), (page_of("ORDER", "PEÑA, J :", "x"), {"ponente": "Peña, J."}),
        (page_of("ORDER", "WHEREFORE: it is", "x"), {"ponente": None, "body": "WHEREFORE: it is\n\nx"}), (page_of("ORDER", "SANTOS: no suffix", "x"), {"ponente": None}),
        (page_of("ORDER", "CRUZ, J.: " + "y" * 75), {"ponente": None}), (page_of("ORDER", "CRUZ, J.: y"), {"ponente": "Cruz, J.", "body": ""}),
        (page_of("first division", "ORDER", "x", title="EN BANC"), {"division": "First Division"}), (page_of("ORDER", "x", title="the  en  banc page"), {"division": "En Banc"}),
        (page_of("SPECIAL THIRD DIVISION", "ORDER"), {"division": "Special Third Division"}), (page_of("SPECIAL DIVISION", "ORDER"), {"division": "Special Division"}),
        (page_of("ORDER", "a", "F o o t n o t e s", "n1", "n2"), {"body": "a", "footnotes": "n1\nn2"}), (page_of("ORDER", "a", "<p class='FN x'>n1", "n2"), {"body": "a", "footnotes": "n1\nn2"}),
        (page_of("<p class=jn>early", "ORDER", "a", "<p class='x jn'>b"), {"body": "a\n\nb", "footnotes": ""}), (page_of("ORDER", "FOOTNOTES"), {"body": "", "footnotes": ""}),
        (page_of("A PARTY OF SOME LENGTH, versus", "ANOTHER PARTY OF SOME LENGTH", "ORDER"), {"caption": "A PARTY OF SOME LENGTH, versus"}),
        (page_of("March 27, 2019 and a few more words", "A PARTY OF SOME LENGTH [.", "ORDER"), {"caption": "A PARTY OF SOME LENGTH"}),
        (page_of("x" * 24, "SECOND DIVISION of the court here", "ORDER"), {"caption": ""}), (page_of("February 31, 2019 is no day at all", "ORDER"), {"caption": "February 31, 2019 is no day at all"}),
        (page_of("ORDER OF MORE THAN SIXTY CHARACTERS " + "X" * 30 + " OPINION", "a"), {"kind": "", "body": "ORDER OF MORE THAN SIXTY CHARACTERS " + "X" * 30 + " OPINION\n\na"}),
    ]
    for row, (html, expected) in zip(parsed(spark, *(("f.html", html) for html, _ in cases)), cases):
        assert {k: row[k] for k in expected} == expected, html


def test_lists_of_opinions(spark):
    block = "<div id=so>♦ Dissenting Opinion, <a href=a.html>CRUZ, [C.J.]</a><br>\n◆ Separate Opinion <a href=' B.html '>Leonen</a> <a name=x>no</a>\n<a href=c.html>Reyes, JJ</a></div>"
    found = D.outline(page_of("ORDER", before=block))["siblings"]
    assert found[0] == {"kind": "Dissenting Opinion", "justice": "CRUZ, [C.J.]", "href": "a.html"} and found[1] == {"kind": "Separate Opinion", "justice": "Leonen", "href": "B.html"}
    assert found[2]["kind"] == "Leonen no" and D.outline("<p>x")["siblings"] == []
    rows = parsed(spark, *((f, page_of("D E C I S I O N", "SANTOS, J.:", "x", before=block)) for f in ("A.HTML", "b.html", "c.html", "other.html")))
    assert [(r.kind, r.ponente) for r in rows] == [("DISSENTING OPINION", "Cruz, C.J."), ("SEPARATE OPINION", "Leonen, J."), ("LEONEN NO", "Reyes, JJ."), ("DECISION", "Santos, J.")]
    heads = spark.createDataFrame([("CONCURRING-OPINION in part", "Cruz, J."), ("", None), (None, "X"), ("CONCURRINGOPINION", "")], "k string, p string")
    assert [r[0] for r in heads.select(D.opinion_head(F.col("k"), F.col("p"))).collect()] == ["Concurring-Opinion In Part — Cruz, J.", "Separate Opinion", "Separate Opinion — X", "Concurringopinion"]


def test_records_and_stream(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "2019" / "_index").mkdir(parents=True)
    (raw / "2019" / "mar").mkdir()
    (raw / "2019" / "_index" / "mar2019.html").write_text(MONTH)
    (raw / "2019" / "_index" / "juri2019.html").write_text("<a href='mar2019/mar2019.html'>x</a>")
    (raw / "2019" / "mar" / "gr_1.html").write_text(PAGE)
    records, problems = X.build_records(X.raw_pages(spark, str(raw)))
    row = records.first()
    assert (row.doc_id, row.gr_number, str(row.promulgated), row.separate_opinions) == (0, "G.R. Nos. 1-2", "2019-03-27", [])
    assert {r.kind: r.n for r in X.problem_report(problems).collect()} == {"missing-html": 1, "missing-opinion": 1}
    text = X.report(records, problems, X.listing(X.raw_pages(spark, str(raw)).where("is_index"))).splitlines()
    assert text[:4] == ["months read        1", "index rows         2", "records written    1", "separate opinions  0"] and "date range         2019-2019" in text
    assert text[-2:] == ["   missing-html: 2019/mar/am_2.html", "   missing-opinion: 2019/mar/gr_1_x.html"] and " * gr_number               1 / 1  100.0%" in text
    X.write_records(records, str(tmp_path / "records"))
    assert X.read_records(spark, str(tmp_path / "records")).first().body == row.body
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for files, expected in (({}, 1), ({"gr_2.html": PAGE}, 2)):
        for name, text in files.items():
            (raw / "2019" / "mar" / name).write_text(text)
        ingest(spark, str(raw), target, state).awaitTermination(120)
        assert spark.read.parquet(target).count() == expected


def test_whole_texts(spark, tmp_path):
    """What stands far behind the first characters of a document counts."""
    text = "ab  c\n" * 3000 + "see G.R. No. 777 and more"
    spark.createDataFrame([(2, text, "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    own = lambda name: {r.doc_id: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert own("squash_text") == {2: "ABC" * 3000 + "SEEG.R.NO.777ANDMORE", 3: None}
    assert own("citations_extract") == {2: "G.R. Nos. 2-95|G.R. No. 777|A.C. No. 9218", 3: "g.r. no. 13"}
    assert own("strip_opinion_tail") == {2: "Case 2 v. State", 3: "Case 3 v. State"}


def test_digests_are_no_dockets(spark):
    """A secret that begins like a docket is none; dockets written in one word stay."""
    text = 'token = "ac04fe8a83dc38377d0181a78c05d34dc3ead7f8"; ace4fb09ab1 and GR192393, A.C.04fe1, udk14a, AC No. 5b6'
    expected = ["GR192393", "A.C.04fe1", "udk14a", "AC No. 5b6"]
    assert find_citations(text) == expected
    assert spark.createDataFrame([(text,)], "t string").select(C.citations_column(F.col("t"))).first()[0] == expected


def test_pages_are_parsed_once(spark):
    """Records and problems are joined from stored rows; no plan of theirs parses a page again."""
    pages = spark.createDataFrame([(2019, "mar", "mar2019.html", True, MONTH), (2019, "mar", "gr_1.html", False, PAGE)], "year int, month string, file string, is_index boolean, html string")
    for rows in X.build_records(pages):
        assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() >= 1


def test_month_pages_are_dealt_out(spark):
    """Pages that an aggregate has left in one partition are parsed by many tasks."""
    pages = spark.createDataFrame([(2000 + k, "mar", MONTH) for k in range(40)], "year int, month string, html string").coalesce(1)
    tasks = [r[0] for r in X.listing(pages).groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 8 and X.listing(pages).count() == 80
