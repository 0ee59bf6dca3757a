"""Pages of a court register on small pages."""

from versed.sources import court_pages


def test_case_lists(spark):
    link = '<a href="fiche.jsf?id={}&amp;num={}&amp;x=1">x</a>'
    one = "<p>Search result: <b>2</b> case(s)</p> [Case in progress] " + link.format("c1", "C-605%2F26%20P") + link.format("c2", "C-605%2F26")
    bare = "Search result: 1 case(s) [Case closed] <a href='fiche.jsf?id=c9'>x</a>"
    pages = spark.createDataFrame([(1, one, "c-605/26"), (2, one, "C-1/26"), (3, one, None), (4, bare, "C-1/26"), (5, "Search result: 0 case(s)", "C-1/26"), (6, "hello", "C-1/26"), (7, None, None)], "id int, html string, n string")
    got = {r["id"]: tuple(r)[1:] for r in court_pages.case_lists(pages, "id", "html", "n").collect()}
    assert got == {
        1: ("ok", 2, "c2", "in_progress"), 2: ("number_mismatch", 2, None, "in_progress"), 3: ("ok", 2, "c1", "in_progress"), 4: ("ok", 1, "c9", "closed"),
        5: ("no_case", 0, None, None), 6: ("unexpected_page", None, None, None), 7: ("unexpected_page", None, None, None),
    }


def test_case_cards(spark):
    page = """<div class="x details_decision_title"> A &amp; B <br>C-1/26</div><h3>Subject matter</h3><ul><li>Agriculture</li><li>- Direct payments</li><li>Fish</li></ul>
    <h3>Date of the hearing</h3><p>02/03/2024</p><h3>Date of delivery</h3><p>Information not available</p><h2>Other</h2><p>no</p>
    <h3>Source of the question referred for a preliminary ruling</h3><p>Court of X - Y - France</p><h3>Procedure and result</h3><ul><li>one</li><li>two</li></ul><h3>Name of the parties</h3><p>first</p><h3>Name of the parties</h3><p>second</p>"""
    rows = {r["id"]: r for r in court_pages.case_cards(spark.createDataFrame([(1, page), (2, "<h3>Subject matter</h3>"), (3, None)], "id int, html string"), "id", "html").collect()}
    r = rows[1]
    assert (r["status"], r["case_name"], r["subject_matter"], str(r["hearing_on"]), r["delivered_on"]) == ("ok", "A & B", ["Agriculture - Direct payments", "Fish"], "2024-03-02", None)
    assert (r["referring_court"], r["referring_state"], r["procedure"], r["parties"], r["language_of_case"], r["judge_rapporteur"]) == ("Court of X - Y", "France", "one; two", "first", [], None)
    assert rows[2]["status"] == rows[3]["status"] == "unexpected_page" and rows[3]["subject_matter"] == []


def test_case_documents(spark):
    row = '<tr class="table_document_ligne"><td>C-1</td><td>{}<span class="outputEcli">{}</span></td><td>{}</td><td>{}</td></tr>'
    links = '<a href="/j/document.jsf;jsessionid=9?docid=1&amp;cid=5">x</a><div class="tooltip"><a href="showPdf.jsf">fr</a></div><a href="https://eur-lex.europa.eu/a">e</a>'
    page = "<p>3 document(s)</p>" + row.format("Order", "", "05/01/2024", "") + row.format(" Judgment\n x ", "ECLI:1", "04/01/2024", links) + '<tr class="table_document_ligne"><td>short</td></tr>'
    got = {r["id"]: r for r in court_pages.case_documents(spark.createDataFrame([(1, page), (2, "x"), (3, None)], "id int, html string"), "id", "html", "https://curia.test/juris").collect()}
    r = got[1]
    assert (r["status"], r["declared"], r["complete"], [(d["day"], d["title"], d["ecli"]) for d in r["documents"]]) == ("ok", 3, False, [("2024-01-04", "Judgment x", "ECLI:1"), ("2024-01-05", "Order", None)])
    assert sorted(r["documents"][0]["links"].values()) == ["https://curia.test/j/document.jsf?docid=1", "https://eur-lex.europa.eu/a"]
    assert got[2]["status"] == got[3]["status"] == "unexpected_page" and got[2]["documents"] is None
