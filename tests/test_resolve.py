"""Resolution of what a user wrote, and units of marked-up pages."""

from pyspark.sql import functions as F

from versed.functions import markup
from versed.operators import resolve


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_parents(spark):
    assert one(spark, ["Agriculture", "- Payments", "Tax"], resolve.with_parents, "array<string>") == ["Agriculture - Payments", "Tax"]
    assert one(spark, ["A", "B", "-x"], resolve.with_parents, "array<string>") == ["A", "B - x"]
    assert one(spark, [], resolve.with_parents, "array<string>") == []


def test_titles(spark):
    rows = spark.createDataFrame([(1, "Про мову", 1, "Закон України «Про мову»"), (1, "Про мову", 2, "Про мову"), (2, "xyz", 1, "Про мову")], "r int, w string, seq int, t string")
    assert [(x["r"], x["seq"], x["title_score"]) for x in resolve.best_title(rows, "r", "w", "t", "seq").collect()] == [(1, 1, 3)]
    assert one(spark, "Zakon Rada document 5", lambda x: resolve.is_placeholder(x, F.lit("5"))) is True


def test_aliases(spark):
    aliases = spark.createDataFrame([("кодекс праці", "322-08"), ("закон про мову", "2704-19"), ("цк", "435-15")], "alias string, law_id string")
    q = spark.createDataFrame([("435-15",), ("ЦК",), ("про мову",), ("праці",), ("нічого",)], "q string")
    assert sorted((r["q"], r["law_id"], r["matched_by"]) for r in resolve.by_alias(q, "q", aliases).collect()) == [
        ("435-15", "435-15", "id"), ("ЦК", "435-15", "alias"), ("праці", "322-08", "containment"), ("про мову", "2704-19", "containment")]  # beginnings are replaced, never added


def test_cascade(spark):
    a = spark.createDataFrame([(1, "a")], "r int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b"), (2, "c")], "r int, v string")
    assert sorted((x["r"], x["v"], x["stage"]) for x in resolve.cascade([a, b], "r", F.col("v")).collect()) == [(1, "a", 0), (2, "b", 1)]


def test_small_ones(spark):
    assert one(spark, "254к/96-вр", resolve.is_official) is True and one(spark, "два слова", resolve.is_official) is False
    assert one(spark, "https://zakon.rada.gov.ua/laws/show/254%D0%BA/96", resolve.official_from_url) == "254к"
    assert one(spark, "Court of X - Y - Italy", lambda x: F.array(*resolve.court_and_state(x))) == ["Court of X - Y", "Italy"]
    assert one(spark, "http://a/b;jsessionid=1?x=1&cid=5", resolve.without_session) == "http://a/b?x=1"
    assert one(spark, "105-19860627-JUD-01-00-EN", resolve.icj_parts)["kind"] == "judgment" and one(spark, "x", resolve.icj_parts) is None
    assert one(spark, "https://data.gov.ua/x", lambda x: resolve.allowed_url(x, ("data.gov.ua",))) is True
    assert one(spark, "http://data.gov.ua/x", lambda x: resolve.allowed_url(x, ("data.gov.ua",))) is False


PAGE = """<html><div class="eli-subdivision" id="art_5"><p>Article 5</p><div id="005.001"><p>1. First &amp; one</p><table><tr><td>(a)</td><td>sub a</td></tr><tr><td>(b)</td><td>sub b</td></tr></table></div></div>
<div class="eli-subdivision" id="art_6a"><div class="norm"><span class="no-parag">2.  </span><div class="inline-element">Second<br>part</div></div></div><div id="anx_II">Annex text</div>
<table><tr><td><p id="point7">7</p></td><td>Seventh point</td></tr></table><p class="C01PointnumeroteAltN">45&nbsp;&nbsp;Old point</p></html>"""


def test_units():
    got = {u: t for u, _, t in markup.units(PAGE)}
    assert got["art_5(a)"] == "sub a" and got["art_5.1(b)"] == "sub b" and got["art_6a.2"] == "Secondpart"
    assert got["anx_II"] == "Annex text" and got["point_7"] == "Seventh point" and got["point_45"] == "Old point"
    assert markup.units(None) == [] and markup.units("<div id='art_1'") == []


def test_units_without_ids_of_articles():
    statute = "<div><p class='ti-art'>Article 23</p><p>One</p><p>two</p><p class='ti-art'>Article 23a (new)</p><p>Three</p></div>"
    assert markup.units(statute) == [("art_23", "article", "One two"), ("art_23a", "article", "Three")]
    cells = "<table><tr><td><p>5.</p></td><td><p>Write clearly</p></td></tr></table>"
    assert markup.units(cells) == [("point_5", "practice", "Write clearly")]
    assert markup.units(cells + "<p>Article 1</p>") == [] and [u for u, _, _ in markup.units(cells + "<p id='art_1'>x</p>")] == ["art_1"]
    old = "<div id='TexteOnly'><p>1 before</p><a name='MO'/><p>1 First<p>1968 Convention provides</p><p>3 no</p><p>2 Second</p><h2><a name='CO'/></h2><p>3 Costs</p></div>"
    assert [(u, t) for u, _, t in markup.units(old)] == [("point_1", "First"), ("point_2", "Second"), ("point_3", "Costs")]


def test_titles_judgments_and_notices():
    page = "<body><p class='oj-doc-ti'><span class='oj-bold'>REGULATION</span> X</p><p class='oj-doc-ti'>of 27 April</p><p class='oj-doc-ti'>more</p><div id='judgment'>Held  so</div></body>"
    assert markup.act_title(page) == "REGULATION X of 27 April" and markup.act_title("<p>x</p>") == "" and markup.act_title(None) == ""
    assert len(markup.act_title(f"<p class='oj-ti-tbl'>{'x' * 400}</p><p class='oj-ti-tbl'>y</p>")) == 300
    assert markup.judgment_text(page) == "Held so" and markup.judgment_text("a<body>b</body>") == "b" and markup.judgment_text("a <i>b</i>") == "a b" and markup.judgment_text(None) == ""
    uri = "<SAMEAS><URI><TYPE>{}</TYPE><IDENTIFIER>{}</IDENTIFIER></URI></SAMEAS>".format
    notice = f"<NOTICE><WORK><R>{uri('celex', ' 1 ')}</R><R>{uri('consolidation', '2')}</R><S>{uri('celex', '3')}<WORK><R>{uri('celex', '4')}</R></WORK></S></WORK></NOTICE>"
    assert markup.notice_links(notice, "R") == ["1"] and markup.notice_links("<NOTICE><WORK/></NOTICE>", "R") == []
    assert markup.notice_links("<html/>", "R") is None and markup.notice_links(None, "R") is None


def test_practice_points_are_found_by_number(spark):
    table = markup.unit_table(spark.createDataFrame([(1, "<table><tr><td><p>5.</p></td><td>Write</td></tr></table>")], "k int, h string"), "k", "h")
    asked = spark.createDataFrame([(1, "5"), (1, "point 5"), (1, "6")], "k int, l string")
    assert {r["l"]: r["status"] for r in markup.find(table, "k", asked, "l").collect()} == {"5": "ok", "point 5": "ok", "6": "path_not_found"}


def test_unit_lookup(spark):
    table = markup.unit_table(spark.createDataFrame([(1, PAGE), (2, None)], "k int, h string"), "k", "h")
    asked = spark.createDataFrame([(1, "5"), (1, "5(1)(A)"), (1, "annex 2"), (1, "9"), (2, "5")], "k int, l string")
    assert {(r["k"], r["l"]): r["status"] for r in markup.find(table, "k", asked, "l").collect()} == {(1, "5"): "ok", (1, "5(1)(A)"): "ok", (1, "annex 2"): "ok", (1, "9"): "path_not_found", (2, "5"): "path_not_found"}


LEGACY = """<div><p class='modref'>&#9660;B</p><p class='title-article-norm'>Article 1</p><p class='norm'>1. One</p><p class='modref'>M1</p><p class='norm'>more <p class='modref'>M2</p></p><p class='norm'>3. no third yet</p><p class='norm'>2. Two</p>
<div class='grid'><div class='grid-list-column-1'>(a)</div><div class='grid-list-column-2'>grid a</div></div><p class='title-article-norm'>Article 1</p><p>again</p><p class='title-article-norm'>2. pants</p><p>(b) plain b</p>
<table><tr><th>B</th><td>x</td></tr><tr><td>c</td><td>cell c</td></tr></table><p class='title-annex-1'>ANNEX II</p><p>A list</p><p class='title-annex-2'>PART</p><p>rest</p></div>"""


def test_units_of_older_consolidations(spark):
    got = {u: t for u, _, t in markup.units(LEGACY)}
    assert got == {
        "art_1": "Article 1 1. One more 3. no third yet 2. Two (a)grid a", "art_1(a)": "grid a", "art_1.1": "One more 3. no third yet", "art_1.2": "Two (a)grid a", "art_1.2(a)": "grid a",
        "art_2": "2. pants (b) plain b B x c cell c", "art_2(b)": "plain b", "art_2(c)": "cell c", "anx_II": "ANNEX II A list",
    }
    table = markup.unit_table(spark.createDataFrame([(1, LEGACY)], "k int, h string"), "k", "h")
    asked = spark.createDataFrame([(1, x) for x in ("1", "1(2)(a)", "annex II", "3", "1(3)", "2(1)")], "k int, l string")
    assert {r["l"]: r["status"] for r in markup.find(table, "k", asked, "l").collect()} == {"1": "ok", "1(2)(a)": "ok", "annex II": "ok", "3": "path_not_found", "1(3)": "path_not_found", "2(1)": "path_not_found"}
    assert markup.units("<p class='title-article-norm'>Article</p>") == [] and markup.units("<p class='title-annex-1'>ANNEX</p>") == []
