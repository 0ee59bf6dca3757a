"""Text functions against literal cases."""

from pyspark.sql import functions as F

from versed.functions import python as P
from versed.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens_stems_and_stop_words(spark):
    assert one(spark, "про суд та вирок -", T.query_tokens) == ["суд", "вирок"]
    assert one(spark, "відкликані", T.stem) == "відклик"
    assert one(spark, "ліцензії", T.stem) == "ліцен"
    assert one(spark, "суд", T.stem) == "суд"


def test_density_needs_every_token(spark):
    assert one(spark, "a b a", lambda x: T.density(x, ["a", "zz"])) == 0.0
    assert round(one(spark, "a b a b", lambda x: T.density(x, ["a", "b"])), 6) == 1000.0
    assert one(spark, "", lambda x: T.density(x, ["a"])) == 0.0


def test_article_reference(spark):
    assert one(spark, "див. ст. 179–1 кодексу", T.article_reference) == "179-1"
    assert one(spark, "нічого", T.article_reference) == ""


def test_quote_normalisation(spark):
    assert one(spark, " «a» –​ ’b’\n c­ ", T.normal_quote) == "\"a\" - 'b' c"


def test_stub_kinds(spark):
    prose = "слово " * 50
    cases = {
        "  ": "empty", "x CAPTCHA y": "antibot_challenge", "Access Denied": "access_denied", "404 not found": "error_page",
        "Table of contents": "table_of_contents", "Table of contents\n" + prose + prose: "none", "\n".join(f"{k}. item" for k in range(14)): "table_of_contents",
        "ab " * 20: "too_short", prose + prose: "none",
    }
    for text, kind in cases.items():
        assert one(spark, text, T.stub_kind) == kind, text


def test_heading(spark):
    def head(body):
        return one(spark, body, lambda x: T.heading(x, F.lit("179-1")))

    assert head("Стаття 179\n-\n1\n.\nПоняття речі\nтекст") == "Стаття 179-1. Поняття речі"
    assert head("1\n.") == "Стаття 179-1"


def test_document_kind(spark):
    def kind(text, ident="x", code=None):
        return one(spark, text, lambda x: T.document_kind(x, F.lit(ident), F.lit(code).cast("string")))

    assert kind("a; Закон від 04.04.1996 № 1") == "law"
    assert kind("a; Кодекс України, Закон від 05.04.2001 № 2") == "code"
    assert kind("нічого", "1178-2022-п") == "bylaw"
    assert kind("КОДЕКС УКРАЇНИ\nтекст") == "code"
    assert kind("x", code="216") == "constitution"
    assert kind("x") == "unknown"


def test_sections():
    text = "Стаття 179. Річ\nтекст\nСтаття 179\n-\n1\n. Цифрова річ\nСтаття 180. Ще\n\"\nСтаття 5. Чужа"
    found = {num: body for num, _, body, _ in P.parse_sections(text)}
    assert list(found) == ["179", "179-1", "180"]
    assert P.parse_sections("Стаття 1. А\n1. Б\n2. В") == []
    assert [r[0] for r in P.parse_sections("1. Аб\n2. Вг\n3. Де")] == ["1", "2", "3"]


def test_chunks_do_not_flush_before_a_cut():
    pieces = [body for _, _, body in P.chunks("aaa\n\n" + "x" * 450, 200)]
    assert pieces == ["x" * 200, "x" * 200, "aaa\n\n" + "x" * 50]
    assert P.chunks("  ") == []


def test_sequential_numbers():
    assert [n for n, _ in P.sequential("1. a\n2. b\n3. c\n1. d\n4. e\n5. f\n1. g")] == [1, 2, 3, 4, 5]


def test_visible_text():
    assert P.visible_text("<p>Hello <b>world</b></p><script>x</script>") == "Hello\nworld"
    assert P.visible_text(None) == ""


def test_quote_match():
    text = "Договір укладено у письмовій формі, якщо сторони — дійшли згоди."
    assert P.match_quote(text, "коротка цитата")[0][0] == "refused"
    assert P.match_quote(text, "укладено у письмовій")[0][:3] == ("exact", 8, 20)
    status, start, size, rules, *_ = P.match_quote(text, "якщо сторони - дійшли згоди")[0]
    assert (status, rules) == ("normalized", "dashes") and text[start : start + size] == "якщо сторони — дійшли згоди"
    status, _, _, _, diff, _ = P.match_quote(text, "якщо сторони — досягли згоди")[0]
    assert status == "mismatch" and "[-дійшли-]{+досягли+}" in diff
    assert P.match_quote("a" * 200_001, "b" * 20)[0] == ("mismatch", None, None, None, None, "nothing_in_common")


def test_flat_rows(spark):
    rows = spark.createDataFrame([(1, "1. Аб\n2. Вг\n3. Де"), (2, None)], "id long, t string")
    out = P.flat(rows, ["id"], ["t"], "num string, ordinal long, body string, mode string", P.parse_sections).orderBy("ordinal").collect()
    assert [(r["id"], r["num"], r["mode"]) for r in out] == [(1, "1", "points"), (1, "2", "points"), (1, "3", "points")]


def test_sequential_without_numbers():
    assert P.sequential("no numbers") == P.sequential(None) == []


def test_real_title(spark):
    assert one(spark, "Документ 5\nПро лікарські засоби | від 04.04.1996 № 123 (Текст)", T.real_title) == "Про лікарські засоби"
    assert one(spark, "Про затвердження порядку...\nx\nПро затвердження порядку видачі", T.real_title) == "Про затвердження порядку видачі"
    assert one(spark, None, T.real_title) == ""


def test_every_kind_of_space(spark):
    spaces = "\u00a0\u202f\u2007\u2009\u2008\u2005\u2002\u2003\u2004\u2006"
    assert one(spark, f"a{spaces}b\u200a\u3000\u0085c", T.normal_quote) == "a b c"
    words = "перше слово третє"
    assert P.match_quote("перше\u00a0слово\u2009третє", words)[0][3] == "nbsp"
    assert P.match_quote("перше\u3000слово третє", words)[0][3] == "whitespace"
