import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkflow.llm import encoding

CLEAN = [
    "Die hölzerne Brücke an der Küste ist vergrößert worden – „schön“, sagt er.",
    "À l’entrée du village, « l’été » fut célébré à côté du musée.",
    "SÃO 4749 pessoas: a informação em frente à igreja foi incluída",
    "¿Quién diría que la niña añadía 12 £ a 30 €?",
    "Łagodna książka została pokazana, późną jesienią",
    "plain ascii",
    "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert not encoding.damaged(text)
    assert encoding.restore(text)[:3] == (text, 0, 0)


@pytest.mark.parametrize("text", [t for t in CLEAN if not t.isascii()])
@pytest.mark.parametrize("pair", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("times", [1, 2])
def test_round_trip(text, pair, times):
    bad = text
    try:
        for _ in range(times):
            raw = bad.encode()
            bad = raw.decode("cp1252", "linkflow-latin") if pair == "cp1252" else raw.decode(pair)
    except UnicodeDecodeError:
        pytest.skip("the charset lacks a byte")
    assert encoding.damaged(bad)
    if times == 1:
        assert encoding.restore(bad)[0] == text


@pytest.mark.parametrize("text", ["Łagodna książka została pokazana, późną jesienią", "SÃO PAULO: a informação em frente à igreja não foi incluída", "Łódź, Ňufáček и ярко, „Да“", "Иван Иванович жил у реки, и сад"])
@pytest.mark.parametrize("pair", ["cp1250", "cp1251", "cp1252"])
@pytest.mark.parametrize("times", [1, 2])
def test_round_trip_of_bytes_that_the_charset_lacks(text, pair, times):
    bad = text
    for _ in range(times):
        bad = bad.encode().decode(pair, "linkflow-latin")
    assert encoding.damaged(bad)
    assert encoding.restore(bad)[0] == text


@pytest.mark.parametrize("run", ["Ĺ\x81", "Ä‚Â§Ä‚Ĺ\x81", "Ä‚Ĺ\x81"])
def test_lacking_bytes_of_cp1250_have_an_inverse(run):
    assert encoding.invert(run, "cp1250") is not None and encoding.invert("\x81", "cp437") is None


def test_part_of_a_text():
    got = encoding.restore("Größe und Ã¼bergroÃŸ, ganz normal")
    assert got[0] == "Größe und übergroß, ganz normal" and got[1] == 2


def test_lost():
    assert encoding.damaged("f�r") and encoding.restore("f�r")[1:3] == (0, 1)
    assert encoding.restore(None) == (None, 0, 0, "")


def test_records(spark, crawl):
    df = crawl(
        [
            ("http://e.test/1", "<body>\n<p>SÃ¼dliche BrÃ¼cke</p>"),
            ("http://e.test/2", "<body>\n<p>S&#195;&#188;dlich</p>"),
            ("http://e.test/3", "<body>\n<p>Südlich</p>"),
            ("http://e.test/4", "<p>Südlich</p>".encode("cp1252")),
            ("http://e.test/5", "<p>Südlich</p>", "text/html; charset=windows-1252"),
            ("http://e.test/6", "<p>S�</p>", "text/plain"),
            ("http://e.test/7", ""),
            ("http://e.test/8", None),
        ]
    )
    assert sorted(r["fetch_id"] for r in encoding.damaged_fields(df).collect()) == [1, 2, 4, 5]
    heads = spark.createDataFrame([(1, {"X": "cafÃ©"}, 710), (2, {"X": "café", "Y": None}, 200), (3, None, 710), (4, {}, 200)], "fetch_id long, rep_header map<string,string>, status_code int")
    assert [(r["fetch_id"], r["field"], r["restored"]) for r in encoding.repair_headers(heads).collect()] == [(1, "rep_header", "café")]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    out, spans, lost, pairs = encoding.restore(text)
    assert isinstance(out, str) and spans >= 0
    assert encoding.damaged(text) == (encoding.LOST in text or bool([1 for a, b, p in encoding.label(text) if encoding.invert(text[a:b], p) is not None]))
