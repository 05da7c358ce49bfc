"""Exact restoration of texts that are garbled here, and right texts left alone."""

import pytest

from treeline.llm import garbled as G

RIGHT = ["As tubulações flexíveis – 644", "Os ímãs móveis (52 m²)", "Les réseaux à basse pression", "Die süßen Gefäße", "Los niños, la señal", "Naïve façade anchor 5", "NOTAÇÃO DE RAIZ", "SEÑAL “Ñ”", "Tree view with ├─ and └─ marks", "Square root √265", "Clavier à touches â, ê, î et ô", "pres​são da opera\xadção", "Lеѕ реtіtѕ", "5 µm 3 ± 1 °C 2 Ω", "7\xa0µm\xa0– 3\xa0Ω", "¿modelo 4?"]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("cp850", "cp1252"), ("latin-1", "mac-roman")]


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(i, RIGHT[i % len(RIGHT)]) for i in range(60 * len(RIGHT))]
    return G.context_counts(spark.createDataFrame(rows, "row_id long, t string"), ["t"])


def test_right_texts(counts):
    r = G.Restorer(counts)
    assert [t for t in RIGHT if r.text(t)[0]] == []
    assert r.text(None) == (False, None) and r.text("") == (False, "") and r.text("plain") == (False, "plain")


@pytest.mark.parametrize(("was", "read"), WRONG)
def test_restored(counts, was, read):
    r, n = G.Restorer(counts), 0
    for t in RIGHT[:5]:
        try:
            bad = G._read(t.encode(was), read)
        except UnicodeEncodeError:
            continue
        n += 1
        assert r.text(bad) == (True, t), (was, read, bad)
        half = f"{t}; {bad}"
        assert r.text(half)[0]
    assert n


def test_twice_lower_and_lost(counts):
    r = G.Restorer(counts)
    t = "As tubulações flexíveis"
    once = t.encode().decode("cp1252", "replace")
    twice = once.encode().decode("cp1252", "replace")
    assert r.text(twice) == (True, t)
    assert r.text("PÁS MÓVEIS".encode().decode("latin-1").lower()) == (True, "pás móveis")
    assert r.text("tubula��es") == (True, "tubula��es")


def test_table(spark):
    rows = [(i, RIGHT[i % 5], None, "clash") for i in range(100)] + [(100, "tubulaÃ§Ãµes", "tubulaÃ§Ãµes", "x"), (101, None, "", "x"), (100, "tubulaÃ§Ãµes", None, "x")]
    d = spark.createDataFrame(rows, "row_id long, title string, abstract string, field string")
    got = sorted((r.row_id, r.field, r.restored) for r in G.restore(d, "row_id", ["title", "abstract"]).collect())
    assert got == [(100, "abstract", "tubulações"), (100, "title", "tubulações"), (100, "title", "tubulações")]
    assert G.restore(d.limit(0), "row_id", ["title", "abstract"]).count() == 0


def test_c1_controls(counts):
    """A Windows-1252 text read as Latin-1 is damaged only where cp1252 has signs; what keeps a C1 control is reported at least."""
    r = G.Restorer(counts)
    for t in ["Die “süßen” Gefäße – 5", "a “valve”", "l’eau, l’huile", "5 – 7", "the ‘inner’ wall…", "• 20 €", "As tubulações flexíveis – “644”"]:
        bad = G._read(t.encode("cp1252"), "latin-1")
        assert bad != t and r.text(bad) == (True, t), bad
    for bad in ["x\x81y", "5 \x8d 7", "\x90"]:
        assert r.text(bad) == (True, bad)
    assert G.Restorer({}).text("q\x92eau \x93valve\x94") == (True, "q’eau “valve”")


@pytest.mark.parametrize("read", ["cp1250", "cp1253", "cp1257", "cp866", "iso8859-2", "iso8859-7", "koi8-r", "gbk", "big5", "euc-kr", "shift_jis", "mac-cyrillic"])
def test_utf8_read_with_any_table(read):
    """Counts are only needed for sequences of Cyrillic letters alone; the right part of the value stays as it is."""
    r = G.Restorer({("t", "ã", "o"): 100} if read == "koi8-r" else {})
    for t in ("Größe 5", "então", "piézo"):
        data = t.encode()
        bad = G._read(data, read) if read not in G.WIDE else data.decode(read, "replace")
        if G.LOST in bad or any(chr(128) <= c <= chr(159) for c in bad):
            continue
        assert bad != t and r.text(f"Ñandú, {bad}") == (True, f"Ñandú, {t}"), bad


def test_signs_on_their_own_are_meant(counts):
    """A lone letter or sign that another pair of tables would make a common one is only changed beside garbled words."""
    many = dict(counts)
    many[" ", "à", " "] = many[" ", "Ã", " "] = 10_000
    r = G.Restorer(many)
    for t in ["MARCA ‡ PARA RODAPÉ 3", "AS LETRAS Ã, Õ E Ç NO BLOCO", "A ‡ B"]:
        assert r.text(t) == (False, t)
    bad = "„ síntese".encode("cp1252", "replace").decode("cp1252")
    assert r.text(bad)[0] is False
    assert r.text("as tubulaÁıes à parte") == (True, "as tubulações à parte")


@pytest.mark.parametrize(("was", "read"), WRONG)
def test_right_parts_stay(counts, was, read):
    """Right words of a value, and signs that are meant, stay beside garbled ones, whatever the pair."""
    r = G.Restorer(counts)
    for t in RIGHT[:5]:
        try:
            bad = G._read(t.encode(was), read)
        except UnicodeEncodeError:
            continue
        for right in ("Le château, la señal", "Square root √265", "5 µm 3 ± 1 °C"):
            assert r.text(f"{right}; {bad}")[1].startswith(right + "; "), (was, read, right, bad)
