import pytest

from lakmoes.llm import pii

GIVEN = ("Rixt", "Iñaki", "Hidde")

CASES = [
    ("Mail naar jan.jansen+x@voorbeeld.nl, graag", [("email", "jan.jansen+x@voorbeeld.nl")]),
    ("Mail naar a_b (at) voorbeeld.nl.", [("email", "a_b (at) voorbeeld.nl")]),
    ("Mail naar a-b[at]voorbeeld[punt]nl.", [("email", "a-b[at]voorbeeld[punt]nl")]),
    ("Mail naar a.b @ voorbeeld.test. De raad", [("email", "a.b @ voorbeeld.test")]),
    ("bij paal 20@7 km en @gemeente", []),
    ("we meet at noon. So", []),
    ("bel 06-12345678 nu", [("telefoon", "06-12345678")]),
    ("bel +31 (0)6 12345678.", [("telefoon", "+31 (0)6 12345678")]),
    ("bel (0185) 765182 of 0109 - 656 531", [("telefoon", "(0185) 765182"), ("telefoon", "0109 - 656 531")]),
    ("bel 0031 6 07016450 of 06 05 45 35 64", [("telefoon", "0031 6 07016450"), ("telefoon", "06 05 45 35 64")]),
    ("op 06-01-2019 14 keer, stand 306-9951, kenmerk 2020-192457002/A", []),
    ("BSN 111222333, bsn 111.222.333 en 1112 22 333", [("idnummer", "111222333"), ("idnummer", "111.222.333"), ("idnummer", "1112 22 333")]),
    ("BSN 111222334", []),
    ("paspoort XG6ACPA21; id-kaart nr. XC33XXKL9, rijbewijsnummer XF8307C29", [("idnummer", "XG6ACPA21"), ("idnummer", "XC33XXKL9"), ("idnummer", "XF8307C29")]),
    ("code XG6ACPA21 van de machine", []),
    ("woont Dorpsstraat 12, 2311 EG Leiden.", [("adres", "Dorpsstraat 12, 2311 EG Leiden")]),
    ("woont Hoge Esweg 114\n1234AB Plaats", [("adres", "Hoge Esweg 114\n1234AB Plaats")]),
    ("woont Anna Velderinklaan 20 bis", [("adres", "Anna Velderinklaan 20 bis")]),
    ("woont 6936TT, huisnummer 54.", [("adres", "6936TT, huisnummer 54")]),
    ("via Postbus 2375, 8497 MJ Plaats; de Kuipershof kreeg in 2011 een naam; een fietspad 14 keer", []),
    ("Geachte heer Voorbeeld, dank", [("naam", "Voorbeeld")]),
    ("door mw. dr. J.P. van 't Voorbeeld-Ander en Rixt ter Voorbeeld.", [("naam", "J.P. van 't Voorbeeld-Ander"), ("naam", "Rixt ter Voorbeeld")]),
    ("Volgens VOORBEELD, J.P. is", [("naam", "VOORBEELD, J.P.")]),
    ("Tekst: R.J. (Feddo) Voorbeeld", [("naam", "R.J. (Feddo) Voorbeeld")]),
    ("Voorbeeld Groen B.V. Wie het weet; Bouwbedrijf Hidde en Zonen", []),
    ("ja*****en en 06********78", []),
    ("", []),
    ("Zie " + "a" * 100 + "@voorbeeld.nl", [("email", "a" * 100 + "@voorbeeld.nl")]),
    ("mailto:jan@voorbeeld.nl of tel:0612345678", [("email", "jan@voorbeeld.nl"), ("telefoon", "0612345678")]),
    ("op NL02ABNA0123456789 of NL02 ABNA 0123 4567 89 graag, niet NL03ABNA0123456789", [("rekening", "NL02ABNA0123456789"), ("rekening", "NL02 ABNA 0123 4567 89")]),
    ("woont " + "Lange" + "x" * 90 + "straat 12", [("adres", "Lange" + "x" * 90 + "straat 12")]),
    ("Door A.B.C.D.E.F.G.H. Voorbeeld gezien", [("naam", "A.B.C.D.E.F.G.H. Voorbeeld")]),
    ("artikelnummer" + "x" * 40 + " 111222333 en dossiernummer:" + " " * 40 + "111222333", []),
    ("antwoordnummer" + " " * 60 + "12, 8497 MJ 12", []),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0][:30] for c in CASES])
def test_case(text, want):
    got = pii.find(text, GIVEN)
    assert [(k, text[s:e]) for k, s, e in got] == want


@pytest.mark.parametrize("text,want", CASES)
def test_shift_and_mask(text, want):
    pre = "İstanbul 𝔸 ligt ver. "
    a, b = pii.find(text, GIVEN), pii.find(pre + text, GIVEN)
    assert [(k, s + len(pre), e + len(pre)) for k, s, e in a] == b
    masked = pii.masked(text, a)
    assert masked.count("[") == text.count("[") - sum(v.count("[") for _, v in want) + len(want)
    for _, v in want:
        assert v not in masked or len(v) < 3


def test_tables(spark):
    rows = [("documents", 1, -1, "Tekst: R.J. (Feddo) Voorbeeld"), ("documents", 2, -1, "X.Y. (Feddo) Ander"), ("documents", 3, -1, "Aanwezig: Feddo Derde"), ("documents", 4, -1, None), ("documents", 5, -1, ""), ("bron_document", 6, 2, "bel 06-12345678 " + "x " * 200_000)]
    d = spark.createDataFrame(rows, "tabel string, id long, chunk_idx int, text string").selectExpr("*", "'q' as soort", "1 as start_pos")
    got = sorted((r["id"], r["chunk_idx"], r["soort"], r["start_pos"]) for r in pii.values(d).collect())
    assert got == [(1, -1, "naam", 7), (2, -1, "naam", 0), (3, -1, "naam", 10), (6, 2, "telefoon", 4)]
    m = {r["id"]: r["gemaskeerd"] for r in pii.mask(d).collect()}
    assert m[3] == "Aanwezig: [NAAM]" and m[4] is None and m[5] == "" and m[6].startswith("bel [TELEFOON] x")
    assert pii.values(d.limit(0)).count() == 0


def test_none():
    assert pii.find(None, ()) == [] and pii.masked(None, []) is None and pii.eleven("111222333") and not pii.eleven("000000000")


def test_many_values_in_one_text():
    text = "bel 06-12345678, mail a.b@voorbeeld.nl; " * 5000
    found = pii.find(text, GIVEN)
    assert len(found) == 10_000 and pii.masked(text, found) == "bel [TELEFOON], mail [EMAIL]; " * 5000
