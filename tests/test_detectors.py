import pytest
from pyspark.sql import functions as F

from lakmoes.operators import detectors as D

CASES = [
    ("bsn plain", "bsn", "In het stuk staat 111222333 genoemd.", ("BSN", "Kritiek", "")),
    ("bsn dotted", "bsn", "Nummer 111.22.2333 volgt", ("BSN", "Kritiek", "")),
    ("bsn invalid", "bsn", "In het stuk staat 111222334 genoemd.", None),
    ("bsn phone", "bsn", "tel 111222333", ("BSN", "Laag", "telefoon")),
    ("bsn plus", "bsn", "bel + 111222333", ("BSN", "Laag", "telefoon")),
    ("bsn vat", "bsn", "NL111222333B01 op de factuur", ("BSN", "Laag", "BTW")),
    ("bsn kvk", "bsn", "KvK nr 111222333", ("BSN", "Laag", "BTW")),
    ("bsn amount", "bsn", "kosten € 111222333", ("BSN", "Laag", "geldbedrag")),
    ("bsn case", "bsn", "zaaknummer: 111222333", ("BSN", "Laag", "referentiekenmerk")),
    ("bsn slash", "bsn", "nr 111222333/A", ("BSN", "Laag", "referentiekenmerk")),
    ("bsn article", "bsn", "Artikel 111222333", ("BSN", "Laag", "artikelnummer")),
    ("bsn drawing", "bsn", "Situatietekening: 111222333", ("BSN", "Laag", "tekeningnummer")),
    ("bsn coordinate", "bsn", "linker bovenhoek (111222333)", ("BSN", "Laag", "coördinaat")),
    ("bsn project", "bsn", "het projectnummer luidt (111222333)", ("BSN", "Laag", "project-")),
    ("bsn file", "bsn", "rapport.pdf (111222333)", ("BSN", "Laag", "bestandsnaam")),
    ("bsn code", "bsn", "Z20/ (111222333)", ("BSN", "Laag", "zaakkenmerk")),
    ("bsn building", "bsn", "windgebied (111222333)", ("BSN", "Laag", "constructieberekening")),
    ("bsn metadata", "bsn", "author: (111222333)", ("BSN", "Laag", "metadata")),
    ("bsn table", "bsn", "12,5; 33,1; 111222333; 44,2; 55,7", ("BSN", "Laag", "getallentabel")),
    ("bsn term wins", "bsn", "BSN tel 111222333", ("BSN", "Kritiek", "")),
    ("iban", "iban", "Rekening NL02ABNA0123456789 van mij", ("IBAN", "Hoog", "")),
    ("iban business", "iban", "kvk 12345678, NL02ABNA0123456789", ("IBAN (zakelijk)", "Laag", "bedrijfsrekening")),
    ("iban wrong", "iban", "Rekening NL03ABNA0123456789", None),
    ("email", "email", "schrijf naar jan@elders.nl.", ("E-mail", "Middel", "")),
    ("email own", "email", "schrijf naar jan@sub.eigen.nl", ("E-mail", "Laag", "")),
    ("date", "geboortedatum", "geboren 01-02-1980", ("Geboortedatum", "Hoog", "")),
    ("date plain", "geboortedatum", "op 01-02-1980", ("Geboortedatum", "Laag", "")),
    ("date wrong", "geboortedatum", "op 39-02-1980", None),
    ("date late", "geboortedatum", "op 01-02-2031", None),
    ("passport", "paspoort_rijbewijs", "paspoort XK1234567", ("Paspoort/rijbewijs-nr", "Kritiek", "")),
    ("passport report", "paspoort_rijbewijs", "Documentnummer: SOB012345.RAP003", ("Paspoort/rijbewijs-nr", "Laag", "rapportbijlage")),
    ("passport alone", "paspoort_rijbewijs", "code XK1234567", None),
    ("name", "persoonsnaam", "Geachte mevrouw Voorbeeld, dank", ("Persoonsnaam (aanhef)", "Middel", "")),
    ("name home", "persoonsnaam", "Dhr. B. Voorbeeld\nStraat 1\n2311 EG Leiden", ("Persoonsnaam (aanhef)", "Hoog", "woonadres")),
    ("name capital Heer", "persoonsnaam", "De Heer Jezus", None),
    ("name po box", "persoonsnaam", "Dhr. Voorbeeld, Postbus 12, 2300 PC Leiden", ("Persoonsnaam (aanhef)", "Middel", "")),
    ("empty", "bsn", "", None),
    ("null", "bsn", None, None),
]


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    keys = sorted({k for _, k, _, _ in CASES})
    for key in keys:
        on = {d.key: d.key == key for d in D.detectors()}
        df = docs(spark, [(n, t) for n, k, t, _ in CASES if k == key])
        for r in D.scan_documents(df, ["id"], ["eigen.nl"], on, chunks=None, meta=None).collect():
            out.setdefault(r["id"], []).append(r)
    return out


@pytest.mark.parametrize("name,key,text,want", CASES, ids=[c[0] for c in CASES])
def test_case(found, name, key, text, want):
    rows = found.get(name, [])
    if want is None:
        assert rows == []
        return
    assert [(r["soort"], r["ernst"]) for r in rows] == [want[:2]]
    assert want[2] in rows[0]["opmerking"]


def test_no_raw_value_leaves(spark):
    df = docs(spark, [("a", "BSN 111222333, mail jan.janssen@elders.nl, paspoort XK1234567, 06-12345678")])
    for r in D.scan_documents(df, ["id"], chunks=None, meta=None).collect():
        assert "waarde" not in r.asDict()
        for v in (r["waarde_masked"], r["context"]):
            assert "111222333" not in v and "jan.janssen" not in v


def test_prefix_shifts_places(spark):
    t = "Het nummer 111222333 en jan@elders.nl"
    at = {r["id"]: r["start"] for r in D.scan_documents(docs(spark, [("a", t), ("b", "é𝔸 voor " + t)]), ["id"], (), {"email": False, "telefoon": False}, chunks=None, meta=None).collect() if r["soort"] == "BSN"}
    assert at["b"] - at["a"] == 8


def test_regrade_by_first_chunk(spark):
    chunk = lambda i, t: {"idx": i, "loc": f"pagina {i}", "text": t}
    df = spark.createDataFrame(
        [
            ("a", None, [chunk(2, "Straat 3, 1111 AA en Weg 2, 2222 BB"), chunk(0, "Straat 3, 1111 AA")], {"x": "Laan 4, 1111 AA"}),
            ("b", None, [chunk(0, "niets"), chunk(1, "Straat 3, 1111 AA")], None),
            ("c", "Straat 3, 1111 AA", [], None),
            ("d", None, None, None),
        ],
        "id string, text string, chunks array<struct<idx:int,loc:string,text:string>>, meta map<string,string>",
    )
    on = {d.key: d.key == "naw" for d in D.detectors()}
    rows = {(r["id"], r["chunk_idx"], r["waarde_masked"]): r for r in D.scan_documents(df, ["id"], (), on).collect()}
    assert rows["a", 0, "1*****A"]["ernst"] == "Laag" and rows["a", 2, "1*****A"]["ernst"] == "Laag"
    assert rows["a", 2, "2*****B"]["ernst"] == "Middel" and "niet op pagina 1" in rows["a", 2, "2*****B"]["opmerking"]
    assert rows["a", 2147483647, "1*****A"]["locatie"] == "metadata"
    assert rows["b", 1, "1*****A"]["ernst"] == "Middel" and rows["c", 0, "1*****A"]["ernst"] == "Laag"
    assert not any(k[0] == "d" for k in rows)


def test_noise_of_masked_context(spark):
    df = docs(spark, [("a", "projectnummer 11*****33"), ("b", "gewoon 11*****33")])
    assert [r[0] != "" for r in df.select(D.bsn_context_noise(F.col("text"))).collect()] == [True, False]


def test_hidden_sheet_and_disabled(spark):
    df = spark.createDataFrame([("a", {"_verborgen_tabbladen": "Geheim"}), ("b", {}), ("c", None)], "id string, meta map<string,string>")
    assert [r["id"] for r in D.hidden_sheets(df, ["id"]).collect()] == ["a"]
    off = {d.key: False for d in D.detectors()}
    assert D.scan_documents(docs(spark, [("a", "111222333")]), ["id"], (), off, chunks=None, meta=None).count() == 0


def test_a_detector_can_be_added(spark):
    yes = lambda b, v, a: F.lit(True)
    D.add_detector(lambda own: D.Detector("kenteken", r"\b[A-Z]{2}-\d{2}-\d{2}\b", yes, D._const("Kenteken"), D._const("Laag"), D._const("")))
    try:
        d = spark.createDataFrame([(1, "auto XX-12-34 en mail a@b.nl")], "id long, text string")
        got = D.scan_documents(d, ["id"], chunks=None, meta=None).collect()
        assert sorted((r["soort"], r["start"]) for r in got) == [("E-mail", 22), ("Kenteken", 5)]
    finally:
        D._MORE.clear()
