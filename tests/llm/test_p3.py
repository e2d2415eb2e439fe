import pytest

from lakmoes.llm import encoding as E


def run(spark, texts):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, woord string")
    words = E.words_of(d, "documents", "id", "text")
    got = {r["id"] for r in E.found(words).collect()}
    fixed = {r["id"]: r for r in E.restore(d.selectExpr("'documents' as tabel", "id", "text"), E.garbled_words(words)).collect()}
    return got, fixed


CLEAN = ["het geïnteresseerde café – vóór één euro € 5,– in São Paulo", "MAÇÃ IMPORT en ‘Â-Côté’ bij Ðorđe & Søn, Iñaki ‘mooi’ vóór één"]


@pytest.mark.parametrize("a,b", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252")])
def test_chains(spark, a, b):
    good = "geïnteresseerde lezer vóór één café – mooi"
    bad = E._read(E._written(good, a) if a != "utf-8" else good.encode(), b)
    got, fixed = run(spark, [*CLEAN * 3, f"eerst\n{bad}\nlaatst", "geen tekens", None, ""])
    assert got == {6} and fixed[6]["hersteld"] == f"eerst\n{good}\nlaatst" and fixed[6]["n_verloren"] == 0


def test_double_and_lost(spark):
    twice = "één".encode().decode("cp1252").encode().decode("cp1252")
    got, fixed = run(spark, [*CLEAN * 3, twice, "v��r de prijs", "onbekend wÃ¶rd"])
    assert got == {6, 7, 8} and fixed[6]["hersteld"] == "één" and fixed[7]["n_verloren"] == 1 and fixed[7]["hersteld"] == "v��r de prijs" and fixed[8]["hersteld"] == "onbekend wörd"


def test_half_of_a_space(spark):
    got, fixed = run(spark, [*CLEAN, "Wij gebruikenÂ cookies vanÂ Plaats", "Druk†deze†pagina†af"])
    assert got == {2, 3} and fixed[2]["hersteld"] == "Wij gebruiken cookies van Plaats" and fixed[3]["hersteld"] == "Druk\xa0deze\xa0pagina\xa0af"


def test_clean_foreign_text_is_no_case(spark):
    assert run(spark, CLEAN * 2 + ["naïef"])[0] == set()
    assert run(spark, [])[0] == set()
    assert run(spark, [None])[0] == set()


def test_words_against_a_pattern():
    import re

    texts = ["a\xa0b é-x één'ß 12€3", "", "geen", "ü" * 5, "x" * 10_000 + "é"]
    want = [(i, m.start(), m[0]) for i, t in enumerate(texts) for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+", t) if re.search(r"[^\x00-\x7f]", m[0])]
    assert list(E.words_beyond_ascii(texts)) == want


def test_other_scripts():
    # sentences of other scripts are no words of the vocabulary; garbled ones decode back
    assert [w for _, _, w in E.words_beyond_ascii(["это длинное предложение, 中文句子没有空格 und Köln"])] == ["Köln"]
    assert E.decoded_back("Москва".encode().decode("latin-1")) == "Москва"
    assert E.decoded_back("Ω") is None and E.decoded_back("ÃŸ") == "ß"
