import pytest
from pyspark.sql import functions as F

from lakmoes.functions import scalars as S
from lakmoes.functions.matching import find_all, replace_all
from lakmoes.functions.urls import normal_digest, normal_key, normal_status, normal_url


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,ok", [("111222333", True), ("111222334", False), ("000000000", False), ("11122233", False), ("", False), (None, False), ("11122233a", False)])
def test_bsn(spark, value, ok):
    assert one(spark, value, S.valid_bsn) is ok


@pytest.mark.parametrize("value,ok", [("NL02ABNA0123456789", True), ("nl02 abna 0123 4567 89", True), ("NL03ABNA0123456789", False), ("DE02ABNA0123456789", False), (None, False), ("NL02\tABNA0123456789", False)])
def test_iban(spark, value, ok):
    assert one(spark, value, S.valid_iban_nl) is ok


@pytest.mark.parametrize("value,masked", [("", ""), ("a", "a"), ("abcd", "a***"), ("abcde", "a***e"), ("abcdefgh", "a******h"), ("abcdefghi", "ab*****hi"), ("  abcde ", "a***e"), (None, None)])
def test_mask(spark, value, masked):
    assert one(spark, value, S.mask) == masked


def test_find_all_gives_code_point_places(spark):
    hits = one(spark, "𝔸é 12 x 345", lambda c: find_all(c, r"\d+"))
    assert [(h["start"], h["end"], h["value"]) for h in hits] == [(3, 5, "12"), (8, 11, "345")]
    assert one(spark, "geen", lambda c: find_all(c, r"\d+")) == []
    assert one(spark, None, lambda c: find_all(c, r"\d+")) is None


def test_replace_all(spark):
    assert one(spark, "a1b22c", lambda c: replace_all(c, r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">")))) == "a<1>b<22>c"


def test_redact_masks_neighbours(spark):
    out = one(spark, "mail jan.janssen@x.nl, NL02ABNA0123456789 en 111 222 333 maar niet 12 34", S.redact)
    assert "janssen" not in out and "0123456789" not in out and "222" not in out and "12 34" in out


@pytest.mark.parametrize("value,ok", [("2311 EG", True), ("2311 SA", False), ("2015 en", False), ("2311 en", False), ("2015 kw", False), ("2311 kw", True), ("2015 EG", True)])
def test_postcode(spark, value, ok):
    assert one(spark, value, S.postcode_ok) is ok


@pytest.mark.parametrize("title,kind", [("Verleende OMGEVINGSVERGUNNING kappen", "Omgevingsvergunning"), ("kappen van een boom", "Kapvergunning"), ("Verkeersbesluit", "Verkeersbesluit"), ("iets", ""), (None, "")])
def test_permit(spark, title, kind):
    assert one(spark, title, S.permit_type) == kind


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("http://A.example:80/x/?b=2&a=1#top", "https://a.example/x?a=1&b=2&utm_source=n", True),
        ("https://a.example/d%6Fcs/%c3%a9", "https://a.example/docs/%C3%A9", True),
        ("https://a.example/X", "https://a.example/x", False),
        ("https://a.example/x?a=1", "https://a.example/x?a=2", False),
        ("https://a.example:8080/x", "https://a.example/x", False),
        ("https://a.example/x?", "https://a.example/x", True),
        ("https://a.example/100%", "https://a.example/100%", True),
    ],
)
def test_url(spark, a, b, same):
    assert (one(spark, a, normal_url) == one(spark, b, normal_url)) is same


def test_normal_forms(spark):
    d = "ab" * 32
    assert one(spark, f" SHA256:{d.upper()} ", normal_digest) == d
    assert one(spark, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", normal_digest) is None
    assert one(spark, "", normal_digest) is None and one(spark, None, normal_digest) is None and one(spark, "abc", normal_digest) is None
    assert one(spark, " Done\n", normal_status) == "done" and one(spark, None, normal_status) == "todo"
    assert one(spark, " WIR- 1", normal_key) == "wir-1" and one(spark, None, normal_url) is None


def test_metadata(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1", "c": ""},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(S.flat_metadata(F.col("m"))).collect()] == ["a: 1\nb: 2", None, None]
