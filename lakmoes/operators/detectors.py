"""Detectors of personal data: pattern, validation, grading by context; and the second look at a whole document.

One pass over a chunk makes the array of hits of all detectors, each with the text just before and after it;
from there on the text itself is gone from the plan and grading works on those windows. There is no shuffle:
what the first chunk of a document says is taken while its chunks still stand in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakmoes.functions import scalars as S
from lakmoes.functions.matching import around, find_all, record
from lakmoes.plans.stage import spread

RANK = {"Kritiek": 0, "Hoog": 1, "Middel": 2, "Laag": 3}

# Patterns and terms of the detectors.
BSN = r"(?U)(?<![\d.])\d[\d .]{7,11}\d(?![\d.])"
MOBILE = r"(?U)(?<!\d)(?:\+31|0031|0)\s?6[\s-]?\d{4}[\s-]?\d{4}(?!\d)"
LANDLINE = r"(?U)(?<!\d)0\d{1,3}[\s-]?\d{6,7}(?!\d)"
DATE = r"(?U)\b[0-3]?\d[-/. ][01]?\d[-/. ](?:19|20)\d{2}\b"
POSTCODE = r"(?U)\b[1-9]\d{3}\s?[A-Za-z]{2}\b"
HOUSE = r"(?U)\b\d{1,4}[a-zA-Z]?\b"
PASSPORT = r"(?U)\b[A-Z]{2}[A-Z0-9]{6}\d\b"
PO_BOX = r"(?iUd)\bpostbus\b[\s\S]{0,15}$"
BIRTH_TERMS = r"(?i)geboren|geboortedatum|geb\.?\s|geb\.?dat"
ID_TERMS = r"(?i)paspoort|rijbewijs|identiteits|documentnummer|id[- ]?kaart"
SALUTED = (
    r"(?U)\b(?:[Dd]e\s+heer(?:/mevrouw)?|[Mm]evrouw|[Dd]hr\.|[Mm]evr\.|[Mm]w\.|[Gg]eachte\s+(?:heer|mevrouw))\s+"
    r"((?:[A-Z]\.\s*)*(?:(?:van|de|den|der|ten|ter|te|'t|op|in)\s+)*[A-ZÀ-Ž][A-Za-zà-ž'-]+)"
)
BUSINESS = r"(?iU)\b(?:kvk|k\.?v\.?k\.?|handelsregister|kamer van koophandel|btw|rsin|omzetbelasting)\b"
REPORT_SUFFIX = r"(?U)^\s?\.\s?[A-Za-z]{2,8}\d*\b"
BSN_TERMS = r"(?iU)\b(?:bsn|burgerservicenummer|sofinummer|sofi-nummer)\b"


def _last(n: int) -> Callable[[Column], Column]:
    return lambda c: F.right(c, F.lit(n))


def number_table(window: Column) -> Column:
    """Whether a window is mostly digits, as in a table of amounts."""
    digits, letters = F.regexp_count(window, F.lit(r"(?U)\d")), F.regexp_count(window, F.lit(r"(?U)\p{L}"))
    marks = window.contains(",") | window.contains("%") | (F.regexp_count(window, F.lit(r"\.")) >= 2)
    return ((digits >= 12) & (letters <= digits * 0.25) & marks) | ((digits >= 18) & (letters <= digits * 0.15))


# Signs in the text around a number that tell where it comes from, in order.
FRAGMENT_SIGNS = (
    (r"(?iu)co[oö]rdina|rd-stelsel|rijksdriehoek|bovenhoek|onderhoek|\b[XY]\s*[:=]", "coördinaat op een tekening"),
    (r"(?i)projectnummer|documentnummer|referentiecode|referentienummer|\bwerknr\b", "project-, document- of referentienummer"),
    (r"(?i)\.(?:pdf|dwg|docx?|xlsx?|dwf)\b", "deel van een bestandsnaam"),
    (r"\b[A-Za-z]{1,4}\d{1,4}\s*/", "deel van een zaakkenmerk"),
    (r"(?i)domein\s+globaal|\[mm\]|daktype|windgebied|belasting\s*staaf", "uitkomst van een constructieberekening"),
    (r"(?i)\b(?:title|author|creator|producer|subject)\s*:", "uit de metadata van het bestand"),
)
PHONE_NEAR = r"(?iU)\+\s?31|00\s?31|\b(?:tel|fax|telefoon(?:nummer)?|mobiel|gsm)\b"
COMPANY_NEAR = r"(?iU)\bbtw|\b(?:rsin|kvk|omzetbelasting|vat)\b|\bob[- ]?nummer\b"
CASE_BEFORE = r"(?id)(?:[A-Za-z]{1,8}[-/](?:\d{2,4}[-/])?|[A-Za-z]|(?:zaak|dossier|registratie|besluit|document|kenmerk|corsa|olo)\s*(?:nummer|nr\.?|kenmerk)?\s*[:\-]?\s*)$"
DRAWING_BEFORE = r"(?iUd)\b(?:situatie|bouw|overzicht|detail|constructie)?tekening(?:nummer)?\s*:?\s*$"

PLUS_BEFORE = r"(?Ud)\+\s*$"
VAT_BEFORE = r"(?iUd)\bnl\s?$"
VAT_AFTER = r"(?iU)^\s?b\d{2}\b"
MONEY_BEFORE = r"(?id)(?:€|eur|euro)\s*$"
MONEY_AFTER = r"^\s?,-|^[.,]\d{2}(?!\d)"
MONEY_FORM = r"\d{1,3}(?:\.\d{3}){2,}"
REFERENCE_AFTER = "^[A-Za-z/]"
ARTICLE_BEFORE = r"(?iUd)\bartikel\s*$"


def bsn_context_noise(fragment: Column) -> Column:
    """Why a number in this fragment, masked or not, is no citizen number; empty if nothing tells."""
    out = None
    for pattern, reason in FRAGMENT_SIGNS:
        out = F.when(fragment.rlike(pattern), F.lit(reason)) if out is None else out.when(fragment.rlike(pattern), F.lit(reason))
    return out.otherwise(F.lit(""))


def bsn_noise(before: Column, value: Column, after: Column) -> Column:
    """Why a number that passes the check is no citizen number; empty if it may be one. A term for it just before always wins."""
    near, next_ = F.right(before, F.lit(40)), F.left(after, F.lit(8))
    tight = F.concat(F.right(before, F.lit(25)), value, F.left(after, F.lit(6)))
    fragment = F.concat(F.right(before, F.lit(45)), value, F.left(after, F.lit(15)))
    table = F.concat(F.right(before, F.lit(35)), value, F.left(after, F.lit(35)))
    noise = bsn_context_noise(fragment)
    return (
        F.when(F.right(before, F.lit(60)).rlike(BSN_TERMS), F.lit(""))
        .when(near.rlike(PLUS_BEFORE) | F.right(before, F.lit(25)).rlike(PHONE_NEAR), F.lit("deel van een telefoonnummer"))
        .when((near.rlike(VAT_BEFORE) & next_.rlike(VAT_AFTER)) | tight.rlike(COMPANY_NEAR), F.lit("BTW-, RSIN- of KvK-nummer"))
        .when(near.rlike(MONEY_BEFORE) | next_.rlike(MONEY_AFTER) | value.rlike(MONEY_FORM), F.lit("deel van een geldbedrag"))
        .when(next_.rlike(REFERENCE_AFTER) | near.rlike(CASE_BEFORE), F.lit("referentiekenmerk van een zaak of besluit"))
        .when(near.rlike(ARTICLE_BEFORE), F.lit("artikelnummer van een regeling"))
        .when(near.rlike(DRAWING_BEFORE), F.lit("tekeningnummer bij een besluit"))
        .when(noise != "", noise)
        .when(number_table(table), F.lit("cijfer uit een getallentabel"))
        .otherwise(F.lit(""))
    )


def home_postcodes(window: Column) -> Column:
    """The valid postcodes of a text that belong to no PO box."""
    hits = around(window, find_all(window, POSTCODE), 40, 0)
    return F.filter(hits, lambda h: S.postcode_ok(h["value"]) & ~h["before"].rlike(PO_BOX))


def valid_postcodes(text: Column) -> Column:
    """The postcodes of a text in normal form, without double ones."""
    return F.array_distinct(F.transform(F.filter(find_all(text, POSTCODE), lambda h: S.postcode_ok(h["value"])), lambda h: S.normal_postcode(h["value"])))


@dataclass(frozen=True)
class Detector:
    """A pattern, what a hit has to satisfy, and kind, severity and remark of a hit, all of (before, value, after)."""

    key: str
    pattern: str
    keep: Callable[[Column, Column, Column], Column]
    kind: Callable[[Column, Column, Column], Column]
    severity: Callable[[Column, Column, Column], Column]
    remark: Callable[[Column, Column, Column], Column]
    value: Callable[[Column], Column] = lambda v: v
    #: What a text without any hit mostly lacks, told without a pattern; the pattern is tried only where it holds.
    near: Callable[[Column], Column] | None = None


#: Makers of further detectors, called with the own domains; see `add_detector`.
_MORE: list[Callable[[Sequence[str]], Detector]] = []


def add_detector(maker: Callable[[Sequence[str]], Detector]) -> None:
    """Add a detector to those of every later scan; maker gets the own domains."""
    _MORE.append(maker)


def _const(x: str) -> Callable[[Column, Column, Column], Column]:
    return lambda b, v, a: F.lit(x)


def _either(test: Callable[[Column, Column, Column], Column], yes: str, no: str) -> Callable[[Column, Column, Column], Column]:
    return lambda b, v, a: F.when(test(b, v, a), F.lit(yes)).otherwise(F.lit(no))


def _date_parts(v: Column) -> Column:
    parts = F.split(v, "[-/. ]")
    return F.coalesce(S.valid_date(*[F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]), F.lit(False))


def detectors(own_domains: Sequence[str] = ()) -> list[Detector]:
    """All detectors, in the order in which their findings come."""
    digits = lambda v: F.regexp_replace(v, "[ .]", "")
    quiet = lambda b, v, a: bsn_noise(b, v, a) == ""
    business = lambda b, v, a: F.concat(F.right(b, F.lit(60)), v, F.left(a, F.lit(60))).rlike(BUSINESS)
    own = lambda b, v, a: S.own_domain(v, list(own_domains))
    born = lambda b, v, a: F.right(b, F.lit(30)).rlike(BIRTH_TERMS)
    house = lambda b, v, a: S.postcode_ok(v) & (F.right(b, F.lit(40)).rlike(HOUSE) | F.left(a, F.lit(25)).rlike(HOUSE))
    box = lambda b, v, a: F.right(b, F.lit(40)).rlike(PO_BOX)
    report = lambda b, v, a: F.left(a, F.lit(12)).rlike(REPORT_SUFFIX)
    lives = lambda b, v, a: F.size(home_postcodes(F.concat(b, v, a))) > 0
    any_ = lambda b, v, a: F.lit(True)
    return [
        Detector("bsn", BSN, lambda b, v, a: S.valid_bsn(digits(v)), _const("BSN"), _either(quiet, "Kritiek", "Laag"),
                 lambda b, v, a: F.when(quiet(b, v, a), F.lit("negen cijfers die de elfproef doorstaan")).otherwise(F.concat(F.lit("doorstaat de elfproef, maar: "), bsn_noise(b, v, a))), digits),
        Detector("iban", "(?U)" + S.IBAN, lambda b, v, a: S.valid_iban_nl(v), _either(business, "IBAN (zakelijk)", "IBAN"), _either(business, "Laag", "Hoog"), _either(business, "bedrijfsrekening", "rekening die mod 97 doorstaat"), near=lambda t: t.contains("NL")),
        Detector("email", "(?U)" + S.EMAIL, any_, _const("E-mail"), _either(own, "Laag", "Middel"), _either(own, "werkadres op een eigen domein", ""), near=lambda t: t.contains("@")),
        Detector("telefoon", MOBILE, any_, _const("Telefoon (mobiel)"), _const("Middel"), _const("")),
        Detector("telefoon", LANDLINE, any_, _const("Telefoon (vast)"), _const("Laag"), _const("kan een algemeen nummer zijn")),
        Detector("geboortedatum", DATE, lambda b, v, a: _date_parts(v), _const("Geboortedatum"), _either(born, "Hoog", "Laag"), _either(born, "als geboortedatum genoemd", "datum zonder context")),
        Detector("naw", POSTCODE, house, _const("NAW (postcode+huisnr)"), _either(box, "Laag", "Middel"), _either(box, "postbus, geen woonadres", "postcode met huisnummer")),
        Detector("paspoort_rijbewijs", PASSPORT, lambda b, v, a: F.right(b, F.lit(40)).rlike(ID_TERMS), _const("Paspoort/rijbewijs-nr"), _either(report, "Laag", "Kritiek"), _either(report, "nummer van een rapportbijlage", "nummer bij een term voor een identiteitsbewijs"), near=lambda t: t.rlike(ID_TERMS)),
        Detector("persoonsnaam", SALUTED, any_, _const("Persoonsnaam (aanhef)"), _either(lives, "Hoog", "Middel"), _either(lives, "naam met woonadres", "naam na aanhef"),
                 lambda v: F.trim(F.regexp_replace(F.regexp_extract(v, SALUTED, 1), r"(?U)\s+", " "))),
        *[make(own_domains) for make in _MORE],
    ]


def scan(chunks: DataFrame, keep: Sequence[str], enabled: dict[str, bool] | None = None, own_domains: Sequence[str] = (), text: str = "text") -> DataFrame:
    """One row for each finding of the chunks: the columns `keep`, and detector (its place in the order), start, soort, ernst, waarde, context, opmerking.

    A detector that `enabled` doesn't name runs. Empty and null texts have no findings. waarde is the raw
    value; `masked` has to come before any sink.
    """
    used = [d for d in detectors(own_domains) if (enabled or {}).get(d.key, True)]
    c = chunks.where(F.length(text) > 0)
    hit = "array<struct<k:int,start:int,end:int,value:string,before:string,after:string>>"
    if not used:
        return c.select(*keep, F.lit(0).alias("detector"), F.lit(0).alias("start"), *[F.lit("").alias(x) for x in ("soort", "ernst", "waarde", "context", "opmerking")]).limit(0)
    def found(k: int, d: Detector) -> Column:
        hits = around(F.col(text), find_all(F.col(text), d.pattern))
        rows = F.transform(hits, lambda h: record(k=F.lit(k), start=h["start"], end=h["end"], value=h["value"], before=h["before"], after=h["after"])).cast(hit)
        return rows if d.near is None else F.when(d.near(F.col(text)), rows).otherwise(F.array().cast(hit))

    arrays = [found(k, d) for k, d in enumerate(used)]
    # outer: for an inner explode the planner would add a filter that computes all hits a second time
    rows = c.select(*keep, F.explode_outer(F.concat(*arrays)).alias("h")).where(F.col("h.k").isNotNull()).select(*keep, "h.*")

    def choose(f: Callable[[Detector], Column]) -> Column:
        out = None
        for k, d in enumerate(used):
            out = F.when(F.col("k") == k, f(d)) if out is None else out.when(F.col("k") == k, f(d))
        return out

    args = F.col("before"), F.col("value"), F.col("after")
    rows = rows.where(choose(lambda d: d.keep(*args)))
    inner = choose(lambda d: F.regexp_extract("value", SALUTED, 1) if d.key == "persoonsnaam" else F.col("value"))
    return rows.select(
        *keep,
        F.col("k").alias("detector"),
        "start",
        choose(lambda d: d.kind(*args)).alias("soort"),
        choose(lambda d: d.severity(*args)).alias("ernst"),
        choose(lambda d: d.value(F.col("value"))).alias("waarde"),
        F.replace(S.snippet(*args), inner, S.mask(inner)).alias("context"),
        choose(lambda d: d.remark(*args)).alias("opmerking"),
    )


def chunked(docs: DataFrame, keys: Sequence[str], text: str = "text", chunks: str | None = "chunks", meta: str | None = "meta", title: str | None = None) -> DataFrame:
    """Documents as rows of chunks: (keys, chunk_idx, loc, text, onderwerp), onderwerp being the postcodes of the first chunk.

    Chunks come before text; a document with neither gives no row but that of its metadata, which is scanned
    as the last chunk and never counts as the first.
    """
    whole = F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("idx"), F.lit("document").alias("loc"), F.col(text).alias("text"))))
    kind = "array<struct<idx:int,loc:string,text:string>>"
    body = whole.cast(kind)
    if chunks:
        filled = F.filter(F.col(chunks), lambda c: F.length(c["text"]) > 0)
        body = F.when(F.size(filled) > 0, F.array_sort(F.transform(filled, lambda c: record(idx=c["idx"].cast("int"), loc=c["loc"], text=c["text"])))).otherwise(body)
    body = F.coalesce(body, F.array().cast(kind))
    tail = F.array().cast(kind)
    if meta:
        flat = S.flat_metadata(F.col(meta))
        tail = F.when(flat.isNotNull(), F.array(F.struct(F.lit(2147483647).alias("idx"), F.lit("metadata").alias("loc"), flat.alias("text")))).otherwise(tail).cast(kind)
    subject = F.when(F.size("_body") > 0, valid_postcodes(F.element_at("_body", 1)["text"])).otherwise(F.array().cast("array<string>"))
    d = spread(docs, keys[0]).select(*keys, body.alias("_body"), tail.alias("_tail"))
    return d.select(*keys, subject.alias("onderwerp"), F.explode(F.concat("_body", "_tail")).alias("c")).select(*keys, F.col("c.idx").alias("chunk_idx"), F.coalesce("c.loc", F.lit("")).alias("locatie"), F.col("c.text").alias("text"), "onderwerp")


def regraded(findings: DataFrame) -> DataFrame:
    """Address findings held against the postcodes of the document's first chunk (column onderwerp): those in it are expected, the others are marked."""
    naw = F.col("soort").startswith("NAW") & (F.size("onderwerp") > 0)
    expected = F.array_contains("onderwerp", S.normal_postcode(F.col("waarde")))
    return findings.withColumns(
        {
            "ernst": F.when(naw & expected, F.lit("Laag")).otherwise(F.col("ernst")),
            "opmerking": F.when(naw & expected, F.lit("adres van het onderwerp, verwacht")).when(naw, F.lit("adres niet op pagina 1")).otherwise(F.col("opmerking")),
        }
    )


def masked(findings: DataFrame) -> DataFrame:
    """The findings with waarde_masked in place of the raw value."""
    return findings.withColumn("waarde_masked", S.mask(F.col("waarde"))).drop("waarde", "onderwerp")


def scan_documents(docs: DataFrame, keys: Sequence[str], own_domains: Sequence[str] = (), enabled: dict[str, bool] | None = None, **cols) -> DataFrame:
    """Documents to masked, graded findings."""
    c = chunked(docs, keys, **cols)
    return masked(regraded(scan(c, [*keys, "chunk_idx", "locatie", "onderwerp"], enabled, own_domains)))


def hidden_sheets(docs: DataFrame, keys: Sequence[str], meta: str = "meta", key: str = "_verborgen_tabbladen") -> DataFrame:
    """A finding for each document whose metadata names hidden sheets."""
    v = F.col(meta)[key]
    return docs.where(F.length(v) > 0).select(*keys, F.lit(2147483647).alias("chunk_idx"), F.lit("metadata").alias("locatie"), F.lit("Verborgen tabblad").alias("soort"), F.lit("Middel").alias("ernst"), S.mask(v).alias("waarde_masked"), F.lit("").alias("context"), F.lit("verborgen blad in een werkmap").alias("opmerking"))
