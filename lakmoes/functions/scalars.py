"""Checks, masks and normal forms of single values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakmoes.functions.matching import replace_all

# Patterns of what is masked in a context, and words and pairs that make no postcode.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IBAN = r"\bNL\d{2}\s?[A-Z]{4}\s?(?:\d{4}\s?){2}\d{2}\b"
DIGITS = r"\d[\d .]{4,}\d"
NO_LETTERS = ("SA", "SD", "SS")
SHORT_WORDS = ("en", "in", "op", "te", "of", "is", "er", "om", "na", "af", "uit", "ex", "tm", "tv", "nr", "as", "za", "zo", "ma", "di", "wo", "do", "vr")
# Kinds of permit by what a title contains, the first that fits.
PERMITS = (
    ("omgevingsvergunning", "Omgevingsvergunning"), ("kapvergunning", "Kapvergunning"), ("kappen", "Kapvergunning"),
    ("evenement", "Evenementenvergunning"), ("exploitatie", "Exploitatievergunning"), ("standplaats", "Standplaatsvergunning"),
    ("ligplaats", "Ligplaatsvergunning"), ("gehandicaptenparkeer", "Gehandicaptenparkeerplaats"), ("drank", "Drank/horeca"),
    ("horeca", "Drank/horeca"), ("uitweg", "Uitweg/inrit"), ("inrit", "Uitweg/inrit"), ("sloop", "Sloopmelding"),
    ("verkeersbesluit", "Verkeersbesluit"), ("verkeer", "Verkeer"), ("bestemmingsplan", "Bestemmingsplan"),
    ("subsidie", "Subsidie"), ("melding", "Melding"), ("vergunning", "Vergunning (overig)"),
)


def valid_bsn(digits: Column) -> Column:
    """Nine digits, not all zero, whose sum weighted 9 to 2 and -1 is divisible by 11. Null gives false."""
    weight = F.array(*[F.lit(w) for w in (9, 8, 7, 6, 5, 4, 3, 2, -1)])
    parts = F.zip_with(F.split(digits, ""), weight, lambda d, w: F.try_to_number(d, F.lit("9")).cast("int") * w)
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce(F.when(digits.rlike("^[0-9]{9}$") & (digits != "000000000"), total % 11 == 0), F.lit(False))


def valid_iban_nl(iban: Column) -> Column:
    """A Dutch account number that passes mod 97; only plain spaces are set aside. Null gives false."""
    v = F.upper(F.replace(iban, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(v, 5, 14), F.substring(v, 1, 4))
    digits = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    number = digits.try_cast("decimal(38,0)")
    return F.coalesce(F.when(v.rlike("^NL[0-9]{2}[A-Z]{4}[0-9]{10}$"), number % 97 == 1), F.lit(False))


def mask(value: Column) -> Column:
    """The value without outer blanks, with stars for all but its ends: one character of up to four, one at either end of up to eight, two beyond."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    n = F.length(v)
    ends = F.when(n <= 4, F.lit(0)).when(n <= 8, F.lit(1)).otherwise(F.lit(2))
    head = F.when(n <= 4, F.lit(1)).otherwise(ends)
    return F.when(n == 0, v).otherwise(F.concat(F.left(v, head), F.repeat(F.lit("*"), n - head - ends), F.right(v, ends)))


def redact(fragment: Column) -> Column:
    """Every e-mail address, account number and long run of digits of a fragment masked, in this order."""
    f = replace_all(fragment, "(?U)" + EMAIL, mask)
    f = replace_all(f, "(?U)" + IBAN, mask)
    return replace_all(f, "(?U)" + DIGITS, lambda m: F.when(F.length(F.regexp_replace(m, r"(?U)\D", "")) >= 6, mask(m)).otherwise(m))


def snippet(before: Column, value: Column, after: Column, width: int = 45) -> Column:
    """A short fragment around a value with all identifiers masked; the value as it stands in the collapsed text is masked too."""
    collapse = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    whole = F.concat(F.right(before, F.lit(width)), value, F.left(after, F.lit(width)))
    frag = redact(F.trim(collapse(whole)))
    frag = F.replace(frag, value, mask(value))
    return F.replace(frag, collapse(value), mask(collapse(value)))


def postcode_ok(value: Column) -> Column:
    """Whether four digits and two letters can be a postcode and not a year with a short word."""
    digits, letters = F.left(value, F.lit(4)).try_cast("int"), F.right(value, F.lit(2))
    lower = ~F.lower(letters).isin(*SHORT_WORDS) & ~digits.between(1900, 2099)
    return ~F.upper(letters).isin(*NO_LETTERS) & (letters.rlike("^[A-Z]{2}$") | lower)


def normal_postcode(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"(?U)\s+", ""))


def own_domain(address: Column, domains: list[str]) -> Column:
    """Whether an e-mail address is on one of the domains or below it."""
    own = F.lower(F.substring_index(address, "@", -1))
    out = F.lit(False)
    for d in domains:
        d = d.strip().lstrip("@").lower()
        if d:
            out = out | (own == d) | own.endswith("." + d)
    return out


def permit_type(title: Column) -> Column:
    """The kind of permit that a title names; empty if none."""
    low = F.lower(F.coalesce(title, F.lit("")))
    out = None
    for word, label in PERMITS:
        out = F.when(F.contains(low, F.lit(word)), F.lit(label)) if out is None else out.when(F.contains(low, F.lit(word)), F.lit(label))
    return out.otherwise(F.lit(""))


def valid_date(day: Column, month: Column, year: Column, last: int = 2025) -> Column:
    """Day up to 31, month up to 12, year from 1900 to `last`; no calendar."""
    return day.between(1, 31) & month.between(1, 12) & year.between(1900, last)


def flat_metadata(meta: Column) -> Column:
    """The entries of a map as lines "key: value", by key; null and empty maps give null."""
    pairs = F.array_sort(F.map_entries(F.map_filter(meta, lambda k, v: v.isNotNull() & (v != ""))))
    return F.nullif(F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_unescaped(c: Column) -> Column:
    """The reverse of html_escaped; numbers of characters too are left to a parser."""
    for a, b in (("&#x27;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
