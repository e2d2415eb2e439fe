"""Personal values in free text: anchors, then local parsers.

An Aho-Corasick automaton finds every anchor in one pass over a text: at-signs in their spellings, schemes of
mail and telephone addresses, words that announce identity numbers, street endings, salutations and titles,
given names, digits, and the dots of initials. At each anchor a deterministic parser walks outwards as far as
the value goes, finds its borders and validates it (check digits, number of digits, form of a name). Nothing
is searched for over a whole text but the anchors. Where values overlap, the earlier kind of KINDS wins.

The given names are not a list in the code: `given_names` takes them from the corpus, from the places
where a call name stands in brackets between initials and surname or follows a salutation.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakmoes.plans.stage import stage

KINDS = ("email", "rekening", "idnummer", "telefoon", "adres", "naam")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
MIN_SUPPORT = 1
#: Given names go to every task; more of them is an error rather than a cut.
MAX_NAMES = 1_000_000

# Words that announce something.
AT = ("@", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " at ", " apenstaart ", "(apenstaart)", "[apenstaart]")
SCHEMES = ("mailto:", "tel:", "callto:", "sip:")
ID_CUES = ("paspoort", "rijbewijs", "identiteitsbewijs", "identiteitskaart", "id-kaart", "id kaart", "idkaart", "id-bewijs", "passport", "driving licence", "driver's license", "identity card", "id card", "verblijfsdocument", "documentnummer")
STREETS = ("straat", "laan", "weg", "dreef", "plein", "steeg", "singel", "kade", "hof", "pad", "plantsoen", "gracht", "park", "baan", "dijk", "markt", "wal", "burg", "hoek", "horst", "kamp", "erf", "veld", "oord", "ring", "boulevard", "allee", "esplanade", "passage", "street", "road", "lane", "avenue")
FIRST_WORDS = "Anna|Maria|Jan|Johan|Johannes|Willem|Wilhelmina|Pieter|Hendrik|Dokter|Doctor|Dr\\.|Burgemeester|Burg\\.|Meester|Mr\\.|Professor|Prof\\.|Sint|St\\.|Hoge|Lage|Oude|Oud|Nieuwe|Nieuw|Grote|Kleine|Lange|Korte|Eerste|Tweede|Koning|Koningin|Prins|Prinses|Pastoor|Kapitein|Generaal|Admiraal|Graaf|Hertog|Verlengde|Achter|Voor"
SALUTATIONS = ("heer", "heren", "mevrouw", "mevr", "mw", "mej", "mejuffrouw", "dhr", "hr", "mr", "mrs", "ms", "miss", "sir", "madam", "dr", "drs", "ir", "ing", "prof", "professor", "doctor")
#: Those that need no dot, and those that need none when written with a capital.
FULL = ("heer", "heren", "mevrouw", "mevr", "mw", "mejuffrouw", "dhr", "professor", "miss")
ENGLISH = ("mr", "mrs", "ms", "dr", "prof", "sir", "madam", "doctor")
COMPANY = ("B.V.", "N.V.", "V.O.F.", "C.V.", "U.A.", "P.O.", "I.C.", "Z.O.", "N.B.", "P.S.")
NO_SURNAME = "straat|laan|weg|dreef|plein|steeg|singel|kade|hof|pad|plantsoen|gracht"

_UP = "A-ZÀ-ÖØ-ÞŠŽŁĐŻŒŸ"
#: Inside a name: letters, apostrophes, and the signs that wrongly decoded letters turn into.
_IN = r"\w'’\xa1-\xbf\u2020-\u2044\u20ac\u2122\u2200-\u22ff\u2310\u2500-\u259f\ufffd"
_SP = r"[ \t\xa0]{1,3}"
_SUR = rf"[{_UP}](?![.])[{_IN}]+(?:-[{_UP}][{_IN}]+)*"
_PRE = rf"(?:(?:van|von|de|den|der|ter|ten|te|'t|’t|‘t|in|op|aan|uit|la|le|du|di)(?:{_SP}(?:de|den|der|het|'t|’t|‘t|la))?{_SP})"
_PRE_I = rf"(?i:{_PRE})"
_INI = rf"(?:[{_UP}][a-z]?\.[ \xa0]?)+"
_CALL = rf"(?:\([{_UP}][{_IN}]+\){_SP})"
_GIVEN = rf"[{_UP}][{_IN}-]+"

INITIALS = re.compile(rf"(?<![{_IN}.&/-])(?P<ini>{_INI})[ \t\xa0]{{0,3}}{_CALL}?{_PRE_I}?{_SUR}")
REVERSED = re.compile(rf"(?<![{_IN}-]){_SUR},{_SP}(?:[{_UP}]\.)+(?:{_SP}?\([{_UP}][{_IN}]+\))?(?:{_SP}(?i:(?:van|de|den|der|ter|ten|te|'t|’t)(?:{_SP}(?:de|den|der|het|'t|’t))?)(?![{_IN}]))?")
AFTER_TITLE = re.compile(rf"(?:{_INI}[ \t\xa0]{{0,3}}{_CALL}?{_PRE_I}?{_SUR})|(?:(?:{_GIVEN}{_SP})?{_PRE_I}?{_SUR})")
GIVEN_SURNAME = re.compile(rf"(?:-[{_UP}][{_IN}]+)?{_SP}{_PRE_I}?(?P<sur>{_SUR})")
TITLE_GAP = re.compile(rf"\.?{_SP}|\.")
CALL_NAME = re.compile(rf"(?<![{_IN}.])(?:[{_UP}]\.)+\s?\(([{_UP}][{_IN}-]+)\)")
SALUTED = re.compile(rf"(?i:\b(?:de heer|dhr\.?|mevrouw|mevr\.|mw\.(?: dr\.)?|mr|mrs|ms)){_SP}([{_UP}][{_IN}]+){_SP}(?:van|de|den|der|ter|ten)(?:{_SP}(?:de|den|der|'t))?{_SP}{_SUR}")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOT = r"(?:\.|[ \xa0]?[\[({<][ ]?(?:punt|dot|\.)[ ]?[\])}>][ \xa0]?|[ \xa0](?:punt|dot)[ \xa0])"
DOMAIN = re.compile(rf"[ \xa0]?(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?{DOT})+[a-z]{{2,24}}(?![a-z0-9])", re.I)
SPELLED = re.compile(r"[ \xa0](?:punt|dot)[ \xa0]|[\[({<][ ]?(?:punt|dot|\.)", re.I)

NUMBER = re.compile(r"(?<![\w+*])(?:\+|\(?0|\(?\+)[\d(]|(?<![\d.\-/+*A-Za-z])\d(?=(?:[ .]?\d){8}(?![\d*]))")
PHONE = re.compile(
    r"(?:(?:\(?\+|00)[ ]?31\)?[ .\-/]{0,3}(?:\(0\))?(?:[ .\-/]{0,3}\d){9}"
    r"|\(0\d\)(?:[ .\-/]{0,3}\d){8}|\(0\d\d\)(?:[ .\-/]{0,3}\d){7}|\(0\d{3}\)(?:[ .\-/]{0,3}\d){6}"
    r"|0\d(?:[ .\-/]{0,3}\d){8}"
    r"|\+(?!31)\d{1,3}(?:[ .\-/()]{0,2}\d){7,12})(?![\d*])(?![.\-/]\d)"
)
DATE = re.compile(r"\d\d?[-./ ]\d\d?[-./ ](?:19|20)\d\d|(?:19|20)\d\d[-/.]\d\d[-/.]\d\d")
#: Words right before a number that make it no telephone or no citizen number: as the end of a word, or anywhere in it.
NO_PHONE_END, NO_PHONE_IN = ("kenmerk", "kvk", "dossier", "zaak", "btw", "iban"), ("artikel", "tekening", "factuur")
NO_CITIZEN_END, NO_CITIZEN_IN = ("kenmerk", "kvk"), ("artikel", "tekening", "dossier", "zaak", "factuur", "project", "order", "rekening")
BANK = re.compile(r"NL\d\d ?[A-Z]{4}$")
ACCOUNT = re.compile(r"[A-Z]{2}\d{2}(?:[ \xa0]?[A-Z0-9]{4}){2,7}(?:[ \xa0]?[A-Z0-9]{1,3})?(?![A-Za-z0-9*])")
CITIZEN = re.compile(r"\d(?:[ .]?\d){8}(?![\d*])(?![.\-/]\d)")
CODE = re.compile(r"(?i:(?:nummer|number|bewijs|kaart)?[ ]?(?:nummer|number|nr\.?|no\.?)?[ ]?(?:is|met nummer|number|:)?[ ]{0,2})(?P<code>[A-Z0-9]{8,10})(?![\w*])")
HOUSE = re.compile(r"(?:,?[ \xa0]{0,3}(?:huisnummer|nummer|nr\.?|no\.?))?[ \xa0\n]{0,3}\d{1,5}(?![\d.,]?\d)(?:(?:[ ]?[-/][ ]?(?:\d{1,3}|[a-zA-Z])|[ ]?(?:bis|hs|rd)|[ ]?[a-zA-Z])(?![\w]))?(?![\w*])")
POSTCODE = re.compile(r"[1-9]\d{3}[ \xa0]?[A-Z]{2}(?![\w*])")
TOWN = re.compile(rf"[ \xa0]{{1,3}}(?:(?:[Dd]en|'s-|Sint)[ -]?)?[{_UP}][{_IN}-]+")
BEFORE_POSTCODE = re.compile(r"[ \t\xa0]*[,(\n]?[ \t\xa0\n]*(?:NL-)?")
POST_HOUSE = re.compile(r"\)?[ \xa0,]{0,3}(?:(?:huisnummer|nummer|huisnr\.?|nr\.?)[ \xa0:]{0,2}|(?<=[A-Z])[ \xa0,]{1,2}|-)(?P<nr>\d{1,5})(?:[ ]?(?:bis|hs|[a-zA-Z])(?!\w))?(?![\w*]|[.,:]\d)", re.I)
FIRST_LENGTH = 1 + max(len(x) for x in FIRST_WORDS.split("|"))
DAMAGED = frozenset(c for c in map(chr, range(0xA1, 0x2600)) if re.fullmatch(f"[{_IN}]", c) and not c.isalnum())
STREET_WORD = re.compile(rf"(?:(?:{FIRST_WORDS})[ -]|[{_UP}][\w'’]+-)?[{_UP}][{_IN}]*$")
STREET_UPPER = re.compile(rf"(?:(?:{FIRST_WORDS.upper()})[ -])?[{_UP}][{_UP}\x80-\U0010ffff'’]*$")
POST_PAIR = re.compile(r"\d{4}[ \xa0]?[A-Z]{2}$")
PO_BOXES = ("postbus", "po box", "p.o. box", "p.o box", "po. box", "antwoordnummer")
#: Pairs that follow a year or a time in running text and so are no postcode, if a bare number follows.
NO_POSTCODE = ("OM", "OP", "IN", "EN", "OF", "TE", "TM", "VA", "IS", "ER", "NA", "AF", "UR", "AM", "PM", "AT", "ON", "TO", "SA", "SD", "SS")


def eleven(digits: str) -> bool:
    """The check of citizen numbers: nine digits, not all zero, weights 9 to 2 and -1."""
    return len(digits) == 9 and digits != "000000000" and sum(int(d) * w for d, w in zip(digits, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0


@cache
def automaton(given: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, keys in (("g", [g.lower() for g in given]), ("s", SALUTATIONS), ("t", STREETS), ("i", ID_CUES), ("e", AT), ("u", SCHEMES), ("d", "0123456789"), (".", ".")):
        for k in keys:
            a.add_word(k, (kind, len(k)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _email(text: str, at: int, end: int) -> tuple[int, int] | None:
    stop = at - 1 if at and text[at - 1] in " \xa0" else at
    start = stop
    while start and text[start - 1] in LOCAL:
        start -= 1
    while start < stop and text[start] in "._%+-":
        start += 1
    d = DOMAIN.match(text, end) if start < stop else None
    if not d or text[at:end].strip() in ("at", "apenstaart") and not SPELLED.search(d[0]):
        return None
    return start, d.end()


def _word_before(text: str, at: int, blanks: str, most: int) -> str:
    """The word that ends before `at`, in lower case; up to `most` of the blanks between are set aside, -1 for all."""
    while at and most and text[at - 1] in blanks:
        at -= 1
        most -= 1
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return text[start:at].lower()


def _refused(word: str, ends: tuple[str, ...], inside: tuple[str, ...]) -> bool:
    return bool(word) and (word.endswith(ends) or any(x in word for x in inside))


def _phone(text: str, at: int) -> tuple[int, int] | None:
    m = PHONE.match(text, at)
    if not m or DATE.match(m[0]) or _refused(_word_before(text, at, " ", 1), NO_PHONE_END, NO_PHONE_IN):
        return None
    if BANK.search(text, max(0, at - 10), at - (at > 0 and text[at - 1] == " ")):
        return None
    return m.span()


def _citizen(text: str, at: int) -> tuple[int, int] | None:
    m = CITIZEN.match(text, at)
    if not m or not eleven(re.sub(r"\D", "", m[0])) or _refused(_word_before(text, at, " :#", -1), NO_CITIZEN_END, NO_CITIZEN_IN):
        return None
    return m.span()


def _account(text: str, at: int) -> tuple[int, int] | None:
    """An international account number whose check digits stand at `at`: its longest form that passes mod 97."""
    start = at - 2
    if start < 0 or not ("A" <= text[start] <= "Z" and "A" <= text[at - 1] <= "Z") or start and (text[start - 1].isalnum() or text[start - 1] == "*"):
        return None
    m = ACCOUNT.match(text, start)
    if not m:
        return None
    end = m.end()
    while end - start >= 15:
        plain = re.sub(r"[ \xa0]", "", text[start:end])
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return start, end
        # what follows after a blank may be another word
        cut = max(text.rfind(" ", start, end), text.rfind("\xa0", start, end))
        if cut < 0:
            return None
        end = cut
    return None


def _code(text: str, end: int) -> tuple[int, int] | None:
    while end < len(text) and (text[end].isalpha() or text[end] == "-"):  # the rest of the word that announces it
        end += 1
    m = re.compile(r"[ \xa0:]{0,3}").match(text, end)
    m = CODE.match(text, m.end())
    if not m or sum(c.isdigit() for c in m["code"]) < 2:
        return None
    return m.span("code")


def _address(text: str, end: int) -> tuple[int, int] | None:
    """An address whose street ends at `end`."""
    h = HOUSE.match(text, end)
    if not h:
        return None
    low = end
    while low and (text[low - 1].isalnum() or text[low - 1] in "-'’_" or text[low - 1] in DAMAGED):
        low -= 1
    low = max(0, low - FIRST_LENGTH)  # room for the longest first word of a street's name
    w = STREET_WORD.search(text, low, end) or STREET_UPPER.search(text, low, end)
    if not w or w.end() - w.start() < 4:
        return None
    upper = STREET_UPPER.search(text, low, end)
    start = min(w.start(), upper.start()) if upper else w.start()
    if start > 0 and (text[start - 1].isalnum() or text[start - 1] in "-'’"):
        return None
    stop = h.end()
    g = BEFORE_POSTCODE.match(text, stop)
    p = POSTCODE.match(text, g.end())
    if p:
        stop = p.end()
        if "(" in g[0] and stop < len(text) and text[stop] == ")":
            stop += 1
        t = TOWN.match(text, stop)
        if t and ")" not in text[p.end() : stop]:
            stop = t.end()
    return start, stop


def _box_before(text: str, at: int) -> bool:
    """Whether the number of a PO box ends right before `at`."""
    at = len(text[:at].rstrip()) if at and text[at - 1].isspace() else at
    if at and text[at - 1] == ",":
        at -= 1
    while at and text[at - 1].isspace():
        at -= 1
    end = at
    while at and text[at - 1].isdigit():
        at -= 1
    if at == end:
        return False
    while at and text[at - 1].isspace():
        at -= 1
    return text[max(0, at - 14) : at].lower().endswith(PO_BOXES)


def _postcode(text: str, m: re.Match) -> tuple[int, int] | None:
    h = POST_HOUSE.match(text, m.end())
    if not h or _box_before(text, m.start()):
        return None
    if "n" not in h[0].lower() and (m[0][-2:].upper() in NO_POSTCODE or "1900" <= m[0][:4] <= "2099"):
        return None
    if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-/.,*"):
        return None
    return m.start(), h.end()


PREFIXES = frozenset("van von de den der ter ten te 't het in op aan uit la le du di".split())


def _no_surname(text: str, span: tuple[int, int]) -> bool:
    """Only a prefix, or a first word of the next sentence, stands where the surname should."""
    last = re.split(r"[\s\xa0]", text[span[0] : span[1]])[-1]
    return last.lower() in PREFIXES or len(last) < 3


_STREET_END = re.compile(rf"(?i)(?:{NO_SURNAME})$")


def _trim_name(text: str, span: tuple[int, int]) -> tuple[int, int]:
    start, end = span
    while end > start and text[end - 1] in "'’-,":
        end -= 1
    return start, end


_BEFORE_INITIAL = re.compile(rf"[{_IN}.&/-]")
_IN_NAME = re.compile(rf"[{_IN}-]")
_CAPITAL = re.compile(f"[{_UP}]")


def _reversed(text: str, initial: int) -> re.Match | None:
    """A name written surname first, whose first initial stands at `initial`."""
    at = initial
    while at and text[at - 1] in " \t\xa0":
        at -= 1
    if at == initial or not at or text[at - 1] != ",":
        return None
    at -= 1
    while at and _IN_NAME.match(text[at - 1]):
        at -= 1
    return REVERSED.match(text, at)


def find(text: str | None, given: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each personal value of a text, by place. A null or empty text has none."""
    if not text:
        return []
    low = lowered(text)
    hits: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    n = len(text)
    called = listed = 0  # where the last telephone number and the last name with initials end
    for last, (kind, size) in automaton(given).iter(low):
        start, end = last - size + 1, last + 1
        if kind == "d":
            if (last and low[last - 1].isdigit()) or last < called:
                continue
            if last and "A" <= text[last - 1] <= "Z":
                if (x := _account(text, last)) is not None:
                    hits["rekening"].append(x)
                    called = x[1]
                    continue
            for at in (last - 2, last - 1, last):
                if at >= 0 and (at == last or text[at] in "+(") and NUMBER.match(text, at):
                    if (x := _phone(text, at)) is not None:
                        hits["telefoon"].append(x)
                        called = x[1]
                    elif (x := _citizen(text, last)) is not None:
                        hits["idnummer"].append(x)
                    break
            if text[last] != "0" and (m := POSTCODE.match(text, last)) and (x := _postcode(text, m)) is not None:
                hits["adres"].append(x)
        elif kind == ".":
            at = last - 1
            if at >= 0 and text[at].islower() and text[at].isascii():
                at -= 1
            if at < listed or at < 0 or not _CAPITAL.match(text[at]):
                continue
            if (m := _reversed(text, at)) is not None:
                hits["naam"].append(m.span())
            if at and _BEFORE_INITIAL.match(text[at - 1]):
                continue
            if m := INITIALS.match(text, at):
                listed = m.end()
                if not _company(text, m) and not _no_surname(text, m.span()):
                    hits["naam"].append(m.span())
        elif kind == "e":
            if (x := _email(text, start, end)) is not None:
                hits["email"].append(x)
        elif kind == "t":
            if end < n and text[end] in " \xa0\n,":
                if (x := _address(text, end)) is not None:
                    hits["adres"].append(x)
        elif kind == "i":
            if start == 0 or not low[start - 1].isalnum():
                if (x := _code(text, end)) is not None:
                    hits["idnummer"].append(x)
        elif kind == "u":
            if (x := _phone(text, end)) is not None and end >= called:
                hits["telefoon"].append(x)
                called = x[1]
        elif start == 0 or not (low[start - 1].isalnum() or low[start - 1] in "-.@_"):
            if end < n and kind == "s" and (text[end] == "." or text[end] in " \xa0\t" and (low[start:end] in FULL or text[start].isupper() and low[start:end] in ENGLISH)):
                if POST_PAIR.search(text, max(0, end - 8), end):
                    continue
                g = TITLE_GAP.match(text, end)
                m = AFTER_TITLE.match(text, g.end()) if g else None
                if m and not _is_title(m[0]) and not _no_surname(text, m.span()):
                    hits["naam"].append(m.span())
            elif end < n and kind == "g" and text[end] in " \xa0\t-" and text[start].isupper():
                m = GIVEN_SURNAME.match(text, end)
                if m and not _STREET_END.search(m["sur"]) and not _no_surname(text, m.span()):
                    hits["naam"].append((start, m.end()))
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []  # of the values taken so far, which don't overlap
    ends: list[int] = []
    for kind in KINDS:
        chosen: list[tuple[int, int]] = []
        for s, e in sorted((_trim_name(text, x) if kind == "naam" else x for x in hits[kind]), key=lambda x: (x[0], -x[1])):
            k = bisect_right(ends, s)
            if k < len(starts) and starts[k] < e or chosen and s < chosen[-1][1]:
                continue
            chosen.append((s, e))
        if chosen:
            both = sorted([*zip(starts, ends), *chosen])
            starts, ends = [a for a, _ in both], [b for _, b in both]
        out += [(kind, s, e) for s, e in chosen]
    return sorted(out, key=lambda x: x[1])


_TITLES = re.compile(rf"(?i)^(?:{'|'.join(SALUTATIONS)})\.?(?:\s|$)")
_MIDDLE = re.compile(r"(?i)^(?:college|raad|commissie|burgemeester|wethouder|voorzitter|griffier|minister|gemeente|fractie|de raad|the board)\b")


def _is_title(name: str) -> bool:
    return bool(_TITLES.match(name) or _MIDDLE.match(name))


def _company(text: str, m: re.Match) -> bool:
    """Initials that are the legal form of a firm named before them."""
    ini = m["ini"].strip()
    return ini.upper() in COMPANY and m.start() > 1 and text[m.start() - 1] in " \xa0" and text[m.start() - 2].isalnum()


def masked(text: str | None, values: list[tuple[str, int, int]]) -> str | None:
    """The text with a typed placeholder for each value."""
    if not values:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(values, key=lambda v: v[1]):
        parts += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join([*parts, text[at:]])


def _names_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                if ". (" in text or ".(" in text:
                    count.update(m[1] for m in CALL_NAME.finditer(text))
                count.update(m[1] for m in SALUTED.finditer(text))
    merged: Counter[str] = Counter()
    for k, v in count.items():
        merged[k.capitalize() if k.isupper() else k] += v
    yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], names=["naam", "n"])


def given_names(texts: DataFrame, support: int = MIN_SUPPORT) -> tuple[str, ...]:
    """The given names that the corpus shows at least `support` times in a place only a given name takes.

    A vocabulary, counted over all texts by partial counts in each task; as many names as people bear, and
    checked to be no more than MAX_NAMES before they go to the driver and the tasks.
    """
    n = texts.select("text").mapInArrow(_names_in, "naam string, n long").groupBy("naam").agg(F.sum("n").alias("n"))
    known = stage(n.where((F.col("n") >= support) & ~F.lower("naam").isin(*SALUTATIONS, *PREFIXES)).select("naam"), "p4-names")
    if (count := known.count()) > MAX_NAMES:
        raise ValueError(f"{count} given names, above {MAX_NAMES}: too many for a table that every task holds; raise the support")
    return tuple(sorted(r[0] for r in known.collect()))


def _finder(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = given.value
        for batch in batches:
            rows = []
            for tabel, i, k, text in zip(*(batch.column(c).to_pylist() for c in ("tabel", "id", "chunk_idx", "text"))):
                rows += [(tabel, i, k, soort, s, e) for soort, s, e in find(text, names)]
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["tabel", "id", "chunk_idx", "soort", "start_pos", "end_pos"])

    return run


def values(texts: DataFrame, given: tuple[str, ...] | None = None) -> DataFrame:
    """(tabel, id, chunk_idx, soort, start_pos, end_pos) of each personal value in texts (tabel, id, chunk_idx, text). Without given names, those that the texts show."""
    given = texts.sparkSession.sparkContext.broadcast(given_names(texts) if given is None else given)
    t = texts.where(F.col("text").isNotNull()).select("tabel", "id", "chunk_idx", "text")
    return t.mapInArrow(_finder(given), "tabel string, id long, chunk_idx int, soort string, start_pos int, end_pos int")


def _masker(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = given.value
        for batch in batches:
            found = [find(t, names) for t in batch.column("text").to_pylist()]
            clean = [masked(t, f) for t, f in zip(batch.column("text").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tabel"), batch.column("id"), batch.column("chunk_idx"), pa.array(clean, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["tabel", "id", "chunk_idx", "gemaskeerd", "n_waarden"]
            )

    return run


def mask(texts: DataFrame, given: tuple[str, ...] | None = None) -> DataFrame:
    """(tabel, id, chunk_idx, gemaskeerd, n_waarden): each text with a typed placeholder for each value and otherwise unchanged; a null text stays null."""
    given = texts.sparkSession.sparkContext.broadcast(given_names(texts) if given is None else given)
    return texts.select("tabel", "id", "chunk_idx", "text").mapInArrow(_masker(given), "tabel string, id long, chunk_idx int, gemaskeerd string, n_waarden int")
