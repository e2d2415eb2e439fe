"""Text that was decoded with the wrong character encoding.

A word here is a run of ASCII letters and of those characters beyond ASCII that some code page shows for a
byte, with at least one of the latter; other scripts break a word, as no wrong decoding ends in them, so their
unbroken sentences don't swell the vocabulary. All distinct words of the corpus are counted; each is garbled along every chain of encodings, and so is each of
its runs beyond ASCII. The garbled forms are hash-joined with the words that occur: a word is garbled if it
equals a garbled form of a word that is more frequent, and so is one with a run beyond ASCII that equals the
garbled form of a more frequent run. What is left, words whose original the corpus never shows, is decoded
back and held against the chain (it has to come out garbled the same way). Replacement characters and C1
controls tell that something was lost; such words are found, not restored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakmoes.llm import scan
from lakmoes.plans.stage import small, spread, stage

# Encodings that texts are commonly written in and wrongly read in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-15")
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850")
LOST = "�"


def _read(raw: bytes, encoding: str) -> str | None:
    """raw as that encoding shows it; bytes it leaves open become C1 controls, as browsers do."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        if encoding not in ("cp1252", "cp1250"):
            return None
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)


def _written(text: str, encoding: str) -> bytes | None:
    """The bytes that encoding shows as text."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250"):
            return None
        out = bytearray()
        for c in text:
            b = c.encode(encoding, "ignore") or (bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else b"")
            if not b:
                return None
            out += b
        return bytes(out)


def _dropped(text: str) -> str:
    return re.sub("[\x80-\x9f]", "", text)


def garbled_forms(text: str) -> set[tuple[str, bool]]:
    """All garbled forms of a text, each with whether its chain starts from UTF-8."""
    out: set[tuple[str, bool]] = set()
    raw = text.encode("utf-8", "replace")
    for e in READ_AS:
        one = _read(raw, e)
        if one is None:
            continue
        out |= {(one, True), (_dropped(one), True)}
        for e2 in (e, "cp1252") if e in ("cp1252", "latin-1") else (e,):
            two = _read(one.encode("utf-8", "replace"), e2)
            if two is not None:
                out |= {(two, True), (_dropped(two), True)}
    for a in SINGLE_BYTE:
        b = _written(text, a)
        if b is not None:
            out |= {(x, False) for e in SINGLE_BYTE if e != a and (x := _read(b, e)) is not None}
    return {(x, u) for x, u in out if x != text and x}


#: What the code pages show for the bytes beyond ASCII, with the C1 controls and the replacement character.
SHOWN = frozenset(c for e in READ_AS for c in bytes(range(128, 256)).decode(e, "ignore")) | frozenset(map(chr, range(0x80, 0xA0))) | {LOST}


@cache
def _shown() -> np.ndarray:
    on = np.zeros(sys.maxunicode + 1, bool)
    on[[ord(c) for c in SHOWN]] = True
    return on


def _plausible(text: str) -> bool:
    """Whether a decoded run may be an original: Latin letters and common signs, or at least two letters of one other script."""
    if len(text) > 1 and all(c.isalpha() for c in text) and len({unicodedata.name(c, "").split(" ")[0] for c in text}) == 1:
        return True
    return all(c.isascii() or "\xa0" <= c < "ɐ" or "‐" <= c <= "›" or c in "€™" for c in text)


def decoded_back(run: str) -> str | None:
    """The original of a run beyond ASCII that some chain from UTF-8 garbled; None if there is none."""
    for e in READ_AS:
        raw = _written(run, e)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(text) < len(run):
            again = decoded_back(text) or text
            if _plausible(again):
                return again
    return None


_RUN = re.compile("[^\x00-\x7f]+")
#: What single-byte encodings show for each other's no-break space; as often as this between letters it is one.
_SPACES = sorted({x for a in SINGLE_BYTE for e in SINGLE_BYTE if e != a and (b := _written("\xa0", a)) and (x := _read(b, e)) and not x.isascii() and x != "\xa0"})
_SPACE_TIMES = 3
#: The rest of a no-break space read wrongly, after its second half became a plain space.
_HALF_SPACE = re.compile("^([A-Za-z]*)(?:\u00c2|\u00c3\u201a|\u00c3\u0082)$")


def _spaced(word: str) -> str | None:
    """The word with its no-break spaces back, if one sign stands for them; without the half of one that stands before a plain space."""
    if m := _HALF_SPACE.match(word):
        return m[1]
    for c in _SPACES:
        if len(re.findall(f"(?<=[A-Za-z]){c}(?=[A-Za-z])", word)) >= _SPACE_TIMES:
            return word.replace(c, "\xa0")
    return None


def words_beyond_ascii(texts: list[str]) -> Iterator[tuple[int, int, str]]:
    """(text number, start, word) of each word with characters beyond ASCII; a no-break space is one of those."""
    cp, at = scan.code_points(texts)
    high = (cp >= 128) & _shown()[cp]
    if not high.any():
        return
    letter = ((cp | 32) >= 97) & ((cp | 32) <= 122)
    on = high | letter
    edge = np.flatnonzero(np.diff(np.r_[0, on.view(np.int8), 0]))
    start, end = edge[0::2], edge[1::2]
    total = np.r_[0, np.cumsum(high & on)]
    some = total[end] > total[start]
    start, end = start[some], end[some]
    owner = np.searchsorted(at, start, side="right") - 1
    for s, e, o in zip((start - at[owner]).tolist(), (end - at[owner]).tolist(), owner.tolist()):
        yield o, s, texts[o][s:e]


def _words(tabel: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, texts in scan.blocks(batch.column(1).to_pylist()):
                hits = list(words_beyond_ascii(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tabel] * len(hits)), pa.array([ids[lo + o] for o, _, _ in hits], pa.int64()), pa.array([s for _, s, _ in hits], pa.int32()), pa.array([w for _, _, w in hits], pa.string())],
                    names=["tabel", "id", "start", "woord"],
                )

    return run


def words_of(df: DataFrame, tabel: str, id_col: str, text_col: str) -> DataFrame:
    """(tabel, id, start, woord) of the words with characters beyond ASCII; null texts have none."""
    d = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return spread(d, "id").mapInArrow(_words(tabel), "tabel string, id long, start int, woord string")


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[str, str, bool, int]] = []
        for w, n in zip(batch.column("woord").to_pylist(), batch.column("n").to_pylist()):
            if LOST not in w:
                rows += [(f, w, u, n) for f, u in garbled_forms(w)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["vorm", "origineel", "utf8", "n"])


def _guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words no table knows: the original of each run that decodes back, and whether something was lost."""
    for batch in batches:
        rows: list[tuple[str, str | None]] = []
        for w in batch.column("woord").to_pylist():
            fixed = _RUN.sub(lambda m: (decoded_back(m[0]) or m[0]) if len(m[0]) > 1 else m[0], w)
            if LOST in w or re.search("[\x80-\x9f]", fixed):
                rows.append((w, None))
            elif fixed != w or (fixed := _spaced(w)) is not None:
                rows.append((w, fixed))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["woord", "origineel"])


def verdicts(words: DataFrame) -> DataFrame:
    """(woord, origineel): the garbled ones of the words (tabel, id, start, woord), with what they were; null where it can't be told.

    Joins are by word, over distinct words with their counts, which a partial aggregate makes first.
    """
    vocab = stage(words.groupBy("woord").agg(F.count("*").alias("n")), "p3-vocab")
    run = F.regexp_extract_all("woord", F.lit("[^\\x00-\\x7F]+"), F.lit(0))
    best = F.max_by("origineel", F.struct("n0", "origineel")).alias("origineel")

    def table(counts: DataFrame, only_utf8: bool) -> DataFrame:
        forms = counts.mapInArrow(_forms, "vorm string, origineel string, utf8 boolean, n long").withColumnRenamed("n", "n0")
        if only_utf8:
            forms = forms.where(F.col("utf8") & (F.length("vorm") > 1))
        hit = forms.join(counts.withColumnRenamed("woord", "vorm"), "vorm").where("n0 > n")
        return hit.groupBy(F.col("vorm").alias("woord")).agg(best)

    by_word = table(vocab, False)
    runs = stage(vocab.select(F.explode(run).alias("woord"), "n").groupBy("woord").agg(F.sum("n").alias("n")), "p3-runs")
    by_run = table(runs, True).select(F.col("woord").alias("r"), F.col("origineel").alias("ro"))
    rest = vocab.join(by_word, "woord", "left_anti")
    parts = rest.select("woord", F.explode(F.array_distinct(run)).alias("r")).join(by_run, "r").groupBy("woord").agg(F.collect_list(F.struct("r", "ro")).alias("delen"))
    # the longest runs first, so that none is replaced inside another
    parts = parts.select("woord", F.aggregate(F.array_sort("delen", lambda a, b: F.length(b.r) - F.length(a.r)), F.col("woord"), lambda acc, d: F.replace(acc, d.r, d.ro)).alias("origineel"))
    parts = parts.withColumn("origineel", F.when(~F.col("origineel").rlike("[\\x{80}-\\x{9F}\\x{FFFD}]"), F.col("origineel")))
    guessed = rest.join(parts, "woord", "left_anti").mapInArrow(_guess, "woord string, origineel string")
    return by_word.unionByName(parts).unionByName(guessed)


def garbled_words(words: DataFrame) -> DataFrame:
    """(tabel, id, start, woord, origineel): each garbled word."""
    words = stage(words, "p3-words")
    bad = stage(verdicts(words), "p3-verdicts")
    return words.join(small(bad), "woord").select("tabel", "id", "start", "woord", "origineel")


def found(words: DataFrame) -> DataFrame:
    """(tabel, id): the rows with at least one garbled passage."""
    return garbled_words(words).select("tabel", "id").distinct()


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, fixes in zip(batch.column("text").to_pylist(), batch.column("fixes").to_pylist()):
            for f in sorted(fixes, key=lambda f: -f["start"]):
                if f["origineel"] is not None:
                    text = text[: f["start"]] + f["origineel"] + text[f["start"] + len(f["woord"]) :]
            out.append(text)
        n = [sum(f["origineel"] is not None for f in x) for x in batch.column("fixes").to_pylist()]
        lost = [len(x) - k for x, k in zip(batch.column("fixes").to_pylist(), n)]
        yield pa.RecordBatch.from_arrays([batch.column("tabel"), batch.column("id"), pa.array(out, pa.string()), pa.array(n, pa.int32()), pa.array(lost, pa.int32())], names=["tabel", "id", "hersteld", "n_hersteld", "n_verloren"])


def restore(texts: DataFrame, garbled: DataFrame) -> DataFrame:
    """(tabel, id, hersteld, n_hersteld, n_verloren) of the affected rows: texts (tabel, id, text) with each garbled word replaced where its original is known."""
    fixes = garbled.groupBy("tabel", "id").agg(F.collect_list(F.struct("start", "woord", "origineel")).alias("fixes"))
    return texts.select("tabel", "id", "text").join(fixes, ["tabel", "id"]).select("tabel", "id", "text", "fixes").mapInArrow(_restored, "tabel string, id long, hersteld string, n_hersteld int, n_verloren int")
