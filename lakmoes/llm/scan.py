"""Vectorised word scanner shared by the text operators.

Texts are looked at as one array of code points; words (runs of letters and digits), line and
sentence ends are found with numpy over the whole block, and every word gets a 64-bit hash of
its folded form. Nothing here loops over characters or words in Python.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

BLOCK_CHARS = 1_500_000
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@cache
def _tables(accents: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit, is it a mark to leave out, and the hash of its folded form."""
    n = sys.maxunicode + 1
    alnum = np.zeros(n, bool)
    mark = np.zeros(n, bool)
    fold = np.arange(n, dtype=_U)
    for i in range(n):
        c = chr(i)
        if c.isalnum():
            alnum[i] = True
            low = c.lower()
            if accents and i > 127:
                low = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x)) or low
            fold[i] = ord(low[0]) if len(low) == 1 else sum(ord(x) << (21 * k) for k, x in enumerate(low[:3]))
        elif accents and i > 127 and unicodedata.combining(c):
            mark[i] = True
    return alnum, mark, mix64(fold + _U(0x9E3779B97F4A7C15))


@cache
def _powers(n: int) -> np.ndarray:
    p = np.empty(n, _U)
    p[0] = 1
    for i in range(1, n):
        p[i] = (int(p[i - 1]) * 0x100000001B3 + 0) & 0xFFFFFFFFFFFFFFFF
    return p


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, a zero after each; where each text starts, and the end."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return cp, at


def words(texts: list[str], accents: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word of the texts in order; start and end count within the block.

    With accents=True accents are set aside, and combining marks do not break a word.
    """
    alnum, mark, hashes = _tables(accents)
    cp, at = code_points(texts)
    back = None
    if accents:
        m = mark[cp]
        if m.any():
            back = np.flatnonzero(~m)
            cp = cp[back]
    on = alnum[cp]
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    if len(on) and on[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), z, z, z
    size = end - start
    chars = np.flatnonzero(on)
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(len(chars)) - np.repeat(first, size)
    width = 64
    while width < int(size.max()):
        width *= 2
    h = np.add.reduceat(hashes[cp[chars]] * _powers(width)[place], first)
    h = mix64(h + size.astype(_U))
    if back is not None:
        start, end = back[start], back[end - 1] + 1
    return h, np.searchsorted(at, start, side="right") - 1, start, end


def windows(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of n consecutive words of one text."""
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    k = len(h) - n + 1
    out = np.zeros(k, _U)
    for i in range(n):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[i : i + k])
    same = owner[:k] == owner[n - 1 :]
    return out[same], owner[:k][same]


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Slices of the texts of about `most` characters: (number of the first text, texts). A null text is an empty one."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if held and held + n > most:
            yield lo, [x or "" for x in texts[lo:i]]
            lo, held = i, 0
        held += n + 1
    if lo < len(texts):
        yield lo, [x or "" for x in texts[lo:]]
