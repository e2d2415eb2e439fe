"""Test passages inside a corpus: a distributed positional inverted index.

`build_index` stores the postings of the corpus as segments, one for each block of documents: the distinct
terms of the block in order, and for each term its (document, position) list. `search` takes for every
window of `n` words of an item the term that is rarest in the corpus, reads that term's list in each
segment, and intersects it with the lists of the other terms of the window at their offsets; as a segment
holds all its postings, an intersection at a known (document, position) is one look into the inverted
list. Runs that grow to `n` words are exact phrase matches; `proximity` adds documents that hold enough of the
rare terms of a window, or those of the whole item, close to each other.

Words are runs of letters and digits with letter case and accents set aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakmoes.llm import scan
from lakmoes.plans.stage import spread, stage_path

WORDS = 12
#: Items are searched in groups of so many, or of so many characters; each group goes to the tasks as one array of bounded size.
ITEM_BLOCK, ITEM_CHARS = 4096, 8_000_000
#: Postings and anchors of one term are held against each other in pieces of so many pairs.
PIECE = 1 << 20

_SEGMENT = "docs binary, starts binary, terms binary, counts binary, places binary"


def _segments(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(id_col).to_pylist(), dtype=np.int64)
            for lo, texts in scan.blocks(batch.column(text_col).to_pylist()):
                h, owner, _, _ = scan.words(texts, accents=True)
                starts = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                order = np.argsort(h, kind="stable")
                terms, counts = np.unique(h[order], return_counts=True)
                row = [ids[lo : lo + len(texts)], starts, terms, counts.astype(np.int32), order.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["docs", "starts", "terms", "counts", "places"])

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of the positional index of docs, written to the shared folder. Null texts have no words; rows without id are left out.

    A posting is the place of a word in its segment; `starts` turns places into (document, position).
    """
    spark = docs.sparkSession
    path = stage_path(spark, "p7-index")
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    spread(d, id_col).mapInArrow(_segments(id_col, text_col), _SEGMENT).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_SEGMENT).parquet(path)


def _frequencies(wanted):
    """Partial corpus frequencies of the wanted terms, one array for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)
                if len(t):
                    at = np.minimum(np.searchsorted(t, terms), len(t) - 1)
                    total += np.where(t[at] == terms, c[at], 0)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on], pa.int64())], names=["term", "n"])

    return run


def _anchors(seq: np.ndarray, starts: np.ndarray, rarity: np.ndarray, n: int) -> np.ndarray:
    """The places of the items' words that are the rarest of some window of n words."""
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= n:
            w = np.lib.stride_tricks.sliding_window_view(rarity[a:b], n)
            out.append(np.unique(a + np.arange(len(w)) + w.argmin(axis=1)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _matches(query, n: int):
    seq, owner, anchors, names = query.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_wanted, which = np.unique(seq[anchors], return_inverse=True)
        by = np.argsort(which, kind="stable")
        first = np.searchsorted(which[by], np.arange(len(terms_wanted) + 1))
        for batch in batches:
            for row in batch.to_pylist():
                docs, starts = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["starts"], np.int32)
                terms, counts, places = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["places"], np.int32)
                if not len(terms):
                    continue
                at = np.minimum(np.searchsorted(terms, terms_wanted), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == terms_wanted)
                if not len(hit):
                    continue
                offset = np.cumsum(counts) - counts
                text = np.empty(len(places), np.int64)
                text[places] = np.repeat(np.arange(len(terms)), counts)
                # the items' words as numbers of this segment's terms; -1 where the segment has no such term
                to = np.minimum(np.searchsorted(terms, seq), len(terms) - 1)
                item = np.where(terms[to] == seq, to, -1)
                doc_of = np.repeat(np.arange(len(docs)), np.diff(starts))
                # every posting of an anchor term against every anchor with that term, piece by piece: common words shared by many items make many pairs
                n_post, n_anchor = counts[at[hit]].astype(np.int64), first[hit + 1] - first[hit]
                edge = np.cumsum(n_post * n_anchor)
                found: list[pd.DataFrame] = []
                for lo in range(0, int(edge[-1]), PIECE):
                    pair = np.arange(lo, min(lo + PIECE, int(edge[-1])))
                    who = np.searchsorted(edge, pair, side="right")
                    k = pair - (edge[who] - (n_post * n_anchor)[who])
                    p = places[offset[at[hit]][who] + k // n_anchor[who]].astype(np.int64)
                    q = anchors[by[first[hit][who] + k % n_anchor[who]]]
                    left, right = np.zeros(len(p), np.int64), np.ones(len(p), np.int64)
                    for size, sign in ((right, 1), (left, -1)):
                        alive = np.arange(len(p))
                        for step in range(1, n):
                            x, y = p[alive] + sign * step, q[alive] + sign * step
                            ok = (x >= 0) & (x < len(text)) & (y >= 0) & (y < len(seq))
                            alive, x, y = alive[ok], x[ok], y[ok]
                            ok = (text[x] == item[y]) & (doc_of[x] == doc_of[p[alive]]) & (owner[y] == owner[q[alive]])
                            alive = alive[ok]
                            if not len(alive):
                                break
                            size[alive] += 1
                    long = left + right >= n
                    p, q, left = p[long], q[long], left[long]
                    found.append(pd.DataFrame({"doc_id": docs[doc_of[p]], "item_id": names[owner[q]], "doc_pos": (p - left) - starts[doc_of[p]], "words": (left + right[long])}))
                yield pa.RecordBatch.from_pandas(pd.concat(found).drop_duplicates(), schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_pos", pa.int64()), ("words", pa.int64())]), preserve_index=False)

    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of at most ITEM_BLOCK items: (words, item number, starts, ids)."""
    held: list[tuple[int, str]] = []
    chars = 0
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).distinct()
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        chars += len(r[1])
        if len(held) == ITEM_BLOCK or chars >= ITEM_CHARS:
            yield _as_arrays(held)
            held, chars = [], 0
    if held:
        yield _as_arrays(held)


def _as_arrays(held: list[tuple[int, str]]):
    held.sort(key=lambda x: x[0])
    h, owner, _, _ = scan.words([t for _, t in held], accents=True)
    return h, owner, np.searchsorted(owner, np.arange(len(held) + 1)), np.asarray([i for i, _ in held], np.int64)


def search(index: DataFrame, items: DataFrame, n: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_pos, words): where a document holds at least n consecutive words of an item.

    doc_pos is the number of the run's first word in the document as far as n - 1 words before its rarest
    term, words the length seen; a long run gives a row for each anchor in it. Items with fewer than n
    words match nothing. The items are read in groups of ITEM_BLOCK, each sent to the tasks whole; the
    corpus is read once for each group.
    """
    spark = index.sparkSession
    out = None
    for seq, owner, starts, names in _item_blocks(items, id_col, text_col):
        terms = np.unique(seq)
        wanted = spark.sparkContext.broadcast(terms)
        parts = index.select("terms", "counts").mapInArrow(_frequencies(wanted), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(terms), np.int64)
        df[parts["term"].to_numpy(dtype=np.int64)] = parts["n"].to_numpy(dtype=np.int64)
        anchors = _anchors(seq, starts, df[np.searchsorted(terms, seq)], n)
        query = spark.sparkContext.broadcast((seq, owner, anchors, names))
        part = index.mapInArrow(_matches(query, n), "doc_id long, item_id long, doc_pos long, words long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, doc_pos long, words long")


def leaks(docs: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, item_id, plaatsen, woorden): each document with each item it leaks; how many places were seen, and the longest run."""
    hits = search(build_index(docs), items, n)
    return hits.groupBy("doc_id", "item_id").agg(F.countDistinct("doc_pos").alias("plaatsen"), F.max("words").alias("woorden"))


def proximity(index: DataFrame, items: DataFrame, rare: int = 6, within: int = 40, share: float = 2 / 3, n: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, termen): documents with a passage of an item, whole or in part, word for word or reworded; termen is how many terms were found together.

    A document matches an item if it holds n consecutive words of it; or if, for some window of n words of
    the item, at least `share` of the window's `rare` rarest terms, in corpus and items, stand within n words of one of them, rare
    enough that every such share holds one of its kind, and are so rare that by chance fewer than one place of
    the corpus has them for all windows of the item, and fewer than one window of the other items; or if all the `rare` rarest terms of the whole item
    stand within `within` words of the rarest. Windows and items with fewer terms match with all of them.
    Terms that the corpus lacks are never among the rarest.
    """
    spark = index.sparkSession
    out = search(index, items, n, id_col, text_col).select("doc_id", "item_id", F.lit(n).alias("termen"))
    total = int(index.agg(F.sum(F.length("places"))).first()[0] or 0) // np.dtype(np.int32).itemsize
    for seq, owner, starts, names in _item_blocks(items, id_col, text_col):
        terms = np.unique(seq)
        wanted = spark.sparkContext.broadcast(terms)
        parts = index.select("terms", "counts").mapInArrow(_frequencies(wanted), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(terms), np.int64)
        df[parts["term"].to_numpy(dtype=np.int64)] = parts["n"].to_numpy(dtype=np.int64)
        # log2 of how unlikely a term is by chance in a stretch of the corpus, and in another item
        in_items = np.bincount(np.searchsorted(terms, np.unique(np.stack([seq, owner.astype(np.uint64)]), axis=1)[0]), minlength=len(terms))
        bits = np.log2(np.stack([np.maximum(total / (np.maximum(df, 1) * (2 * n + 1)), 1), (len(names) + 1) / np.maximum(in_items, 1)]))
        many = np.maximum(np.diff(starts) - n + 1, 1)
        whole, windows = [], []
        for a, b, own in zip(starts[:-1], starts[1:], many):
            words = seq[a:b]
            whole.append(_rarest(words, terms, df, rare))
            least = np.log2([max(total, 1) * own, 1 + many.sum() - own])
            windows.append(_windows([words[k : k + n] for k in range(own)], terms, df, bits, least, rare, share))
        query = spark.sparkContext.broadcast((whole, windows, names))
        out = out.unionByName(index.mapInArrow(_near(query, within, n), "doc_id long, item_id long, termen int"))
    return out.groupBy("doc_id", "item_id").agg(F.max("termen").alias("termen"))


def _rarest(words: np.ndarray, terms: np.ndarray, df: np.ndarray, rare: int) -> np.ndarray:
    """The distinct words that are the rarest of those that the corpus has, rarest first."""
    own = np.unique(words)
    n = df[np.searchsorted(terms, own)]
    own = own[n > 0]
    return own[np.argsort(n[n > 0], kind="stable")][:rare]


def _windows(parts: list[np.ndarray], terms: np.ndarray, df: np.ndarray, bits: np.ndarray, least: np.ndarray, rare: int, share: float):
    """(terms, sets, need, anchor, bits, least) of an item.

    Its chosen terms, for each window which of them it has and how many must be found, the terms of which each
    match holds one, and how unlikely each term is by chance, in the corpus and in other items, with the sums to reach.
    """
    sets: dict[tuple[int, ...], int] = {}
    anchors: set[int] = set()
    for words in parts:
        own = np.unique(words)
        at = np.searchsorted(terms, own)
        size, at = len(own), at[df[at] > 0]
        at = at[np.argsort(-bits[:, at].min(axis=0), kind="stable")][:rare]
        need = int(np.ceil(share * rare - 1e-9)) if size >= rare else size
        if size and len(at) >= need and (bits[:, at].sum(axis=1) >= least).all():
            sets[tuple(sorted(at.tolist()))] = need
            anchors |= set(at[: len(at) - need + 1].tolist())
    chosen = np.unique(np.asarray([t for x in sets for t in x], np.int64))
    member = np.zeros((len(sets), len(chosen)), np.float32)
    for k, x in enumerate(sets):
        member[k, np.searchsorted(chosen, np.asarray(x, np.int64))] = 1
    return terms[chosen], member, np.asarray(list(sets.values()), np.float32), np.isin(chosen, np.asarray(list(anchors), np.int64)), bits[:, chosen].astype(np.float32), least


def _near(query, within: int, reach: int):
    whole, windows, names = query.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for row in batch.to_pylist():
                docs, starts = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["starts"], np.int32)
                terms, counts, places = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["places"], np.int32)
                if not len(terms):
                    continue
                offset = np.cumsum(counts) - counts
                text = np.empty(len(places), np.int64)
                text[places] = np.repeat(np.arange(len(terms)), counts)
                doc_of = np.repeat(np.arange(len(docs)), np.diff(starts))
                number = np.full(len(terms), -1, np.int64)
                for own, parts, name in zip(whole, windows, names):
                    for d, k in [*_all_near(own, terms, counts, places, offset, starts, within), *_share_near(parts, terms, counts, places, offset, text, doc_of, number, reach)]:
                        key = int(docs[d]), int(name)
                        found[key] = max(k, found.get(key, 0))
            rows = [(d, i, k) for (d, i), k in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "termen"])

    return run


def _all_near(own, terms, counts, places, offset, starts, within: int) -> Iterator[tuple[int, int]]:
    """(document, terms) of the segment's documents that hold all terms within so many words of the rarest."""
    if not len(own):
        return
    at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
    if not (terms[at] == own).all():
        return
    # intersect from the rarest term: each of its postings needs all others nearby
    at = at[np.argsort(counts[at], kind="stable")]
    p = places[offset[at[0]] : offset[at[0]] + counts[at[0]]].astype(np.int64)
    doc = np.searchsorted(starts, p, side="right") - 1
    for t in at[1:]:
        q = places[offset[t] : offset[t] + counts[t]]
        lo = np.searchsorted(q, np.maximum(p - within, starts[doc]))
        hi = np.searchsorted(q, np.minimum(p + within, starts[doc + 1] - 1), side="right")
        p, doc = p[hi > lo], doc[hi > lo]
        if not len(p):
            return
    for d in np.unique(doc):
        yield d, len(own)


def _share_near(parts, terms, counts, places, offset, text, doc_of, number, reach: int) -> Iterator[tuple[int, int]]:
    """(document, terms) of the segment's documents that hold enough terms of a window within so many words of an anchor. number is -1 for all terms, and is left so."""
    chosen, member, need, anchor, bits, least = parts
    if not len(chosen):
        return
    at = np.minimum(np.searchsorted(terms, chosen), len(terms) - 1)
    here = terms[at] == chosen
    open_ = member @ here.astype(np.float32) >= need
    start = at[here & anchor & (member[open_].sum(axis=0) > 0)]
    if not len(start):
        return
    number[at[here]] = np.flatnonzero(here)
    p = np.concatenate([places[offset[t] : offset[t] + counts[t]] for t in start]).astype(np.int64)
    step = np.arange(-reach, reach + 1)
    for lo in range(0, len(p), 1 << 14):
        own = p[lo : lo + (1 << 14)]
        x = own[:, None] + step
        ok = (x >= 0) & (x < len(text))
        x = np.where(ok, x, own[:, None])
        k = np.where(doc_of[x] == doc_of[own][:, None], number[text[x]], -1)
        held = np.zeros((len(own), len(chosen) + 1), np.float32)
        held[np.arange(len(own))[:, None], k] = 1  # the last column takes the other words
        n = held[:, :-1] @ member[open_].T
        n[n < need[open_]] = 0
        for b, k in zip(bits, least):
            n[held[:, :-1] @ (member[open_] * b).T < k] = 0
        best = n.max(axis=1)
        for i in np.flatnonzero(best):
            yield doc_of[own[i]], int(best[i])
    number[at[here]] = -1
