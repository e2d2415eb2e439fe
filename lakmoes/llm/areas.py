"""Subject areas of documents by class-association rules.

Texts are cut into sentences and words once, into staged blocks; every later pass reads those. The sentences of
the labelled documents, as sets of words with the area of their document, are mined by parallel frequent-pattern
growth for rules words -> area: the sentences that are alike are counted first, each word's conditional pattern
base is a table, and a pattern grows by the frequent words of its base, so no group of sentences is ever held
in one place. A rule is kept if it has enough sentences, confidence and lift, and if no rule on fewer of its
words is as sure. Every sentence of the corpus is then scored: each matching rule gives its confidence as
evidence, as log odds against the share of the area; the sum is calibrated on the labelled sentences, and a
sentence is about the area with the most evidence, if that is enough. A document has the areas of at least a
quarter of its sentences that are about any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakmoes.llm import scan
from lakmoes.plans.stage import small, spread, stage

#: Rules are first fitted on at most so many labelled documents; which ones is settled by the hash of their id.
MAX_LABELLED = 200_000
ROUNDS = 2
MIN_SENTENCES = 4
MIN_CONFIDENCE, MIN_LIFT = 0.6, 2.0
#: A word takes part in the mining if some area has this share of its sentences.
TELLING = 0.3
MIN_GAIN = 0.05
#: Share of its sentences with an area that a document's first area has, for the document to teach.
CLEAR = 0.7
#: Words of a rule; growth ends there.
MAX_WORDS = 2
#: A sentence of more words, such as a table without stops, counts as several.
LONGEST = 512
QUARTER = 0.25
#: The rules are a model that every task holds; more of them, or of telling words, is an error rather than a cut.
MAX_MODEL = 2_000_000


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence, text, start, end) of each word; sentences are numbered through the block and end at a line end, at a stop before a blank, or after LONGEST words."""
    h, owner, start, end = scan.words(texts)
    cp, _ = scan.code_points(texts)
    stop = (cp == 46) | (cp == 33) | (cp == 63)
    blank = np.r_[(cp[1:] == 32) | (cp[1:] == 0xA0) | (cp[1:] < 32), True]
    cut = np.flatnonzero((stop & blank) | (cp == 10) | (cp == 0))
    sent = np.searchsorted(cut, start)
    if len(sent):
        first = np.r_[True, sent[1:] != sent[:-1]]
        at = np.arange(len(sent)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        sent = np.cumsum(first | (at % LONGEST == 0)) - 1
    return h, sent, owner, start, end


def normal_area(c: Column) -> Column:
    """An area's name with case, blanks and the sign between its words set aside."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))), r"[ _\-]+", "_")


def clean_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, area): the areas given to each document, spelt as in areas; what is no area, and null, is left out."""
    known = areas.where(F.col("area").isNotNull()).select(normal_area(F.col("area")).alias("k"), F.col("area").alias("name")).distinct()
    own = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_area(F.col("area")).alias("k"))
    return own.join(small(known), "k").select("doc_id", F.col("name").alias("area")).distinct()


_BLOCK = "ids binary, labels binary, owner binary, sizes binary, idx binary, uniq binary, words string"


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id").to_pylist(), np.int64)
        labels = np.asarray([-1 if x is None else x for x in batch.column("k").to_pylist()], np.int32)
        for lo, texts in scan.blocks(batch.column("text").to_pylist()):
            h, sent, owner, start, end = sentences(texts)
            uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            key = np.unique(sent * max(len(uniq), 1) + inverse)
            number, idx = np.divmod(key, max(len(uniq), 1))
            edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[edge, len(number)]).astype(np.uint16)
            joined = "\0".join(texts)
            words = "\0".join(joined[a:b].lower() for a, b in zip(start[first].tolist(), end[first].tolist()))
            idx = idx.astype(np.uint16 if len(uniq) <= 65_536 else np.uint32)
            of = owner[np.searchsorted(sent, number[edge])].astype(np.int32)
            row = [ids[lo : lo + len(texts)], labels[lo : lo + len(texts)], of, sizes, idx, uniq]
            yield pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in row], pa.array([words], pa.string())], names=[c.split()[0] for c in _BLOCK.split(", ")])


@dataclass
class Block:
    """Texts as sentences of distinct words: ids and labels (area number or -1) by text, owner (text number) and sizes by sentence, idx (place in uniq) by word in order of sentence and hash."""

    ids: np.ndarray
    labels: np.ndarray
    owner: np.ndarray
    sizes: np.ndarray
    idx: np.ndarray
    uniq: np.ndarray
    words: str


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = [batch.column(j)[i].as_py() for j in range(7)]
            sizes = np.frombuffer(raw[3], np.uint16).astype(np.int64)
            wide = np.uint16 if len(raw[4]) <= 2 * int(sizes.sum()) else np.uint32
            yield Block(np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int32), np.frombuffer(raw[2], np.int32), sizes, np.frombuffer(raw[4], wide).astype(np.int64), np.frombuffer(raw[5], np.uint64), raw[6])


def area_names(areas: DataFrame) -> list[str]:
    return [r[0] for r in areas.where(F.col("area").isNotNull()).select("area").distinct().orderBy("area").collect()]


def tokenised(docs: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """The texts of docs (doc_id, text) as staged blocks, each text with its area if just one was given to it, at most `most` of those. Null texts are empty ones; rows without id are left out."""
    names = area_names(areas)
    own = clean_labels(labels, areas).groupBy("doc_id").agg(F.max("area").alias("area"), F.count("*").alias("n")).where("n = 1")
    number = F.array_position(F.array(*[F.lit(a) for a in names]).cast("array<string>"), F.col("area")) - 1
    own = stage(own.select(F.col("doc_id").alias("_d"), number.cast("int").alias("k")), "p8-labels")
    total = own.count()
    if total > most:
        own = own.where(F.pmod(F.xxhash64("_d"), F.lit(1_000_000)) < int(1_000_000 * most / total))
    d = spread(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    return stage(d.join(small(own), F.col("doc_id") == F.col("_d"), "left").select("doc_id", "k", "text").mapInArrow(_blocked, _BLOCK), "p8-blocks")


@dataclass
class Rules:
    """Rules on words (hashes, sorted): `parts` has a row of places in words for each rule, -1 where it has fewer; a rule is looked up by its first part. evidence is by area."""

    areas: list[str]
    words: np.ndarray
    parts: np.ndarray
    evidence: np.ndarray
    prior: np.ndarray
    least: float = 0.0
    text: list[tuple[tuple[int, ...], str, int, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        order = np.argsort(self.parts[:, 0], kind="stable") if len(self.parts) else np.zeros(0, np.int64)
        self.parts, self.evidence = self.parts[order], self.evidence[order]
        self.first = np.searchsorted(self.parts[:, 0], np.arange(len(self.words) + 1)) if len(self.parts) else np.zeros(len(self.words) + 1, np.int64)


def _hash(word: str) -> np.uint64:
    return scan.words([word])[0][0]


def _evidence(c: np.ndarray, prior: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(c, 0.02) / np.maximum(prior, 0.02))


def rules_of(rows: list[tuple[tuple[int, ...], np.ndarray]], names: list[str], prior: np.ndarray, text=()) -> Rules:
    """Rules from (hashes of the words, confidence by area)."""
    words = np.unique(np.asarray([h for x, _ in rows for h in x], np.uint64))
    width = max((len(x) for x, _ in rows), default=1)
    parts = np.full((len(rows), width), -1, np.int64)
    for i, (x, _) in enumerate(rows):
        parts[i, : len(x)] = np.searchsorted(words, np.asarray(x, np.uint64))
    evidence = _evidence(np.asarray([c for _, c in rows]).reshape(len(rows), len(names)), prior)
    return Rules(names, words, parts, evidence, prior, text=list(text))


def score(b: Block, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, area number, evidence) of each sentence of the block that some rule matches.

    Linear in the words: each occurrence of a rule's first word is held against the other words of its sentence.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(rules.parts) or not len(b.idx):
        return none
    at = np.minimum(np.searchsorted(rules.words, b.uniq), len(rules.words) - 1)
    at = np.where(rules.words[at] == b.uniq, at, -1)
    w = at[b.idx]
    on = np.flatnonzero(w >= 0)
    w, sent = w[on], np.repeat(np.arange(len(b.sizes)), b.sizes)[on]
    many = rules.first[w + 1] - rules.first[w]
    who = np.repeat(np.arange(len(w)), many)
    rule = rules.first[w][who] + np.arange(len(who)) - (np.cumsum(many) - many)[who]
    sent_of = sent[who]
    held = sent * len(rules.words) + w  # rises, as words and places in a block both go by hash
    for j in range(1, rules.parts.shape[1]):
        other = rules.parts[rule, j]
        key = sent_of * len(rules.words) + other
        place = np.minimum(np.searchsorted(held, key), len(held) - 1)
        ok = (other < 0) | (held[place] == key)
        rule, sent_of = rule[ok], sent_of[ok]
    if not len(rule):
        return none
    edge = np.flatnonzero(np.r_[True, sent_of[1:] != sent_of[:-1]])
    total = np.add.reduceat(rules.evidence[rule], edge, axis=0)
    return b.owner[sent_of[edge]], total.argmax(axis=1), total.max(axis=1)


def _taught(b: Block, teacher: Rules | None) -> np.ndarray:
    """The area of each text of the block that teaches, else -1: the one it was given, or, with a teacher, the one that clearly leads in it by the rules."""
    if teacher is None:
        return b.labels
    doc, best, ev = score(b, teacher)
    sure = ev >= teacher.least
    n = np.zeros((len(b.ids), len(teacher.areas)))
    np.add.at(n, (doc[sure], best[sure]), 1)
    return np.where((n.max(axis=1) >= 2) & (n.max(axis=1) >= CLEAR * n.sum(axis=1)), n.argmax(axis=1), -1)


def _counts(k: int, teacher):
    """(h, k, n): in how many sentences of each area a word stands; h null counts the sentences. Blocks are added up before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = np.zeros(k, np.int64)

        def out() -> pa.RecordBatch:
            nonlocal total
            words, inverse = np.unique(np.concatenate([u for u, _ in held]) if held else np.zeros(0, np.uint64), return_inverse=True)
            n = np.zeros((len(words), k), np.int64)
            if held:
                np.add.at(n, inverse, np.concatenate([c for _, c in held]))
            w, a = np.nonzero(n)
            hs = pa.concat_arrays([pa.array(words[w].view(np.int64)), pa.nulls(k, pa.int64())])
            batch = pa.RecordBatch.from_arrays([hs, pa.array(np.r_[a, np.arange(k)].astype(np.int32)), pa.array(np.r_[n[w, a], total])], names=["h", "k", "n"])
            held.clear()
            total = np.zeros(k, np.int64)
            return batch

        for b in _read(batches):
            area = _taught(b, teacher and teacher.value)[b.owner]
            total += np.bincount(area[area >= 0], minlength=k)
            area = np.repeat(area, b.sizes)
            on = area >= 0
            n = np.bincount(b.idx[on] * k + area[on], minlength=len(b.uniq) * k).reshape(-1, k)
            some = np.flatnonzero(n.sum(axis=1))
            held.append((b.uniq[some], n[some]))
            if len(held) == 16:
                yield out()
        yield out()

    return run


def _sentence_items(keep, teacher):
    """(items, k): the kept words of each sentence by their places in `keep`, rising, and its area."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keep.value)
        known = keep.value[order]
        for b in _read(batches):
            area = _taught(b, teacher and teacher.value)[b.owner]
            at = np.minimum(np.searchsorted(known, b.uniq), len(known) - 1)
            item = np.where(known[at] == b.uniq, order[at], -1)[b.idx]
            sent = np.repeat(np.arange(len(b.sizes)), b.sizes)
            on = (item >= 0) & (area[sent] >= 0)
            item, sent = item[on], sent[on]
            by = np.lexsort((item, sent))
            item, sent = item[by].astype(np.int32), sent[by]
            edge = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]]) if len(sent) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[edge, len(item)].astype(np.int32)), pa.array(item))
            yield pa.RecordBatch.from_arrays([lists, pa.array(area[sent[edge]].astype(np.int32))], names=["items", "k"])

    return run


def grow(transactions: DataFrame, least: int, max_words: int, k: int) -> DataFrame:
    """(x array<int>, k, n): the frequent patterns of 2 to max_words items, with their number of transactions per class, from transactions (items array<int> rising, k, n).

    Frequent-pattern growth with tables for trees: an item's conditional pattern base holds, for the transactions
    with it, the items before it; like ones are added up. A pattern grows by each item that is frequent in its base.
    Items stand in order of falling frequency, so the bases of the most frequent ones have the fewest different rows.
    """
    bases = transactions.select(F.posexplode("items").alias("at", "last"), "items", "k", "n")
    bases = bases.where("at > 0").select(F.array("last").alias("p"), F.slice("items", F.lit(1), F.col("at")).alias("base"), "k", "n")
    out = None
    for size in range(2, max_words + 1):
        last = size == max_words
        if not last:
            bases = stage(bases.groupBy("p", "base", "k").agg(F.sum("n").alias("n")), f"p8-bases-{size}")
        steps = bases.select("p", *([] if last else ["base"]), "k", "n", F.posexplode("base").alias("at", "item"))
        counts = steps.groupBy("p", "item", "k").agg(F.sum("n").alias("n"))
        frequent = counts.groupBy("p", "item").agg(F.sum("n").alias("m"), F.collect_list(F.struct("k", "n")).alias("kn")).where(F.col("m") >= least)
        level = stage(frequent.select(F.concat("p", F.array("item")).alias("x"), F.col("m"), "kn"), f"p8-level-{size}")
        out = level if out is None else out.unionByName(level)
        if last or level.isEmpty():
            break
        keys = level.select(F.col("x").alias("p2"))
        grown = steps.where("at > 0").select(F.concat("p", F.array("item")).alias("p"), F.slice("base", F.lit(1), F.col("at")).alias("base"), "k", "n")
        bases = grown.join(small(keys), F.col("p") == F.col("p2"), "left_semi")
    return out


def mine(blocks: DataFrame, areas: DataFrame, max_words: int = MAX_WORDS) -> Rules:
    """The rules from the blocks of `tokenised`.

    First from the documents that were given one area, each sentence taken for the document's area. Then ROUNDS
    times more from all documents of the corpus, each with the area that clearly leads in it by the rules so
    far: that corrects wrong labels and documents with two areas, and finds the words that few labels show.
    """
    names = area_names(areas)
    first = _seeded(_fit(blocks, names, None, max_words), areas)
    if not len(first.parts):
        return first
    first.least = _calibrate(blocks, first)
    rules = first
    for _ in range(ROUNDS):
        again = _fit(blocks, names, rules, max_words)
        if not len(again.parts):
            break
        again.least = _calibrate(blocks, again)
        rules = again
    return rules


def _seeded(rules: Rules, areas: DataFrame) -> Rules:
    """The rules of the first round, and one for each word that the description of one area alone has (column omschrijving, if there is one), taken for as sure as nine sentences in ten."""
    if "omschrijving" not in areas.columns:
        return rules
    where: dict[str, set[int]] = {}
    at = {a: i for i, a in enumerate(rules.areas)}
    for r in areas.where(F.col("area").isNotNull() & F.col("omschrijving").isNotNull()).select("area", "omschrijving").collect():
        for w in re.findall(r"[^\W_]+", r["omschrijving"].lower()):
            where.setdefault(w, set()).add(at[r["area"]])
    alone = rules.words[rules.parts[(rules.parts[:, 1:] < 0).all(axis=1), 0]] if len(rules.parts) else rules.words
    known = set(alone.tolist())
    seeds = [(w, next(iter(a)), _hash(w)) for w, a in sorted(where.items()) if len(a) == 1 and len(rules.areas) > 1]
    seeds = [x for x in seeds if int(x[2]) not in known]
    if not seeds:
        return rules
    c = np.full((len(seeds), len(rules.areas)), 0.1 / len(rules.areas))
    c[np.arange(len(seeds)), [a for _, a, _ in seeds]] += 0.9
    words = np.union1d(rules.words, np.asarray([h for _, _, h in seeds], np.uint64))
    old = np.where(rules.parts >= 0, np.searchsorted(words, rules.words)[rules.parts] if len(rules.words) else 0, -1)
    new = np.full((len(seeds), old.shape[1]), -1, np.int64)
    new[:, 0] = np.searchsorted(words, np.asarray([h for _, _, h in seeds], np.uint64))
    evidence = np.concatenate([rules.evidence, _evidence(c, rules.prior)])
    return Rules(rules.areas, words, np.concatenate([old, new]), evidence, rules.prior, text=rules.text + [((int(h),), rules.areas[a], 0, 0.9) for _, a, h in seeds])


def _bounded(df: DataFrame, what: str) -> list:
    n = df.count()
    if n > MAX_MODEL:
        raise ValueError(f"{n} {what}, above {MAX_MODEL}: too many for a model that every task holds; raise MIN_SENTENCES")
    return df.collect()


def _spelt(wanted):
    """(h, woord) of the wanted words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = wanted.value
        for b in _read(batches):
            on = np.flatnonzero(np.isin(b.uniq, left))
            if len(on):
                left = np.setdiff1d(left, b.uniq[on])
                words = b.words.split("\0")
                yield pa.RecordBatch.from_arrays([pa.array(b.uniq[on].view(np.int64)), pa.array([words[i] for i in on.tolist()])], names=["h", "woord"])

    return run


def spelling(blocks: DataFrame, rules: Rules) -> DataFrame:
    """(h, woord): the words of the rules, as the corpus spells them in lower case."""
    wanted = blocks.sparkSession.sparkContext.broadcast(rules.words)
    return blocks.mapInArrow(_spelt(wanted), "h long, woord string").groupBy("h").agg(F.min("woord").alias("woord"))


def rule_table(blocks: DataFrame, rules: Rules) -> DataFrame:
    """(woorden, area, zinnen, zekerheid) of the rules, with their words spelt."""
    spark = blocks.sparkSession
    rows = [(i, [int(np.uint64(h).view(np.int64)) for h in x], *rest) for i, (x, *rest) in enumerate(rules.text)]
    r = spark.createDataFrame(rows, "i int, hs array<long>, area string, zinnen int, zekerheid double")
    words = r.select("i", "area", "zinnen", "zekerheid", F.explode("hs").alias("h")).join(spelling(blocks, rules), "h")
    return words.groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("woord")), " ").alias("woorden"), *[F.first(c).alias(c) for c in ("area", "zinnen", "zekerheid")]).drop("i")


def _fit(blocks: DataFrame, names: list[str], teacher: Rules | None, max_words: int) -> Rules:
    """Rules from the sentences of the texts that teach."""
    sc = blocks.sparkSession.sparkContext
    taught = sc.broadcast(teacher) if teacher is not None else None
    k = len(names)
    counts = stage(blocks.mapInArrow(_counts(k, taught), "h long, k int, n long").groupBy("h", "k").agg(F.sum("n").alias("n")), "p8-counts") if k else None
    total = {r["k"]: r["n"] for r in counts.where("h is null").collect()} if k else {}
    prior = np.asarray([total.get(i, 0) + 1 for i in range(k)], float)
    prior /= max(prior.sum(), 1)
    if not sum(total.values()):
        return rules_of([], names, prior)
    # words that say nothing about the area take no part in the mining; a few thousand of any vocabulary do
    least = F.element_at(F.array(*[F.lit(max(TELLING, min(0.9, MIN_LIFT * float(p)))) for p in prior]), F.col("k") + 1)
    by_word = counts.where("h is not null").groupBy("h").agg(F.sum("n").alias("m"), F.max(F.struct("n", "k")).alias("top"), F.collect_list(F.struct("k", "n")).alias("kn")).select("h", "m", "top.n", "top.k", "kn")
    telling = stage(by_word.where((F.col("m") >= MIN_SENTENCES) & (F.col("n") >= F.col("m") * least)).select("h", "m", "kn"), "p8-telling")
    words = sorted(_bounded(telling.select("h", "m"), "telling words"), key=lambda r: (-r["m"], r["h"]))
    if not words:
        return rules_of([], names, prior)
    hashes = np.asarray([r["h"] for r in words], np.int64)
    keep = sc.broadcast(hashes.view(np.uint64))
    alike = blocks.mapInArrow(_sentence_items(keep, taught), "items array<int>, k int").where(F.size("items") > 1)
    transactions = stage(alike.groupBy("items", "k").agg(F.count("*").alias("n")), "p8-sentences")
    grown = grow(transactions, MIN_SENTENCES, max_words, k) if max_words > 1 else None
    weights = F.array(*[F.lit(2 * float(p)) for p in prior])

    def sure(kn: str) -> Column:
        """(confidence, area) of a pattern's surest area; the share of the area counts as two sentences."""
        return F.array_max(F.transform(kn, lambda s: F.struct(((s["n"] + F.element_at(weights, s["k"] + 1)) / (F.col("m") + 2)).alias("c"), s["k"].alias("k"))))

    lift = F.element_at(F.array(*[F.lit(float(p)) for p in prior]), F.col("t.k") + 1)
    kept = (F.col("t.c") >= MIN_CONFIDENCE) & (F.col("t.c") / lift >= MIN_LIFT)
    one = telling.withColumn("t", sure("kn"))
    rows = [((int(np.int64(r["h"]).view(np.uint64)),), r) for r in _bounded(one.where(kept).select("h", "m", "kn", "t"), "rules")]
    if grown is not None:
        # a longer rule has to be surer, for its area, than each of its words alone
        alone = {int(np.int64(r["h"]).view(np.uint64)): {x["k"]: (x["n"] + 2 * prior[x["k"]]) / (r["m"] + 2) for x in r["kn"]} | {-1: 2 / (r["m"] + 2)} for r in telling.collect()}
        for r in _bounded(grown.withColumn("t", sure("kn")).where(kept), "rules"):
            x = tuple(int(h) for h in hashes[r["x"]].view(np.uint64))
            top = r["t"]["k"]
            if all(alone[h].get(top, alone[h][-1] * prior[top]) + MIN_GAIN <= r["t"]["c"] for h in x):
                rows.append((x, r))
    found, text = [], []
    for x, r in rows:
        c = 2 * prior
        for s in r["kn"]:
            c[s["k"]] += s["n"]
        c = c / (r["m"] + 2)
        found.append((x, c))
        text.append((x, names[int(c.argmax())], int(r["m"]), float(c.max())))
    return rules_of(found, names, prior, text)


def _judged(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches):
            doc, area, ev = score(b, rules.value)
            on = b.labels[doc] >= 0
            bins, inverse = np.unique(np.floor(ev[on] * 4).astype(np.int32), return_inverse=True)
            good = b.labels[doc[on]] == area[on]
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.bincount(inverse, weights=good, minlength=len(bins)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(bins)))], names=["bin", "goed", "n"])

    return run


def _calibrate(blocks: DataFrame, rules: Rules) -> float:
    """The least evidence from which on labelled sentences are right at least half as often as the surest ones."""
    b = blocks.sparkSession.sparkContext.broadcast(rules)
    rows = sorted((r["bin"], r["g"] / r["m"], r["m"]) for r in blocks.mapInArrow(_judged(b), "bin int, goed long, n long").groupBy("bin").agg(F.sum("goed").alias("g"), F.sum("n").alias("m")).collect())
    if not rows:
        return 0.0
    best = max((r[1] for r in rows if r[2] >= 20), default=1.0)
    good = [r[0] for r in rows if r[1] >= 0.5 * best]
    return min(good) / 4 if good else 0.0


def _assigned(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rules.value
        k = len(r.areas)
        for b in _read(batches):
            doc, area, ev = score(b, r)
            sure = ev >= r.least
            n = np.zeros((len(b.ids), k))
            np.add.at(n, (doc[sure], area[sure]), 1)
            weak = np.zeros((len(b.ids), k))
            np.add.at(weak, (doc, area), np.maximum(ev, 1e-6))
            total = n.sum(axis=1)
            weak[weak.sum(axis=1) == 0] = r.prior
            # the two areas with the most sentences; the second, and the first of a document without any, under conditions
            top = np.argsort(-n, axis=1, kind="stable")[:, :2]
            top[total == 0, 0] = weak[total == 0].argmax(axis=1)
            share = np.take_along_axis(n, top, axis=1) / np.maximum(total, 1)[:, None]
            use = (share >= QUARTER) & (total > 0)[:, None]
            use[:, 0] = True
            i, j = np.nonzero(use)
            names = pa.array(r.areas, pa.string()).take(pa.array(top[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[i]), names, pa.array(share[i, j]), pa.array(total[i].astype(np.int64))], names=["doc_id", "area", "aandeel", "zinnen"])

    return run


def assign(blocks: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, area, aandeel, zinnen): one or two areas of each document, the share of its sentences that are about the area, and how many are about any.

    A document without evidence, an empty or null text too, gets the area with the most weak evidence, at last the most frequent one.
    """
    if not rules.areas:
        return blocks.sparkSession.createDataFrame([], "doc_id long, area string, aandeel double, zinnen long")
    b = blocks.sparkSession.sparkContext.broadcast(rules)
    return blocks.mapInArrow(_assigned(b), "doc_id long, area string, aandeel double, zinnen long")
