"""New rows against all that was accepted before: a segment index with bounded edit distance.

Rows are taken by rising id. A row repeats an accepted row with a smaller id if both have the same digest,
or if it has no digest and both have the same address, or if the word sequences of both texts agree. A row
that repeats none is accepted.

Texts are compared as strings over the alphabet of their five-word sequences, each sequence once, in a fixed
order: texts whose passages were moved are the same string. Two such strings of n and m signs agree if their
edit distance under insertion and deletion is at most (1 - t) / (1 + t) * (n + m); then, of one segment more
than the distance allows, at least one is whole in both. The segments are one sign long, and the order puts
the rarest sign of the corpus first, so that the first ones, a number fixed by the length, are enough: they are
stored by sign, length and position, probed with those of a new batch, filtered by length, position and the
distance of two bitmaps, which is never above the true one, and the edit distance of what is left is computed.

`SegmentIndex.append` checks a batch against what was accepted and appends what is new. Of the history it
looks up only the keys, classes and postings of the batch; nothing of it is grouped or normalised again.

How rare a sign is gets counted over all texts of the first batch, exactly. The counting is done on blocks: a
block of texts sends its distinct signs, packed, to ranges of signs, and gets back one byte for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakmoes.functions.urls import normal_digest, normal_url
from lakmoes.llm import scan
from lakmoes.plans.stage import small, spread, stage, stage_path

WORDS = 5
SIMILAR = (7, 10)
#: Bits of a sign in the index; verification takes 64. More only cost room, fewer only candidates.
BITS = 40
RANGE_SIGNS = 4_000_000
#: Signs among the first ones of more texts than this are joined together with a second one.
HOT = 1000
_SIG_WORDS = 4


def _pack(x: np.ndarray) -> bytes:
    """A rising array of numbers: differences, by byte planes, compressed."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes()) if len(x) else b""


def _unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def _distinct(texts: list[str], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(text number, sign) of the distinct five-word sequences of each text, sorted."""
    h, owner, _, _ = scan.words(texts)
    w, o = scan.windows(h, owner, WORDS)
    w = w >> np.uint64(64 - bits)
    order = np.lexsort((w, o))
    w, o = w[order], o[order]
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    return o[keep], w[keep]


_SEGMENT = "seg long, ids binary, sizes binary, uniq binary, idx binary, class1 binary, class2 binary, sigs binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("file_id").to_pylist(), np.int64)
        for lo, texts in scan.blocks(batch.column("text").to_pylist()):
            o, w = _distinct(texts, BITS)
            n = np.bincount(o, minlength=len(texts)).astype(np.int32)
            uniq, idx = np.unique(w, return_inverse=True)
            m = scan.mix64(w)
            c1, c2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            np.add.at(c1, o, m)
            np.add.at(c2, o, scan.mix64(m ^ np.uint64(0x51ED2701)))
            # the parity of how many signs fall on each bit
            bit = (m >> np.uint64(20)) & np.uint64(64 * _SIG_WORDS - 1)
            sigs = np.zeros((len(texts), _SIG_WORDS), np.uint64)
            np.bitwise_xor.at(sigs, (o, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            own = ids[lo : lo + len(texts)]
            row = [own.tobytes(), n.tobytes(), _pack(uniq), _pack(idx.astype(np.uint64) + (o.astype(np.uint64) << np.uint64(32))), c1.tobytes(), c2.tobytes(), sigs.tobytes()]
            seg = int(scan.mix64(own.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), *[pa.array([x], pa.binary()) for x in row]], names=[c.split()[0] for c in _SEGMENT.split(", ")])


def blocks(docs: DataFrame, scanned: bool = True) -> DataFrame:
    """The texts of docs (file_id, text) as blocks of packed signs, staged. Null ids and texts are left out. scanned: docs is a plain scan, which may be spread."""
    d = docs.where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), "text")
    return stage((spread(d, "file_id") if scanned else d).mapInArrow(_blocks, _SEGMENT), "p2-blocks")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = np.frombuffer(r["sizes"], np.int32)
            on = n > 0
            sigs = np.frombuffer(r["sigs"], np.int64).reshape(-1, _SIG_WORDS)[on]
            cols = [np.frombuffer(r["ids"], np.int64)[on], np.frombuffer(r["class1"], np.int64)[on], np.frombuffer(r["class2"], np.int64)[on], n[on]]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sigs.reshape(-1)), _SIG_WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], names=["file_id", "class1", "class2", "n", "sig"])


def _spread(bits: int):
    """Each block's distinct signs, cut into 2 ** bits ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                uniq, idx = _unpack(r["uniq"]), _unpack(r["idx"]) & np.uint64(0xFFFFFFFF)
                count = np.bincount(idx.astype(np.int64), minlength=len(uniq)).astype(np.uint32)
                edge = np.searchsorted(uniq, np.arange(1 << bits, dtype=np.uint64) << np.uint64(BITS - bits))
                edge = np.append(edge, len(uniq))
                on = np.flatnonzero(np.diff(edge))
                signs = [_pack(uniq[edge[k] : edge[k + 1]]) for k in on]
                counts = [zstandard.compress(count[edge[k] : edge[k + 1]].tobytes(), 1) for k in on]
                yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array([r["seg"]] * len(on), pa.int64()), pa.array(signs, pa.binary()), pa.array(counts, pa.binary())], names=["bereik", "seg", "signs", "counts"])

    return run


_POSTING = "sign long, file_id long, n int, pos int, extra boolean, bekend boolean"


def rarity_code(count: np.ndarray) -> np.ndarray:
    """A count as one byte that rises with it: exact up to 200, by quarters of a doubling beyond."""
    far = 200 + np.ceil(4 * np.log2(np.maximum(count, 200) / 200))
    return np.minimum(np.where(count <= 200, count, far), 255).astype(np.uint8)


def _tally(table: pa.Table) -> pa.Table:
    """The code of each sign of a range, for each block that sent it, in the order in which it sent them; and, in a row without block, the signs that stand in more than one text, with their codes."""
    signs = [_unpack(x) for x in table.column("signs").to_pylist()]
    counts = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint32) for x in table.column("counts").to_pylist()])
    uniq, inverse = np.unique(np.concatenate(signs), return_inverse=True)
    n = np.bincount(inverse, weights=counts)
    own = rarity_code(n)
    code = own[inverse]
    edge = np.cumsum([0, *map(len, signs)])
    blobs = [zstandard.compress(code[a:b].tobytes(), 1) for a, b in zip(edge[:-1], edge[1:])]
    seg, at = table.column("seg").to_pylist(), table.column("bereik")[0].as_py()
    on = n > 1
    known = [None] * len(seg) + [_pack(uniq[on])]
    return pa.table({"seg": pa.array([*seg, None], pa.int64()), "bereik": pa.array([at] * len(known), pa.int32()), "codes": pa.array([*blobs, zstandard.compress(own[on].tobytes(), 1)], pa.binary()), "bekend": pa.array(known, pa.binary())})


def _prefixes(num: int, den: int):
    """The first segments of each text and one more (marked), by rarity, also those that no other text has so far."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        codes = np.zeros(0, np.uint8)
        if right.num_rows:
            order = np.argsort(right.column("bereik").to_numpy())
            blobs = right.column("codes").to_pylist()
            codes = np.concatenate([np.frombuffer(zstandard.decompress(blobs[k]), np.uint8) for k in order])
        for r in left.to_pylist():
            uniq, both = _unpack(r["uniq"]), _unpack(r["idx"])
            idx, doc = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)
            if len(codes) != len(uniq):
                raise RuntimeError("a block and its counts don't fit together")
            n = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
            order = np.argsort((doc << 40) | (codes[idx].astype(np.int64) << 32) | idx, kind="stable")
            idx, doc = idx[order], doc[order]
            place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
            first = n - -(-n * num // den) + 1
            on = place <= first[doc]
            ids = np.frombuffer(r["ids"], np.int64)
            out.append(pa.table({"sign": uniq[idx[on]].astype(np.int64), "file_id": ids[doc[on]], "n": n[doc[on]].astype(np.int32), "pos": place[on].astype(np.int32), "extra": (place == first[doc])[on], "bekend": codes[idx[on]] > 1}))
        types = (("sign", pa.int64()), ("file_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("extra", pa.bool_()), ("bekend", pa.bool_()))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in types})

    return run


def _range_bits(segments: DataFrame) -> int:
    """So many ranges, as a power of two, that each has about RANGE_SIGNS signs."""
    total = segments.agg(F.sum(F.length("idx"))).first()[0] or 0
    return min(20, max(6, int(np.ceil(np.log2(max(1, total / 3) / RANGE_SIGNS + 1)))))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("file_id").to_pylist()
        for lo, texts in scan.blocks(batch.column("text").to_pylist()):
            o, w = _distinct(texts)
            edge = np.searchsorted(o, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + len(texts)], pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(w.view(np.int64)))], names=["file_id", "signs"])


def _distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(_SIG_WORDS)), F.lit(0))


def _fits(num: int, den: int, once: bool, place: bool = True) -> Column:
    """Whether two postings x and y can belong to agreeing texts, by their lengths and the places of the shared sign; once: each pair from one side only."""
    apart = F.col("x.file_id") < F.col("y.file_id") if once else F.col("x.file_id") != F.col("y.file_id")
    fits = apart & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
    if place:
        need = F.ceil((F.col("x.n") + F.col("y.n")) * num / F.lit(float(num + den)) - 1e-9)
        fits = fits & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need)
    return fits


def candidates(p: DataFrame, similar: tuple[int, int], hot: int = HOT, new: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: texts that share a sign of their first segments and pass the filters.

    p: postings of class representatives. A sign with more than `hot` postings forms no pairs by
    itself: two agreeing texts that share one among their first signs share a second one among those and the
    sign after them, so such texts are joined on both. Nothing is left out. With `new` (file_id), one of the
    two is new.
    """
    num, den = similar
    fresh = small(stage(new.select("file_id").distinct(), "p2-new")) if new is not None else None
    own = lambda d: d if fresh is None else d.join(fresh, "file_id", "left_semi")
    first = p.where("not extra")
    if fresh is not None:  # only the stored postings that the new signs probe take part
        first = stage(first.join(small(stage(own(first).select("sign").distinct(), "p2-probe")), "sign", "left_semi"), "p2-probed")
    counts = first.groupBy("sign").agg(F.count("*").alias("m")).where(F.col("m") > hot)
    frequent = stage(counts.select("sign"), "p2-hot")
    some_hot = not frequent.isEmpty()
    plain = first.join(small(frequent), "sign", "left_anti") if some_hot else first
    ordered = [F.least("x.file_id", "y.file_id").alias("a"), F.greatest("x.file_id", "y.file_id").alias("b")]
    pairs = plain.alias("x").join(own(plain).alias("y"), (F.col("x.sign") == F.col("y.sign")) & _fits(num, den, new is None)).select(*ordered)
    if some_hot:
        marked = p.join(small(frequent.withColumn("heet", F.lit(True))), "sign", "left")
        sets = marked.groupBy("file_id").agg(F.max("n").alias("n"), F.collect_list(F.when(F.col("heet") & ~F.col("extra"), F.col("sign"))).alias("h"), F.collect_list("sign").alias("all")).where(F.size("h") > 0)
        both = F.flatten(F.transform("h", lambda x: F.transform(F.filter("all", lambda y: y != x), lambda y: F.named_struct(F.lit("u"), F.least(x, y), F.lit("v"), F.greatest(x, y)))))
        two = stage(sets.select("file_id", "n", F.explode(F.array_distinct(both)).alias("k")).select("file_id", "n", "k.u", "k.v"), "p2-two")
        on = (F.col("x.u") == F.col("y.u")) & (F.col("x.v") == F.col("y.v")) & _fits(num, den, new is None, False)
        pairs = pairs.union(two.alias("x").join(own(two).alias("y"), on).select(*ordered))
    return pairs.distinct()


def edit_distance(a: Column, b: Column) -> Column:
    """The edit distance under insertion and deletion of two strings of distinct signs in one order: what stands in only one of them."""
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def similar_pairs(docs: DataFrame, posts: DataFrame, reps: DataFrame, similar: tuple[int, int] = SIMILAR, new: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """(a, b): texts a < b of reps (file_id, n, sig) that agree. With `new` (file_id), only pairs of which one is new.

    Pairs are formed between texts that share a sign of their first segments, filtered by the distance of their
    bitmaps, and verified by the edit distance of their whole strings.
    """
    num, den = similar
    # (n + m) (1 - t) / (1 + t) bounds the edit distance of agreeing texts, and that of the bitmaps
    within = lambda d, n, m: d * (den + num) <= (n + m) * (den - num)
    pairs = stage(candidates(posts, similar, hot, new), "p2-pairs")
    s = reps.select("file_id", "n", "sig")
    pairs = pairs.join(s.select(F.col("file_id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(s.select(F.col("file_id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    close = stage(pairs.where(within(_distance(F.col("sa"), F.col("sb")), F.col("na"), F.col("nb"))).select("a", "b"), "p2-close")
    ids = close.select(F.col("a").alias("file_id")).union(close.select("b")).distinct()
    texts = docs.where(F.col("text").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), "text").join(small(stage(ids, "p2-ids")), "file_id", "left_semi")
    signs = stage(texts.mapInArrow(_exact, "file_id long, signs array<long>"), "p2-signs")
    both = close.join(signs.select(F.col("file_id").alias("a"), F.col("signs").alias("ta")), "a").join(signs.select(F.col("file_id").alias("b"), F.col("signs").alias("tb")), "b")
    return both.where(within(edit_distance(F.col("ta"), F.col("tb")), F.size("ta"), F.size("tb"))).select("a", "b").distinct()


def decide(gives: DataFrame, takes: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(file_id_1, file_id_2): each row of takes that repeats an accepted row, with the earliest it repeats.

    What taking the rows one by one gives, in rounds: a row is accepted once no smaller row of its groups is
    accepted or open, and falls once one is accepted. The rounds end when no row is open; every round decides
    at least the smallest open row of each connected part. `accepted` (soort, groep, eerst): groups that
    history has settled already, with their earliest accepted row.
    """
    spark = gives.sparkSession
    least = accepted if accepted is not None else spark.createDataFrame([], "soort string, groep long, eerst long")
    open_ = stage(takes.select("file_id").union(gives.select("file_id")).distinct(), "p2-open-0")
    k = 0
    while not open_.isEmpty():
        k += 1
        g = gives.join(open_, "file_id", "left_semi").groupBy("soort", "groep").agg(F.min("file_id").alias("open"))
        stats = g.join(least, ["soort", "groep"], "full_outer")
        seen = takes.join(open_, "file_id", "left_semi").join(stats, ["soort", "groep"]).groupBy("file_id").agg(F.min("eerst").alias("eerst"), F.min("open").alias("open"))
        state = open_.join(seen, "file_id", "left").withColumn("oordeel", F.when(F.col("eerst") < F.col("file_id"), "herhaalt").when(F.col("open") < F.col("file_id"), "open").otherwise("nieuw"))
        state = stage(state.select("file_id", "oordeel"), f"p2-state-{k}")
        won = gives.join(state.where("oordeel = 'nieuw'"), "file_id", "left_semi").groupBy("soort", "groep").agg(F.min("file_id").alias("eerst"))
        least = stage(least.unionByName(won).groupBy("soort", "groep").agg(F.min("eerst").alias("eerst")), f"p2-least-{k}")
        open_ = stage(state.where("oordeel = 'open'").select("file_id"), f"p2-open-{k}")
    return takes.join(least, ["soort", "groep"]).where("eerst < file_id").groupBy("file_id").agg(F.min("eerst").alias("file_id_1")).select("file_id_1", F.col("file_id").alias("file_id_2"))


def one_text(docs: DataFrame) -> DataFrame:
    """docs (file_id, text) with one text per file: of several the longest, then the last by order. Only ids are read to see whether there are several."""
    d = docs.select(F.col("file_id").cast("bigint").alias("file_id"), "text")
    if d.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1 and file_id is not null").limit(1).isEmpty():
        return d
    one = d.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"))
    return stage(one, "p2-one-text")


def _looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """The code of each sign that a block sent, as the index has it; 0 for a sign it doesn't know."""
    known = _unpack(right.column("bekend")[0].as_py()) if right.num_rows else np.zeros(0, np.uint64)
    code = np.frombuffer(zstandard.decompress(right.column("codes")[0].as_py()), np.uint8) if len(known) else np.zeros(0, np.uint8)
    blobs = []
    for raw in left.column("signs").to_pylist():
        s = _unpack(raw)
        got = np.zeros(len(s), np.uint8)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            got = np.where(known[at] == s, code[at], 0).astype(np.uint8)
        blobs.append(zstandard.compress(got.tobytes(), 1))
    return pa.table({"seg": left.column("seg"), "bereik": left.column("bereik"), "codes": pa.array(blobs, pa.binary())})


_MEMBER = "file_id long, class1 long, class2 long, n int, sig array<long>"
_ORDER = "bereik int, bekend binary, codes binary"
_CODES = "seg long, bereik int, codes binary, bekend binary"


class SegmentIndex:
    """What was accepted so far, under a folder, one part per batch: `keys` (soort, sleutel, file_id) of digests and
    addresses, `classes` (texts with their fingerprint and bitmap), `postings` by sign, and the order of rarity, which
    is settled by the first batch and then stays, so that old postings keep their places; signs it doesn't know count
    as rarest. A batch counts once its keys, which are written last, are there.
    """

    def __init__(self, spark, root: str, similar: tuple[int, int] = SIMILAR) -> None:
        self.spark, self.root, self.similar = spark, root.rstrip("/"), similar

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _parts(self, name: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._path(name))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str, schema: str, batches: int) -> DataFrame:
        paths = [self._path(f"{name}/batch-{k}") for k in range(batches)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _postings(self, segments: DataFrame, first: bool) -> DataFrame:
        """The postings of a batch by the order of rarity, which the first batch settles; the number of ranges is part of its path."""
        if first:
            bits = _range_bits(segments)
            sent = segments.select("seg", "uniq", "idx").mapInArrow(_spread(bits), "bereik int, seg long, signs binary, counts binary")
            told = stage(sent.groupBy("bereik").applyInArrow(_tally, _CODES), "p2-codes")
            told.where("seg is null").select("bereik", "bekend", "codes").write.mode("overwrite").parquet(self._path(f"rarity/bits-{bits}"))
            codes = told.where("seg is not null").drop("bekend")
        else:
            name = self._parts("rarity")[0]
            sent = segments.select("seg", "uniq", "idx").mapInArrow(_spread(int(name.split("-")[1])), "bereik int, seg long, signs binary, counts binary")
            order = self.spark.read.schema(_ORDER).parquet(self._path(f"rarity/{name}"))
            codes = sent.groupBy("bereik").cogroup(order.groupBy("bereik")).applyInArrow(_looked_up, "seg long, bereik int, codes binary")
        both = segments.select("seg", "ids", "sizes", "uniq", "idx").groupBy("seg").cogroup(codes.groupBy("seg"))
        return stage(both.applyInArrow(_prefixes(*self.similar), _POSTING), "p2-new-postings")

    def append(self, files: DataFrame, docs: DataFrame, history_docs: DataFrame) -> DataFrame:
        """(file_id_1, file_id_2): the rows of the batch `files` that repeat, with the earliest accepted row each repeats.

        files: (file_id, sha256, url), all with larger ids than any before; docs: (file_id, text) of the batch;
        history_docs: of all texts, read by id for the pairs to verify. Rows delivered twice under one file_id
        count once, null urls match nothing, a text of fewer than five words agrees with none, of several texts
        of a file the longest counts.
        """
        k = len(self._parts("keys"))
        batch = files.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), normal_digest(F.col("sha256")).alias("digest"), normal_url(F.col("url")).alias("adres"))
        batch = stage(batch.groupBy("file_id").agg(F.min_by(F.struct("digest", "adres"), F.struct(F.col("digest").isNull(), "digest", "adres")).alias("r")).select("file_id", "r.*"), "p2-batch")
        ids = small(batch.select("file_id"))
        texts = one_text(docs.join(ids, "file_id", "left_semi") if k else docs)
        segments = blocks(texts, scanned=not k)
        posts = self._postings(segments, not k)
        own = stage(segments.select("ids", "sizes", "class1", "class2", "sigs").mapInArrow(_members, _MEMBER).join(ids, "file_id", "left_semi"), "p2-members")
        gives, takes, settled = self._groups(batch, own, posts, history_docs, k)
        out = stage(decide(gives, takes, settled), "p2-repeats")
        gone = small(out.select(F.col("file_id_2").alias("file_id")))
        new = batch.join(gone, "file_id", "left_anti")
        keys = new.select(F.explode(F.array(F.struct(F.lit("d").alias("soort"), F.col("digest").alias("sleutel")), F.struct(F.lit("a").alias("soort"), F.col("adres").alias("sleutel")))).alias("k"), "file_id")
        keys = keys.where(F.col("k.sleutel").isNotNull()).groupBy("k.soort", "k.sleutel").agg(F.min("file_id").alias("file_id"))
        kept = small(stage(new.select("file_id"), "p2-accepted"))
        for name, df in (("classes", own.join(kept, "file_id", "left_semi")), ("postings", posts.join(kept, "file_id", "left_semi").sortWithinPartitions("sign")), ("keys", keys)):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self._path(f"{name}/batch-{k}"))
        return out

    def _groups(self, batch: DataFrame, own: DataFrame, posts: DataFrame, history_docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(gives, takes, settled): the groups (soort, groep) in which a row of the batch may be the repeated one, those in which it may repeat, and those that history has settled, with their earliest accepted row.

        A group is known by a row: the smallest of the batch with the key, or the accepted one of an older class.
        """
        known = self._read("keys", "soort string, sleutel string, file_id long", k)
        parts = []
        for kind, col, may in (("d", "digest", F.lit(True)), ("a", "adres", F.col("digest").isNull())):
            g = stage(batch.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("sleutel")).agg(F.min("file_id").alias("groep"), F.count("*").alias("m")), f"p2-{col}")
            old = known.where(F.col("soort") == kind).join(small(g.select("sleutel")), "sleutel", "left_semi").groupBy("sleutel").agg(F.min("file_id").alias("eerst"))
            live = stage(g.join(old, "sleutel", "left").where("m > 1 or eerst is not null"), f"p2-live-{col}")
            rows = batch.join(live, F.col(col) == F.col("sleutel")).select("file_id", F.lit(kind).alias("soort"), "groep", may.alias("neemt"))
            parts.append((rows, live.where("eerst is not null").select(F.lit(kind).alias("soort"), "groep", "eerst")))
        rows = stage(parts[0][0].unionByName(parts[1][0]), "p2-groups")

        fp = ["class1", "class2", "n"]
        old = self._read("classes", _MEMBER, k)
        cls = own.groupBy(*fp).agg(F.min("file_id").alias("klasse"), F.count("*").alias("m"))
        same = old.join(small(stage(cls.select(*fp), "p2-fingerprints")), fp, "left_semi").select(*fp, F.col("file_id").alias("eerst"))
        cls = stage(cls.join(same, fp, "left"), "p2-classes")
        reps = own.join(small(cls.select(F.col("klasse").alias("file_id"))), "file_id", "left_semi")
        mine = posts.join(small(cls.select(F.col("klasse").alias("file_id"))), "file_id", "left_semi")
        if k:
            every, new = self._read("postings", _POSTING, k).unionByName(mine), cls.select(F.col("klasse").alias("file_id"))
        else:  # in the first batch a sign that the order doesn't know stands in one text only
            every, new = stage(mine.where("bekend"), "p2-postings"), None
        pairs = stage(similar_pairs(history_docs, every, old.unionByName(reps), self.similar, new), "p2-similar")
        edges = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("klasse", "buur")
        live = cls.where("m > 1 or eerst is not null").select("klasse").union(edges.select("klasse")).distinct()
        t = stage(own.join(cls.drop("eerst", "m"), fp).select("file_id", "klasse").join(live, "klasse", "left_semi"), "p2-texts")
        as_t = t.select("file_id", F.lit("t").alias("soort"), F.col("klasse").alias("groep"))
        near = t.join(edges, "klasse").select("file_id", F.lit("t").alias("soort"), F.col("buur").alias("groep"))
        gives = rows.select("file_id", "soort", "groep").union(as_t)
        takes = rows.where("neemt").select("file_id", "soort", "groep").union(as_t).union(near)
        # an older class is a group of its accepted row alone
        before = edges.select(F.col("buur").alias("groep")).distinct().join(cls.select(F.col("klasse").alias("groep")), "groep", "left_anti").select(F.lit("t").alias("soort"), "groep", F.col("groep").alias("eerst"))
        settled = parts[0][1].union(parts[1][1]).union(cls.where("eerst is not null").select(F.lit("t").alias("soort"), F.col("klasse").alias("groep"), "eerst")).union(before)
        return stage(gives, "p2-gives"), stage(takes, "p2-takes"), stage(settled, "p2-settled")


def appended(files: DataFrame, docs: DataFrame, bounds: tuple[int, ...] = (), similar: tuple[int, int] = SIMILAR) -> list[DataFrame]:
    """What each batch gives that is appended to a new index: the rows of files up to each bound of file_id, then the rest."""
    index = SegmentIndex(files.sparkSession, stage_path(files.sparkSession, "p2-index"), similar)
    out, low = [], None
    for high in (*bounds, None):
        rows = files if low is None else files.where(F.col("file_id") > low)
        rows = rows if high is None else rows.where(F.col("file_id") <= high)
        out.append(index.append(rows, docs, docs))
        low = high
    return out


def repeats(files: DataFrame, docs: DataFrame, bounds: tuple[int, ...] = (), similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(file_id_1, file_id_2) over all rows of files (file_id, url, sha256), with the texts of docs (file_id, text), in batches that end at the bounds."""
    first, *more = appended(files, docs, bounds, similar)
    for m in more:
        first = first.unionByName(m)
    return first


def linked_classes(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(file_id, klasse, buren): the class of each text, known by the smallest id with the same string, and with how many other classes it agrees. Texts of fewer than five words have no class and are left out."""
    index = SegmentIndex(docs.sparkSession, stage_path(docs.sparkSession, "p2-links"), similar)
    d = one_text(docs)
    segments = blocks(d)
    posts = index._postings(segments, True)
    own = stage(segments.select("ids", "sizes", "class1", "class2", "sigs").mapInArrow(_members, _MEMBER), "p2-members")
    fp = ["class1", "class2", "n"]
    cls = stage(own.groupBy(*fp).agg(F.min("file_id").alias("klasse")), "p2-classes")
    ids = small(cls.select(F.col("klasse").alias("file_id")))
    pairs = stage(similar_pairs(d, stage(posts.where("bekend").join(ids, "file_id", "left_semi"), "p2-postings"), own.join(ids, "file_id", "left_semi"), similar), "p2-similar")
    links = pairs.select("a").union(pairs.select("b")).toDF("k2").groupBy("k2").agg(F.count("*").alias("m"))
    t = own.join(cls, fp).select("file_id", "klasse")
    return t.join(links, F.col("klasse") == F.col("k2"), "left").select("file_id", "klasse", F.coalesce("m", F.lit(0)).alias("buren"))
