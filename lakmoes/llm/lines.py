"""Lines that one site repeats over its documents: distributed PrefixSpan over line identifiers.

A document is the sequence of its lines, a line is known by the hash of its letters. Per source the miner
counts the frequent single lines, keeps of each document only those, and grows frequent sequences from each by
what follows in its projected database: the next repeated lines after an occurrence, other lines and up to
`gap` repeated ones between them. Lines that stand in the very same documents, one after the other in each of
them, are one step of a sequence, however many they are: a notice of a thousand lines is grown in one round,
and only its closed form is kept. Every line of every occurrence of a frequent sequence, single lines
included, is a repeated line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakmoes.plans.stage import small, spread, stage

MIN_LETTERS, MIN_ROWS, MIN_SHARE = 15, 3, 0.15
#: Steps of a sequence, and repeated lines that may be skipped between two of them. Neither changes which lines are repeated.
MAX_LENGTH, GAP = 4, 8


def line_key(line: Column) -> Column:
    """The letters of a line in lower case."""
    return F.lower(F.regexp_replace(line, r"\P{L}+", ""))


def line_sequences(docs: DataFrame, tabel: str, id_col: str, source_col: str, text_col: str = "text", min_letters: int = MIN_LETTERS) -> DataFrame:
    """(tabel, source, id, n_lines, seq array<struct<nr, h>>): the lines with enough letters, in order. Null texts are left out; a null source is a source of its own."""
    lines = F.split(F.col(text_col), "\n", -1)
    keys = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("nr"), line_key(x).alias("k")))
    seq = F.transform(F.filter(keys, lambda s: F.length(s.k) >= min_letters), lambda s: F.struct(s.nr.alias("nr"), F.xxhash64(s.k).alias("h")))
    return spread(docs.where(F.col(text_col).isNotNull()), id_col).select(
        F.lit(tabel).alias("tabel"), F.col(source_col).alias("source"), F.col(id_col).cast("bigint").alias("id"), seq.alias("seq")
    )


def source_sizes(seqs: DataFrame, min_rows: int, min_share: float) -> DataFrame:
    """(tabel, source, least): the number of rows in which a sequence has to stand, per source."""
    n = seqs.groupBy("tabel", "source").agg(F.count("*").alias("n"))
    return n.select("tabel", "source", F.greatest(F.lit(min_rows), F.ceil(F.col("n") * F.lit(min_share).cast("decimal(9,6)"))).cast("bigint").alias("least"))


def _of(a: str, b: str) -> Column:
    return (F.col(f"{a}.tabel") == F.col(f"{b}.tabel")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _frequent(hits: DataFrame, sizes: DataFrame, *more: Column) -> DataFrame:
    """Of (tabel, source, p, ...), one row per document and pattern, the patterns with enough documents."""
    counts = hits.groupBy("tabel", "source", "p").agg(F.count("*").alias("support"), *more)
    return counts.alias("c").join(small(sizes).alias("z"), _of("c", "z")).where("support >= least").select("c.*")


def steps(seqs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tabel, source, id, at, p, nrs): the frequent lines of each document as steps of sequences, in order.

    Lines with the same documents that follow each other the same way in all of them are one step; nrs has
    their numbers. A hot line has a row per document here and is never gathered; the join with the frequent
    lines is a broadcast only below a counted size.
    """
    line = seqs.select("tabel", "source", "id", F.explode("seq").alias("s")).select("tabel", "source", "id", F.col("s.nr").alias("nr"), F.col("s.h").alias("p"))
    one = seqs.select("tabel", "source", "id", F.explode(F.array_distinct(F.col("seq.h"))).alias("p"))
    # which documents a line stands in, as two sums that do not depend on their order
    level = stage(_frequent(one, sizes, F.bit_xor(F.xxhash64("id")).alias("f1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("f2")), "p1-lines")
    own = Window.partitionBy("tabel", "source", "id").orderBy("nr")
    hits = line.alias("l").join(small(level).alias("v"), _of("l", "v") & (F.col("l.p") == F.col("v.p"))).select("l.*", "v.support", "v.f1", "v.f2")
    new = F.coalesce((F.lag("f1").over(own) != F.col("f1")) | (F.lag("f2").over(own) != F.col("f2")), F.lit(True))
    runs = hits.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(own))
    runs = runs.groupBy("tabel", "source", "id", "run").agg(F.array_sort(F.collect_list(F.struct("nr", "p"))).alias("ls"), F.first("support").alias("support"))
    runs = stage(runs.withColumn("p", F.xxhash64(F.col("ls.p"))), "p1-runs")
    whole = runs.select("tabel", "source", "id", "p", "support").distinct().groupBy("tabel", "source", "p").agg(F.count("*").alias("n"), F.first("support").alias("support"))
    whole = stage(whole.where("n = support").select("tabel", "source", "p"), "p1-whole")
    marked = runs.alias("r").join(small(whole).alias("w"), _of("r", "w") & (F.col("r.p") == F.col("w.p")), "left").select("r.*", F.col("w.p").isNotNull().alias("as_one"))
    alone = F.transform("ls", lambda s: F.named_struct(F.lit("at"), s["nr"], F.lit("p"), F.xxhash64(F.array(s["p"])), F.lit("nrs"), F.array(s["nr"])))
    together = F.array(F.named_struct(F.lit("at"), F.col("ls.nr")[0], F.lit("p"), F.col("p"), F.lit("nrs"), F.col("ls.nr")))
    return marked.select("tabel", "source", "id", F.explode(F.when(F.col("as_one"), together).otherwise(alone)).alias("t")).select("tabel", "source", "id", "t.*")


def prefixspan(seqs: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, max_length: int = MAX_LENGTH, gap: int = GAP) -> tuple[DataFrame, DataFrame]:
    """(patterns, occurrences) of the frequent sequences, per source; seqs (tabel, source, id, seq), staged.

    patterns (tabel, source, p, stappen, length, support) has those that no frequent sequence with the same
    support goes on; stappen counts steps, length lines. occurrences (tabel, id, nrs, length) has of each
    document each occurrence of each frequent sequence, by its line numbers. A round for each step up to
    max_length; an open occurrence carries only as many steps as later rounds can reach.
    """
    sizes = stage(source_sizes(seqs, min_rows, min_share), "p1-sizes")
    step = stage(steps(seqs, sizes), "p1-steps")
    keys = ("tabel", "source", "id")
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(1, (gap + 1) * (max_length - 1))
    open_ = step.select(*keys, "p", "nrs", F.collect_list(F.struct("p", "nrs")).over(order).alias("tail")) if max_length > 1 else step
    level = _frequent(step.select(*keys, "p").distinct(), sizes).withColumn("voor", F.lit(None).cast("bigint"))
    size = F.size("nrs")
    level = stage(level.join(step.groupBy(F.col("tabel").alias("t2"), F.col("p").alias("p2")).agg(F.min(size).alias("length")), (F.col("tabel") == F.col("t2")) & (F.col("p") == F.col("p2"))).drop("t2", "p2"), "p1-level-1")
    levels, found = [level], step.select("tabel", "id", "nrs", size.alias("length"))
    for k in range(2, max_length + 1):
        near = F.slice("tail", F.lit(1), F.lit(gap + 1))
        grown = open_.select(*keys, F.col("p").alias("voor"), "nrs", "tail", F.posexplode(near).alias("j", "t"))
        rest = F.slice("tail", F.col("j") + 2, F.lit((gap + 1) * (max_length - k))) if k < max_length else F.array().cast("array<struct<p:bigint,nrs:array<int>>>")
        grown = stage(grown.select(*keys, "voor", F.xxhash64("voor", F.col("t.p")).alias("p"), F.concat("nrs", "t.nrs").alias("nrs"), rest.alias("tail")), f"p1-grown-{k}")
        docs = grown.groupBy(*keys, "p").agg(F.min("voor").alias("voor"), F.min(size).alias("length"))
        level = stage(_frequent(docs, sizes, F.min("voor").alias("voor"), F.min("length").alias("length")), f"p1-level-{k}")
        if level.isEmpty():
            break
        levels.append(level)
        known = small(level.select("tabel", "source", "p")).alias("v")
        open_ = grown.alias("g").join(known, _of("g", "v") & (F.col("g.p") == F.col("v.p")), "left_semi")
        found = found.unionByName(open_.select("tabel", "id", "nrs", size.alias("length")))
    out = None
    for k, level in enumerate(levels):
        closed = level
        if k + 1 < len(levels):
            longer = levels[k + 1].select("tabel", "source", F.col("voor").alias("p"), "support").distinct().alias("v")
            closed = level.alias("g").join(longer, _of("g", "v") & (F.col("g.p") == F.col("v.p")) & (F.col("g.support") == F.col("v.support")), "left_anti")
        closed = closed.select("tabel", "source", "p", F.lit(k + 1).alias("stappen"), "length", "support")
        out = closed if out is None else out.unionByName(closed)
    return out, found


def repeated_lines(seqs: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(tabel, id, regel_nr, blok): each line of each occurrence of a frequent sequence, with the number of lines of the longest one it belongs to."""
    _, found = prefixspan(stage(seqs, "p1-seqs"), min_rows, min_share)
    return found.select("tabel", "id", F.explode("nrs").alias("regel_nr"), "length").groupBy("tabel", "id", "regel_nr").agg(F.max("length").alias("blok"))


def remove_lines(docs: DataFrame, found: DataFrame, id_col: str, text_col: str = "text", tabel: Column | None = None) -> DataFrame:
    """docs with `schoon`, the text without its repeated lines and otherwise as it was, and `n_weg`, how many went. A null text stays null.

    tabel says for each row of docs which table of found it belongs to; without it, all are of 'documents'.
    """
    gone = found.groupBy(F.col("tabel").alias("_in"), F.col("id").alias("_id")).agg(F.collect_set("regel_nr").alias("_gone"))
    d = docs.drop("_id", "_gone", "_in", "_tabel").withColumn("_tabel", F.lit("documents") if tabel is None else tabel)
    d = d.join(gone, (F.col(id_col) == F.col("_id")) & (F.col("_tabel") == F.col("_in")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("_gone", i.cast("int")), F.lit(False)))
    return d.withColumn("schoon", F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).withColumn("n_weg", F.coalesce(F.size("_gone"), F.lit(0))).drop("_id", "_gone", "_in", "_tabel")
