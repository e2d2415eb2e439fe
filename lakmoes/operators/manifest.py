"""Findings, manifest and state: joins, deduplication, resuming, counts and the order of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakmoes.functions.scalars import first_filled, permit_type
from lakmoes.operators.detectors import RANK


def rank(ernst: Column) -> Column:
    """The place of a severity in the report; 9 for an unknown one."""
    out = F.lit(9)
    for k, v in RANK.items():
        out = F.when(ernst == k, F.lit(v)).otherwise(out)
    return out


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: of the rows with the same keys the one that came first. Combined before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)


def with_manifest(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Findings left-joined to herkomst and titel of their address; null where the manifest has no such row. manifest has one row per url; its columns replace those of the findings."""
    findings = findings.drop("herkomst", "titel", "_url")
    m = manifest.select(F.col("url").alias("_url"), "herkomst", "titel")
    return findings.join(m, F.col("url") == F.col("_url"), "left").drop("_url")


def content_duplicates(files: DataFrame, digest: Column, seq: str = "file_id", status: Column | None = None) -> DataFrame:
    """(seq, eerste): rows whose content was handled by an earlier row with status done. A copy of a row that failed is none.

    Only the first done row of each digest matters, found with a partial aggregate; the join is on the digest.
    """
    st = status if status is not None else F.col("status")
    f = files.select(F.col(seq), digest.alias("_d"), (st == "done").alias("_done")).where(F.col("_d").isNotNull())
    first = f.where("_done").groupBy("_d").agg(F.min(seq).alias("eerste"))
    return f.join(first, "_d").where(F.col(seq) > F.col("eerste")).select(seq, "eerste")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not among the seen ones; a null key was never seen."""
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def by_severity(findings: DataFrame) -> DataFrame:
    n = findings.groupBy("ernst").agg(F.count("*").alias("n"))
    return n.select("ernst", rank(F.col("ernst")).alias("rang"), "n")


def by_kind(findings: DataFrame, shown: tuple[str, ...] = ("Middel", "Laag")) -> DataFrame:
    """Per severity that the report only counts: the findings by kind, the most frequent first, then by name."""
    n = findings.where(F.col("ernst").isin(*shown)).groupBy("ernst", "soort").agg(F.count("*").alias("n"))
    return n.withColumn("volgorde", F.row_number().over(Window.partitionBy("ernst").orderBy(F.desc("n"), F.col("soort"))))


def report_rows(findings: DataFrame, manifest: DataFrame, width: int = 90) -> DataFrame:
    """All findings with the columns of the report; titles are cut for display, the kind of permit comes from the whole title. Null becomes empty."""
    j = with_manifest(findings, manifest)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return j.select(
        *[text(c).alias(c) for c in ("url", "local_path", "soort", "ernst", "waarde_masked", "locatie", "context", "opmerking")],
        text("herkomst").alias("gemeente"),
        F.left(text("titel"), F.lit(width)).alias("onderwerp"),
        permit_type(F.col("titel")).alias("vergunning"),
        rank(F.col("ernst")).alias("rang"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The order of the report, made total by the remaining columns."""
    return rows.orderBy("rang", "soort", "url", *[c for c in rows.columns if c not in ("rang", "soort", "url")])


def has_routing(rows: DataFrame) -> bool:
    """Whether any row has a source or a title, so that the report shows those columns."""
    return not rows.where(first_filled(F.col("gemeente"), F.col("onderwerp")).isNotNull()).limit(1).isEmpty()


def per_source(docs: DataFrame, findings: DataFrame, source: str, key: str) -> DataFrame:
    """(source, n_url, n_tekst, n_hit): documents with an address to fetch, documents with text, and findings, of each source."""
    d = docs.groupBy(source).agg(F.count_if(~F.col("_text")).alias("n_url"), F.count_if("_text").alias("n_tekst"))
    hits = findings.groupBy(source).agg(F.count("*").alias("n_hit"))
    return d.join(hits.withColumnRenamed(source, "_s"), d[source].eqNullSafe(F.col("_s")), "left").select(source, "n_url", "n_tekst", F.coalesce("n_hit", F.lit(0)).alias("n_hit"))


def split_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text, address, rejects): text documents, documents to fetch, and those with neither, which must not vanish unseen."""
    text = F.coalesce(F.col("text").isNotNull() | (F.size("chunks") > 0), F.lit(False))
    return docs.where(text), docs.where(~text & F.col("url").isNotNull()), docs.where(~text & F.col("url").isNull())


def capped(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """At most so many rows of each group, in a stated order: the limit per source that a configuration asks for."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def slices(creators: DataFrame, first: int, last: int) -> DataFrame:
    """(creator, jaar): the slices of a backfill, one per creator and year; a creator gives a handful of rows of its own, no join."""
    return creators.distinct().select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("jaar"))


STATES = ("todo", "busy", "done", "error", "skipped")


def marked(manifest: DataFrame, updates: DataFrame, keep: tuple[str, ...] = ("sha256", "local_path", "note")) -> DataFrame:
    """manifest (url, status, ...) with the updates (url, status and some of `keep`) laid over it: a status always, the rest only where it is told, the old value otherwise.

    Of several updates of an address the last by `nr` counts as a whole; updates of addresses that the manifest lacks change nothing.
    """
    have = [c for c in keep if c in updates.columns]
    u = updates.groupBy(F.col("url").alias("_url")).agg(F.max_by(F.struct("status", *have), F.col("nr")).alias("_u"))
    new = {"status": F.coalesce("_u.status", "status"), **{c: F.coalesce(f"_u.{c}", c) for c in have}}
    return manifest.join(u, F.col("url") == F.col("_url"), "left").withColumns(new).select(*manifest.columns)


def claimed(manifest: DataFrame, runner: int, runners: int, order: str, most: int | None = None) -> DataFrame:
    """The rows with status todo that fall to one of several runners, at most `most` in the stated order, with status busy.

    Addresses are dealt by hash, so no two runners take the same, without a lock; the claim counts once it is
    committed (`incremental`), and `requeued` gives back what a crash left.
    """
    mine = manifest.where((F.col("status") == "todo") & (F.pmod(F.xxhash64("url"), F.lit(runners)) == runner))
    mine = mine.orderBy(order).limit(most) if most is not None else mine
    return mine.withColumn("status", F.lit("busy"))


def requeued(manifest: DataFrame) -> DataFrame:
    """manifest with busy rows back at todo."""
    return manifest.withColumn("status", F.when(F.col("status") == "busy", F.lit("todo")).otherwise(F.col("status")))


def state_counts(manifest: DataFrame, status: str = "status") -> DataFrame:
    return manifest.groupBy(F.col(status).alias("toestand")).agg(F.count("*").alias("n"))


def migrated(old: DataFrame, columns: tuple[str, ...] = ("titel", "herkomst")) -> DataFrame:
    """A manifest of before some columns existed, with those as null."""
    return old.withColumns({c: F.lit(None).cast("string") for c in columns if c not in old.columns})


def shown(rows: DataFrame) -> DataFrame:
    """The report rows that are listed one by one, with the name of the file for its path."""
    return rows.where(~F.col("ernst").isin("Middel", "Laag")).withColumn("local_path", F.substring_index("local_path", "/", -1))
