"""Only new or changed records: a high watermark over a monotonic commit sequence.

A table of arrivals has a sequence column that rises with arrival. `open_run` notes the last commit and fixes
the upper bound of a run once, at its start; the run sees the rows in (low, high] and nothing later.
`IncrementalRun.commit` writes its tables into a folder of its own and then puts one small marker, which names
the folder and holds the watermark, under the number that follows the commit it was opened on. The marker is
put only if no other has that number, so of two runs opened on the same commit one is refused, a watermark never
falls, and output and watermark count together or not at all: what a crash leaves behind is a folder that
nobody reads, and the next run covers the same rows under the same lower bound. The marker needs a file system
whose rename refuses an existing target (HDFS and the like, or local disks by hard link); a bare object store
has none.

What still needs work is decided on a state by address (files) or document key (text documents). A commit adds
the state of its own rows, reduced to one row per key; a run reads of the older state only the keys that its
rows touch, or that marks of runs touch whose outcome has changed since, and takes over the rest of the work
list of the commit before. So a row below the watermark whose run did not end well comes out again.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakmoes.functions.urls import normal_digest, normal_key, normal_status, normal_url
from lakmoes.plans.stage import small, stage

STATE = {
    "files_state": "adres string, digest string, klaar int, gezien_op timestamp, file_id long, status string",
    "files_open": "adres string, file_id long, digest string",
    "docs_state": "bron string, sleutel string, gewijzigd_op timestamp, rij_id long, opgehaald_op timestamp",
    "docs_open": "bron string, sleutel string, rij_id long",
    "goed": "good_run int",
}


class Overtaken(RuntimeError):
    """Another run has committed since this one was opened; it is void and nothing of it counts."""


def upper_bound(table: DataFrame, seq: str) -> int:
    """The highest sequence number of the table now; -1 if it has none. One row reaches the driver."""
    top = table.agg(F.max(seq)).first()[0]
    return -1 if top is None else int(top)


@dataclass
class IncrementalRun:
    """One run over (low, high] of each table, opened on commit number `base` (-1 before the first) of `root`."""

    spark: SparkSession
    root: str
    base: int
    low: dict[str, int]
    high: dict[str, int]
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def arrived(self, name: str, table: DataFrame, seq: str) -> DataFrame:
        """The rows that arrived since the last committed run, up to the bound of this one."""
        return table.where((F.col(seq) > self.low[name]) & (F.col(seq) <= self.high[name]))

    def committed(self, name: str, schema: str, last: bool = False) -> DataFrame:
        """What all commits up to `base` hold under a name, or only the last one."""
        return committed(self.spark, self.root, name, schema, self.base, last)

    def write(self, outputs: dict[str, DataFrame]) -> str:
        """Write the outputs into the folder of this run, where nobody reads them yet."""
        folder = f"{self.root}/data-{self.run_id}"
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return folder

    def commit(self, outputs: dict[str, DataFrame]) -> str:
        """Write the outputs, then make them and the new watermark visible by one marker; Overtaken if its number is taken."""
        folder = self.write(outputs)
        marker = {"high": self.high, "run_id": self.run_id, "folder": f"data-{self.run_id}", "tables": sorted(outputs)}
        _put_if_absent(self.spark, self.root, f"commit-{self.base + 1:08d}.json", json.dumps(marker))
        return folder


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _put_if_absent(spark: SparkSession, root: str, name: str, text: str) -> None:
    """A file with its whole content under a name that nobody has taken yet; Overtaken if somebody has."""
    fs, path = _fs(spark, root)
    tmp, final = f"{root}/_tmp-{uuid.uuid4().hex}", f"{root}/{name}"
    out = fs.create(path(tmp), True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(urlsplit(tmp).path, urlsplit(final).path)
            except FileExistsError:
                raise
            except OSError:  # a mount without hard links: the name is still taken by one run only
                at = os.open(urlsplit(final).path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
                os.write(at, text.encode())
                os.close(at)
        else:
            jvm = spark.sparkContext._jvm
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(kind, 1)
            how[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path(tmp), path(final), how)
    except Exception as e:
        if fs.exists(path(final)):
            raise Overtaken(f"another run has committed {final}; this one is void") from e
        raise
    finally:
        if fs.exists(path(tmp)):
            fs.delete(path(tmp), False)


def commits(spark: SparkSession, root: str) -> list[dict]:
    """The markers of the committed runs, in order."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    names = sorted(n for s in fs.listStatus(path(root)) if (n := s.getPath().getName()).startswith("commit-"))
    if not names:
        return []
    texts = {r["n"]: r["value"] for r in spark.read.text([f"{root}/{n}" for n in names], wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("n"), "value").collect()}
    return [json.loads(texts[n]) for n in names]


def committed(spark: SparkSession, root: str, name: str, schema: str, upto: int | None = None, last: bool = False) -> DataFrame:
    """What the commits hold under a name: of all up to number `upto`, or only of the last that has it."""
    done = commits(spark, root)
    paths = [f"{root}/{c['folder']}/{name}" for c in (done if upto is None else done[: upto + 1]) if name in c["tables"]]
    paths = paths[-1:] if last else paths
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def watermark(spark: SparkSession, root: str) -> dict[str, int]:
    """The bounds of the last committed run; empty before the first."""
    done = commits(spark, root)
    return done[-1]["high"] if done else {}


def open_run(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, str]], most: dict[str, int] | None = None) -> IncrementalRun:
    """Start a run: note the last commit and fix the upper bound of each table (name -> table, sequence column).

    most: bounds that a run is not to go beyond, where it takes less than what has arrived. A bound is never below the watermark.
    """
    done = commits(spark, root)
    low = done[-1]["high"] if done else {}
    high = dict(low)
    for k, (t, s) in tables.items():
        top = upper_bound(t, s)
        high[k] = max(min(top, (most or {}).get(k, top)), low.get(k, -1))
    return IncrementalRun(spark, root, len(done) - 1, {k: low.get(k, -1) for k in high}, high)


def good_runs(runs: DataFrame) -> DataFrame:
    """The ids of the runs that ended well."""
    return runs.where(F.lower(F.trim("uitkomst")) == "ok").select(F.col("run_id").cast("int").alias("good_run")).where(F.col("good_run").isNotNull()).distinct()


def files_state(files: DataFrame) -> DataFrame:
    """The rows of files reduced to what later runs need: per address, digest and run that did it, the latest row.

    Rows without url share no address and are each their own. A null status means todo; a null gezien_op counts
    as the earliest. One shuffle, with a partial aggregate before it, so a hot address costs a few rows per task.
    """
    digest, status = normal_digest(F.col("sha256")), normal_status(F.col("status"))
    f = files.select(
        F.coalesce(normal_url(F.col("url")), F.concat(F.lit("\0"), F.col("file_id"))).alias("adres"), digest.alias("digest"),
        F.when((status == "done") & digest.isNotNull(), F.col("run_id").cast("int")).alias("klaar"), F.col("gezien_op").cast("timestamp").alias("gezien_op"), F.col("file_id").cast("bigint").alias("file_id"), status.alias("status"),
    )
    return _reduced(f)


def _reduced(state: DataFrame) -> DataFrame:
    return state.groupBy("adres", "digest", "klaar").agg(F.max(F.struct("gezien_op", "file_id", "status")).alias("m")).select("adres", "digest", "klaar", "m.*")


def files_open(state: DataFrame, good: DataFrame) -> DataFrame:
    """(adres, file_id, digest): per address of the state the current row, if it still has to be handled.

    The current row has the latest gezien_op, then the highest file_id; it is left out if its status is
    skipped, or if it has a digest that some row of the same address has with status done and a good run.
    """
    s = state.join(small(good), F.col("klaar") == F.col("good_run"), "left")
    per_digest = s.groupBy("adres", "digest").agg(F.max(F.col("good_run").isNotNull()).alias("handled"), F.max(F.struct("gezien_op", "file_id", "status")).alias("last"))
    now = per_digest.groupBy("adres").agg(F.max_by(F.struct("last.file_id", "digest", "last.status", "handled"), F.struct("last.gezien_op", "last.file_id")).alias("last"))
    return now.where((F.col("last.status") != "skipped") & ~F.col("last.handled")).select("adres", "last.file_id", "last.digest")


def docs_state(docs: DataFrame) -> DataFrame:
    """Per (bron, doc_id) of docs the current row: the latest gewijzigd_op, then the lowest rij_id.

    Blanks and letter case of doc_id are set aside. A null bron is a bron of its own; rows with a null doc_id are each their own.
    """
    d = docs.select(
        "bron", F.coalesce(normal_key(F.col("doc_id")), F.concat(F.lit("\0"), F.col("rij_id"))).alias("sleutel"),
        F.col("gewijzigd_op").cast("timestamp").alias("gewijzigd_op"), F.col("rij_id").cast("bigint").alias("rij_id"), F.col("opgehaald_op").cast("timestamp").alias("opgehaald_op"),
    )
    return _current(d)


def _current(d: DataFrame) -> DataFrame:
    m = d.groupBy("bron", "sleutel").agg(F.max_by(F.struct("gewijzigd_op", "rij_id", "opgehaald_op"), F.struct(F.col("gewijzigd_op"), -F.col("rij_id"))).alias("m"))
    return m.select("bron", "sleutel", "m.*")


def docs_open(current: DataFrame, marks: DataFrame, good: DataFrame) -> DataFrame:
    """(bron, sleutel, rij_id): the current rows that no good run has taken up since they arrived.

    A mark counts if its run ended well and its gedaan_op is not before the row's opgehaald_op; a row or mark
    with a null time is never covered. Marks have no sequence of their own and are read whole.
    """
    m = marks.join(small(good), F.col("run_id") == F.col("good_run"), "left_semi")
    m = m.groupBy(F.col("bron").alias("m_bron"), normal_key(F.col("doc_id")).alias("m_sleutel")).agg(F.max("gedaan_op").alias("gedaan"))
    both = current.join(m, F.col("bron").eqNullSafe(F.col("m_bron")) & (F.col("sleutel") == F.col("m_sleutel")), "left")
    return both.where(~F.coalesce(F.col("gedaan") >= F.col("opgehaald_op"), F.lit(False))).select("bron", "sleutel", "rij_id")


def pending_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(adres, file_id, digest): the work list of a log without history."""
    return files_open(files_state(files), good_runs(runs))


def pending_documents(docs: DataFrame, marks: DataFrame, runs: DataFrame) -> DataFrame:
    """(bron, sleutel, rij_id): the work list of documents without history."""
    return docs_open(docs_state(docs), marks, good_runs(runs))


def next_run(spark: SparkSession, root: str, files: DataFrame, docs: DataFrame, marks: DataFrame, runs: DataFrame, most: dict[str, int] | None = None) -> tuple[IncrementalRun, dict[str, DataFrame]]:
    """Open a run under `root`; gives it with the tables to commit. `werk` (tabel, id) holds the records it has to handle, up to its fixed bounds."""
    run = open_run(spark, root, {"files": (files, "file_id"), "bron_document": (docs, "rij_id")}, most)
    good = stage(good_runs(runs), "p5-good")
    f_new = stage(files_state(run.arrived("files", files, "file_id")), "p5-files")
    d_new = stage(docs_state(run.arrived("bron_document", docs, "rij_id")), "p5-docs")
    if run.base < 0:
        f_open, d_open = files_open(f_new, good), docs_open(d_new, marks, good)
    else:
        before = run.committed("goed", STATE["goed"], last=True)
        changed = small(stage(before.exceptAll(good).union(good.exceptAll(before)), "p5-changed"))
        f_old, f_list = run.committed("files_state", STATE["files_state"]), run.committed("files_open", STATE["files_open"], last=True)
        touched = small(stage(f_new.select("adres").union(f_old.join(changed, F.col("klaar") == F.col("good_run"), "left_semi").select("adres")).distinct(), "p5-touched"))
        f_open = files_open(_reduced(f_old.join(touched, "adres", "left_semi").unionByName(f_new)), good).unionByName(f_list.join(touched, "adres", "left_anti"))
        d_old, d_list = run.committed("docs_state", STATE["docs_state"]), run.committed("docs_open", STATE["docs_open"], last=True)
        keys = lambda d: d.select(F.coalesce("bron", F.lit("\0")).alias("b"), F.col("sleutel").alias("s"))
        again = marks.join(changed, F.col("run_id") == F.col("good_run"), "left_semi").select(F.coalesce("bron", F.lit("\0")).alias("b"), normal_key(F.col("doc_id")).alias("s"))
        asked = small(stage(keys(d_new).union(keys(d_list)).union(again).distinct(), "p5-asked"))
        on = (F.coalesce("bron", F.lit("\0")) == F.col("b")) & (F.col("sleutel") == F.col("s"))
        d_open = docs_open(_current(d_old.join(asked, on, "left_semi").unionByName(d_new)), marks, good)
    f_open, d_open = stage(f_open, "p5-files-open"), stage(d_open, "p5-docs-open")
    work = f_open.select(F.lit("files").alias("tabel"), F.col("file_id").alias("id")).unionByName(d_open.select(F.lit("bron_document").alias("tabel"), F.col("rij_id").alias("id")))
    return run, {"files_state": f_new, "files_open": f_open, "docs_state": d_new, "docs_open": d_open, "goed": good, "werk": work}
