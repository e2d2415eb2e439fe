"""Command line: scan the configured sources, search announcements, fill in history by year, show what a meeting service has, or only write the report."""

from __future__ import annotations

import argparse
import sys
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakmoes.config import Config
from lakmoes.operators import detectors, incremental, manifest
from lakmoes.plans.ship import ship
from lakmoes.plans.stage import stage
from lakmoes.sources import fetch, files, live, records, registry, sinks

FOUND = "bron string, doc_id string, url string, titel string, chunk_idx int, locatie string, detector int, start int, soort string, ernst string, context string, opmerking string, waarde_masked string, local_path string"
DONE = "bron string, doc_id string"
LEFT = "bron string, url string, titel string, reden string"
STATUS = "naam string, type string, gelezen boolean, reden string"


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakmoes", description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--report-only", action="store_true", help="write the report of what earlier runs found")
    p.add_argument("--max-pages", type=int, help="pages of a crawl, in place of the configured limit")
    p.add_argument("--sru", action="store_true", help="search announcements in place of the configured sources")
    p.add_argument("--sru-creators", help="creators, divided by commas; the configured ones otherwise")
    p.add_argument("--sru-max", type=int, default=150, help="records of each creator")
    p.add_argument("--sru-since", help="changed since this day")
    p.add_argument("--sru-until", help="changed until this day")
    p.add_argument("--van", type=int, help="search year by year, from this one")
    p.add_argument("--tot", type=int, help="to this year")
    p.add_argument("--diagnose", help="count the meetings of a site by type, by the service of the configured ibabs source")
    return p


def chosen_sources(conf: Config, a: argparse.Namespace) -> list[dict]:
    """The sources of a run: the configured ones, or a search by the flags."""
    if a.max_pages is not None:
        conf.max_pages = a.max_pages
    if not a.sru and a.van is None:
        return registry.configured(conf)
    creators = [c.strip() for c in a.sru_creators.split(",") if c.strip()] if a.sru_creators else conf.gemeenten
    if not creators:
        raise SystemExit("no creators: name gemeenten in the configuration, or use --sru-creators")
    if a.van is not None and (a.tot is None or a.tot < a.van):
        raise SystemExit("--van needs a --tot that is not before it")
    base = next((b for b in conf.bronnen if b.get("type") == "sru"), {})
    jaren = {"jaren": list(range(a.van, a.tot + 1))} if a.van is not None else {"since": a.sru_since, "until": a.sru_until}
    return [{**base, "type": "sru", "naam": base.get("naam", "sru"), "creators": creators, "max": a.sru_max, **jaren}]


def fetched(address: DataFrame, conf: Config) -> tuple[DataFrame, DataFrame]:
    """(documents, rest) of address-only documents: those that could be fetched and read, and the others with their reason.

    Addresses of one host are asked by one task, at the configured pace; equal contents are read once, under the smallest address.
    """
    rows = address.select("bron", "url", "titel").groupBy("url").agg(F.min("bron").alias("bron"), F.min("titel").alias("titel"))
    got = stage(fetch.contents(rows.orderBy("url").limit(conf.max_files).select("url"), {"opener": conf.opener, "delay_seconds": str(conf.delay_seconds), **conf.opener_options}, conf.max_mb), "fetched")
    read = files.decode(got.where("fout is null").select(F.col("url").alias("path"), "ext", "sha256", "content")).select(F.col("path").alias("url"), "ext", F.col("sha256").alias("doc_id"), "status", "chunks", "meta")
    told = got.select(F.col("url").alias("_u"), "fout")
    j = stage(rows.join(read, "url", "left").join(told, F.col("url") == F.col("_u"), "left").drop("_u"), "read")
    some = F.coalesce(F.size("chunks") > 0, F.lit(False))
    docs = j.where(some).withColumn("text", F.lit(None).cast("string"))
    why = F.coalesce("fout", F.col("meta")["_fout"], F.when(F.col("status").isNotNull(), F.concat(F.lit("read as "), "status")), F.lit("same content as another address, or beyond max_files"))
    return registry.fitted(docs), j.where(~some).select("bron", "url", "titel", why.alias("reden"))


def diagnose(spark: SparkSession, conf: Config, site: str) -> int:
    """Print the meetings of each type that a service shows, the most first."""
    source = next((b for b in conf.bronnen if b.get("type") == "ibabs" and b.get("service")), None)
    if source is None:
        raise SystemExit("no ibabs source with a service in the configuration")
    module, _, name = source["service"].partition(":")
    service = getattr(import_module(module), name)(source)
    types = spark.createDataFrame([(t.get("Id"), t.get("Meetingtype")) for t in live.items_of(service("GetMeetingtypes", Sitename=site).get("Meetingtypes"))], "Id string, Meetingtype string")
    rows = spark.createDataFrame([(m["MeetingtypeId"],) for m in live.meetings(service, site)], "MeetingtypeId string")
    for r in records.meetings_per_type(rows, types).orderBy(F.desc("n"), "MeetingtypeId").collect():
        print(f"{r['n']:>8}  {r['Meetingtype'] or r['MeetingtypeId']}")
    return 0


def run(spark: SparkSession, conf: Config, sources: list[dict], log: str) -> None:
    """One run: read, scan, and commit findings, marks, what has no text, and the status of the sources as one."""
    this = incremental.open_run(spark, log, {})
    docs, status = registry.read_sources(spark, sources)
    text, address, rejects = manifest.split_documents(docs)
    reason = F.coalesce(F.col("meta")["_fout"], F.lit(""))
    rest = rejects.select("bron", "url", "titel", reason.alias("reden"))
    books = address.unionByName(rejects).where(F.length(F.col("meta")["_verborgen_tabbladen"]) > 0)
    if conf.opener:
        landed, missed = fetched(address.where(reason == ""), conf)
        text = text.unionByName(landed)
        rest = rest.unionByName(missed).unionByName(address.where(reason != "").select("bron", "url", "titel", reason.alias("reden")))
    else:
        rest = rest.unionByName(address.select("bron", "url", "titel", reason.alias("reden")))
    # a workbook whose sheets hold nothing still has a finding if some are hidden
    text = stage(manifest.unseen(text.unionByName(books), this.committed("gedaan", DONE), ["bron", "doc_id"]), "to-scan")
    keys = ["bron", "doc_id", "url", "titel"]
    found = detectors.scan_documents(text, keys, conf.eigen_domeinen, conf.detectors)
    found = found.unionByName(detectors.hidden_sheets(text, keys), allowMissingColumns=True).withColumn("local_path", F.lit(None).cast("string"))
    sinks.refuse_raw(found)
    this.commit({"bevindingen": found, "gedaan": text.select("bron", "doc_id").distinct(), "zonder_tekst": rest, "bronnen": status})


def summary(spark: SparkSession, log: str) -> list[str]:
    """A line for each source: what it read, and how many documents and findings it has in all runs."""
    done = incremental.committed(spark, log, "gedaan", DONE).groupBy("bron").agg(F.count("*").alias("d"))
    hits = incremental.committed(spark, log, "bevindingen", FOUND).groupBy(F.col("bron").alias("b")).agg(F.count("*").alias("n"))
    rows = {r["bron"]: (r["d"], r["n"] or 0) for r in done.join(hits, F.col("bron") == F.col("b"), "left").collect()}
    told = incremental.committed(spark, log, "bronnen", STATUS, last=True).collect()
    return [f"{r['naam']}: {'read' if r['gelezen'] else 'NOT READ, ' + r['reden']}; {rows.get(r['naam'], (0, 0))[0]} documents, {rows.get(r['naam'], (0, 0))[1]} findings" for r in told]


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    conf = Config.load(a.config)
    spark = SparkSession.builder.appName("lakmoes").getOrCreate()
    ship(spark)
    if a.diagnose:
        return diagnose(spark, conf, a.diagnose)
    log = f"{conf.output_dir}/log"
    if not a.report_only:
        try:
            run(spark, conf, chosen_sources(conf, a), log)
        except incremental.Overtaken as e:
            print(e, file=sys.stderr)
            return 2
    found = incremental.committed(spark, log, "bevindingen", FOUND)
    pages = found.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("bron").alias("herkomst"), F.min("titel").alias("titel"))
    rows = manifest.report_rows(found.drop("titel"), pages)
    n = incremental.committed(spark, log, "gedaan", DONE).count()
    sinks.write_html(rows, f"{conf.output_dir}/rapport.html", n, 0)
    for line in summary(spark, log):
        print(line)
    print(f"{sinks.write_excel(rows, f'{conf.output_dir}/rapport.xlsx')} findings in {conf.output_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
