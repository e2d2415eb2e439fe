"""Sources by type, each read as documents, and a status for each that tells empty from not read.

A source is a Spark Python data source over landed responses: `spark.read.format("lakmoes_council")`. A
source that can't run raises `SourceNotReady`; `read_sources` records that and goes on with the others.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable, Iterator
from functools import reduce
from importlib import import_module
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from lakmoes.config import Config
from lakmoes.operators import crawl
from lakmoes.plans.stage import stage
from lakmoes.sources import files, live, records

DOCUMENT = "bron string, doc_id string, url string, ext string, titel string, text string, chunks array<struct<idx:int,loc:string,text:string>>, meta map<string,string>"

MEETING = (
    f"Id string, MeetingtypeId string, MeetingDate string, Documents {records.DOC}, "
    f"MeetingItems array<struct<Features:string,Documents:{records.DOC}>>, ListItems array<struct<Documents:{records.DOC}>>"
)


class SourceNotReady(Exception):
    """The source could not be read; its emptiness says nothing."""


class LandedSource(DataSource):
    """Landed text responses: one row per file (slice, path, body), one partition per slice, a subfolder of `path`.

    An equality filter on the slice is honoured exactly, by leaving out the other partitions; all other filters are given back to Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "lakmoes_landed"

    def schema(self) -> str:
        return "slice string, path string, body string"

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.only = options.get("path") or "", None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("slice",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise SourceNotReady(f"no landed responses at {self.root!r}")
        names = sorted(d for d in os.listdir(self.root) if os.path.isdir(os.path.join(self.root, d)))
        return [InputPartition(n) for n in names if self.only is None or n == self.only] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str]]:
        if partition.value is None:
            return
        for p in sorted(glob.glob(os.path.join(self.root, partition.value, "*"))):
            with open(p, encoding="utf-8", errors="replace") as f:
                yield partition.value, p, f.read()


def _fit(df: DataFrame, bron: str) -> DataFrame:
    """df with exactly the columns of a document."""
    have = set(df.columns)
    kinds = dict(c.strip().split(" ", 1) for c in ("bron string", "doc_id string", "url string", "ext string", "titel string", "text string", "chunks array<struct<idx:int,loc:string,text:string>>", "meta map<string,string>"))
    return df.select(*[F.lit(bron).alias(c) if c == "bron" else (F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def fitted(df: DataFrame) -> DataFrame:
    """df with exactly the columns of a document; it has a source of its own for each row."""
    return df.select(*_fit(df, "").columns)


def _announcements(spark: SparkSession, conf: dict) -> DataFrame:
    a = records.announcements(records.read_announcements(spark, conf["path"]))
    pages = a.where(F.col("pdf_url").isNotNull()).select(F.col("pdf_url").alias("url"), "titel", F.lit("pdf").alias("ext"))
    return pages.unionByName(records.attachments(a).select("url", "titel", F.lit("pdf").alias("ext")))


def _council(spark: SparkSession, conf: dict) -> DataFrame:
    raw = spark.read.text(conf["path"]).select(F.col("value").alias("json"), F.sha2("value", 256).alias("es_id"))
    return records.council_documents(raw, conf.get("naam", "council"), conf.get("gemeente", ""))


def _told(found: DataFrame) -> DataFrame:
    """The rows of a service; a slice that failed makes the source one that was not read whole."""
    found = stage(found, "live")
    bad = live.failed_slices(found).limit(5).collect()
    if bad:
        raise SourceNotReady("; ".join(f"{r['slice']}: {r['fout']}" for r in bad))
    return found


def _options(conf: dict, *names: str) -> dict[str, str]:
    return {k: str(conf[k]) for k in ("endpoint", "opener", "folder", "delay_seconds", "page_size", "max", "timeout", *names) if conf.get(k) is not None}


def _search(spark: SparkSession, conf: dict) -> DataFrame:
    """Announcements: landed responses at path, or a search at endpoint for each of creators. With `jaren` year by year, where a year that fails is listed and leaves the others."""
    if conf.get("path"):
        return _announcements(spark, conf)
    if not conf.get("creators"):
        raise SourceNotReady("a search needs creators")
    if conf.get("jaren"):
        slices = [(c, f"{j}-01-01", f"{j}-12-31") for j in conf["jaren"] for c in conf["creators"]]
        found = stage(live.read(spark, "search", slices, **_options(conf, "attachments")), "years")
        conf["_mislukt"] = [(f"{r['slice']}", r["fout"]) for r in live.failed_slices(found).collect()]
        return found.where("fout is null").select("url", "ext", "titel").distinct()
    return _told(live.announcements(spark, conf["creators"], conf.get("since"), conf.get("until"), **_options(conf, "attachments"))).select("url", "ext", "titel").distinct()


def _council_live(spark: SparkSession, conf: dict) -> DataFrame:
    if conf.get("path"):
        return _council(spark, conf)
    if not conf.get("gemeenten"):
        raise SourceNotReady("council records need gemeenten")
    raw = _told(live.read(spark, "council", [(g,) for g in conf["gemeenten"]], **_options(conf)))
    parts = [records.council_documents(raw.where(F.col("slice") == g), conf.get("naam", "council"), g, "json", "doc_id") for g in conf["gemeenten"]]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _modules_live(spark: SparkSession, conf: dict) -> DataFrame:
    if conf.get("path"):
        return _modules(spark, conf)
    if not conf.get("sites"):
        raise SourceNotReady("modules need sites")
    years = range(int(conf["van"]), int(conf["tot"]) + 1) if conf.get("van") and conf.get("tot") else [None]
    hosts = [s.get("host") or f"{str(s.get('gemeente', '')).strip().lower()}.parlaeus.nl" for s in conf["sites"]]
    opts = _options(conf) | ({"modules": ";".join(conf["modules"])} if conf.get("modules") else {})
    found = _told(live.read(spark, "modules", [(h, y) for h in hosts for y in years], **opts))
    # an item that stands in the lists of several years comes once
    return found.groupBy("slice", "doc_id", "url").agg(F.min("ext").alias("ext"), F.min("titel").alias("titel")).select("url", "ext", "titel")


def _portal_live(spark: SparkSession, conf: dict) -> DataFrame:
    if conf.get("path"):
        return _portal(spark, conf)
    who = conf.get("organisatie") or conf.get("organisatie_naam")
    if not who:
        raise SourceNotReady("the portal needs organisatie or organisatie_naam")
    return _told(live.read(spark, "portal", [(who,)], **_options(conf, "max_paginas"))).select("url", "ext", "titel", "doc_id")


def _modules(spark: SparkSession, conf: dict) -> DataFrame:
    d = spark.read.text(conf["path"], wholetext=True).select(F.lit(conf.get("base", "")).alias("base"), F.col("value").alias("json"))
    links = stage(records.detail_links(d), "details")
    if not links.where("fout is not null").isEmpty():
        raise SourceNotReady("some details are no JSON")
    return links.select("url", F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:\?|$)", 1)).alias("ext")).distinct()


def _portal(spark: SparkSession, conf: dict) -> DataFrame:
    pages = spark.read.text(conf["path"], wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return records.portal_documents(pages, conf.get("base", ""))


def _folder(spark: SparkSession, conf: dict) -> DataFrame:
    cap = int(conf.get("max_mb", files.MAX_MB))
    d = files.decode(files.read_files(spark, conf["path"], cap)).unionByName(files.too_large(spark, conf["path"], cap))
    return d.select(F.col("path").alias("url"), "ext", F.col("sha256").alias("doc_id"), "chunks", "meta")


def _table(spark: SparkSession, conf: dict) -> DataFrame:
    return spark.read.parquet(conf["path"])


def _ibabs(spark: SparkSession, conf: dict) -> DataFrame:
    """Meetings (JSON, one a line) landed at path, or asked of a service ("module:factory"), whose agendas are a few thousand; their types (Id, Meetingtype) at types."""
    if not conf.get("sitename"):
        raise SourceNotReady("ibabs needs a sitename")
    types = spark.read.schema("Id string, Meetingtype string").json(conf["types"]) if conf.get("types") else spark.createDataFrame([], "Id string, Meetingtype string")
    wanted = records.resolve_types(conf.get("meetingtypes"), types)
    if conf.get("service"):
        module, _, name = conf["service"].partition(":")
        rows = [json.dumps(m, default=str) for m in live.meetings(getattr(import_module(module), name)(conf), conf["sitename"], types=wanted, since=conf.get("sinds"), start=conf.get("vanaf"), end=conf.get("tot"))]
        meetings = spark.createDataFrame([(r,) for r in rows], "m string").select(F.from_json("m", MEETING).alias("m")).select("m.*")
    else:
        meetings = spark.read.schema(MEETING).json(conf["path"])
    if wanted is not None:
        meetings = meetings.where(F.col("MeetingtypeId").isin(wanted))
    d = records.meeting_documents(meetings, types, conf["sitename"])
    if meetings.isEmpty():
        raise SourceNotReady("no meetings")
    if d.isEmpty():
        raise SourceNotReady("meetings without any document")
    names = {"site": "iBabs_site", **{c: c for c in ("agendatype", "vergaderdatum", "meeting_id", "niveau", "bestandsnaam", "vertrouwelijk")}}
    meta = F.create_map(*[x for c, k in names.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return d.select("doc_id", "url", "ext", "titel", meta.alias("meta"))


def _crawl(spark: SparkSession, conf: dict) -> DataFrame:
    """The documents linked from the pages that seeds reach over the landed pages (url, html) at path, within the allowed domains and the limits."""
    if not conf.get("path"):
        raise SourceNotReady("seeds need landed pages (paginas)")
    pages = spark.read.parquet(conf["path"])
    hosts = [h for u in conf["seeds"] if (h := urlsplit(u).hostname)]
    found = crawl.links(pages)
    found = stage(found.where(crawl.allowed(F.col("link"), [*hosts, *conf.get("toegestane_domeinen", [])])).withColumn("soort", crawl.link_class(F.col("link"))).distinct(), "crawl-links")
    seeds = spark.createDataFrame([(u,) for u in conf["seeds"]], "url string")
    reached = crawl.walk(seeds, found.where("soort = 'page'").select("url", "link"), int(conf.get("max_depth", 8)), int(conf.get("max_pages", 5000)))
    if reached.join(pages.select("url"), "url", "left_semi").isEmpty():
        raise SourceNotReady("none of the seeds has landed")
    docs = found.where("soort = 'file'").join(reached.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct().orderBy("url").limit(int(conf.get("max_files", 20000)))
    return docs.select("url", F.col("url").alias("doc_id"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#]|$)", 1)).alias("ext"))


def _not_available(spark: SparkSession, conf: dict) -> DataFrame:
    raise SourceNotReady("this service has no open interface")


CONNECTORS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "sru": _search, "openraadsinformatie": _council_live, "parlaeus": _modules_live, "qualigraf": _modules_live, "mijnpublicaties": _portal_live, "map": _folder, "tabel": _table, "ibabs": _ibabs, "crawl": _crawl, "notubiz": _not_available,
}


def configured(conf: Config) -> list[dict]:
    """The sources of a configuration, with its limits where they have none, and its seeds as a source of their own."""
    common = {"max_mb": conf.max_mb, "max_pages": conf.max_pages, "max_depth": conf.max_depth, "max_files": conf.max_files, "toegestane_domeinen": conf.toegestane_domeinen}
    own = [{"type": "crawl", "naam": "seeds", "seeds": conf.seeds, "path": conf.paginas}] if conf.seeds else []
    return [{**common, **b} for b in own + conf.bronnen]


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedSource)


def read_sources(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(documents, status) of configured sources ({type, naam, path, ...}); status is (naam, type, gelezen, reden).

    An unknown type is reported and skipped. Each source is read into a table of its own before its status is
    told, so one that fails at whatever row is listed with its reason and leaves the others whole.
    """
    docs, status = [], []
    for conf in sources:
        kind, naam = conf.get("type", ""), conf.get("naam", conf.get("type", ""))
        if kind not in CONNECTORS:
            status.append((naam, kind, False, f"unknown type; there are {', '.join(sorted(CONNECTORS))}"))
            continue
        try:
            docs.append(stage(_fit(CONNECTORS[kind](spark, conf), naam), "source"))
            bad = conf.pop("_mislukt", [])
            status.append((naam, kind, True, ""))
            status += [(f"{naam}: {x}", kind, False, why) for x, why in bad]
        except Exception as e:  # one source never stops the others
            status.append((naam, kind, False, f"{type(e).__name__}: {str(e)[:200]}"))
    none = spark.createDataFrame([], DOCUMENT)
    return reduce(lambda a, b: a.unionByName(b), docs, none), spark.createDataFrame(status, "naam string, type string, gelezen boolean, reden string")
