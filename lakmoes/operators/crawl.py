"""Crawling over landed pages: links, which of them count, and the breadth-first walk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakmoes.plans.stage import stage

# Links of these kinds are neither pages nor documents.
ASSETS = ("jpg", "jpeg", "png", "gif", "css", "js", "svg")
WANTED = ("pdf", "docx", "xlsx", "xlsm", "pptx")


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@|:\d+$", ""))


def allowed(url: Column, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains, below one, or shares the last two labels with one."""
    h = host(url)
    out = F.lit(False)
    for d in domains:
        d = d.lower()
        out = out | (h == d) | h.endswith("." + d) | (F.substring_index(h, ".", -2) == ".".join(d.split(".")[-2:]))
    return F.coalesce(out & (h != ""), F.lit(False))


def link_class(url: Column, wanted: Sequence[str] = WANTED) -> Column:
    """'file' for a wanted extension, null for an asset, else 'page'."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    ext = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    return F.when(ext.isin(*wanted), F.lit("file")).when(ext.isin(*ASSETS), F.lit(None)).otherwise(F.lit("page"))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found += [v for k, v in attrs if tag == "a" and k == "href" and v]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[str, str]] = []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            p = _Anchors()
            p.feed(html or "")
            for h in p.found:
                try:
                    to = urldefrag(urljoin(url, h.strip()))[0]
                except ValueError:
                    continue
                if to.startswith("http"):
                    rows.append((url, to))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["url", "link"])


def links(pages: DataFrame) -> DataFrame:
    """(url, link) of the anchors of pages (url, html): resolved, without fragment, http only. A page that can't be parsed has the links read so far."""
    return pages.where(F.col("url").isNotNull()).select("url", "html").mapInArrow(_links, "url string, link string")


def walk(seeds: DataFrame, edges: DataFrame, max_depth: int = 8, max_pages: int | None = None) -> DataFrame:
    """(url, depth): the pages reached from seeds (url) over edges (url, link), breadth first, each with its least depth.

    One anti join per level, on staged tables, so cycles end by themselves; pages at max_depth aren't expanded.
    max_pages, the limit of a configured crawl, keeps whole levels up to it and cuts the last by url.
    """
    level = stage(seeds.select("url").where(F.col("url").isNotNull()).distinct().withColumn("depth", F.lit(0)), "walk-0")
    seen = level
    for depth in range(1, max_depth + 1):
        if max_pages is not None and seen.count() >= max_pages:
            break
        new = edges.join(level.select("url"), "url", "left_semi").select(F.col("link").alias("url")).where(F.col("url").isNotNull()).distinct().join(seen, "url", "left_anti")
        level = stage(new.withColumn("depth", F.lit(depth)), f"walk-{depth}")
        if level.isEmpty():
            break
        seen = stage(seen.unionByName(level), f"seen-{depth}")
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def robots_allows(pages: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """pages (url) with `mag`, by the robots.txt of their host in robots (host, txt); a host without one allows all.

    Rules are read for the agent or for all agents; the longest matching path wins, Allow before Disallow.
    """
    rows = robots.select(F.lower("host").alias("host"), F.posexplode(F.split(F.coalesce("txt", F.lit("")), r"\r?\n")).alias("i", "l"))
    rows = rows.select("host", "i", F.lower(F.trim(F.regexp_extract("l", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("k"), F.trim(F.regexp_replace(F.regexp_extract("l", r":\s*(.*)$", 1), r"#.*$", "")).alias("v"))
    gathered = rows.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("i", "k", "v"))).alias("ls"))
    zero = F.named_struct(F.lit("on"), F.lit(False), F.lit("rules"), F.array().cast("array<struct<k:string,v:string>>"))

    def step(acc: Column, x: Column) -> Column:
        on = F.when(x["k"] == "user-agent", F.lower(x["v"]).isin("*", agent.lower())).otherwise(acc["on"])
        keep = acc["on"] & x["k"].isin("allow", "disallow") & (x["v"] != "")
        return F.named_struct(F.lit("on"), on, F.lit("rules"), F.when(keep, F.concat(acc["rules"], F.array(F.named_struct(F.lit("k"), x["k"], F.lit("v"), x["v"])))).otherwise(acc["rules"]))

    rules = gathered.select(F.col("host").alias("_h"), F.aggregate("ls", zero, step)["rules"].alias("_r"))
    p = pages.withColumn("_host", host(F.col("url"))).join(rules, F.col("_host") == F.col("_h"), "left")
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    hits = F.filter(F.coalesce("_r", F.array().cast("array<struct<k:string,v:string>>")), lambda r: F.startswith(path, r["v"]))
    best = F.array_max(F.transform(hits, lambda r: F.named_struct(F.lit("n"), F.length(r["v"]), F.lit("allow"), r["k"] == "allow")))
    return p.withColumn("mag", F.coalesce(best["allow"], F.lit(True))).drop("_host", "_h", "_r")
