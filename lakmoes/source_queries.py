"""Queries of the parsers, the paged services, the decoders and the state, by name, and their SQL. Texts and answers are derived from the keys of the star schema."""

from __future__ import annotations

import json
import zipfile
import zlib
from collections.abc import Callable
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakmoes.functions import scalars as S
from lakmoes.functions.urls import normal_status
from lakmoes.operators import crawl, detectors, manifest
from lakmoes.plans.stage import stage_path
from lakmoes.sources import fetch, files, live, records
from lakmoes.streaming import resume


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _only(key: str) -> dict[str, bool]:
    return {d.key: d.key == key for d in detectors.detectors()}


def announcement_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    link = lambda kind, v: F.struct(F.lit(kind).alias("_manifestation"), v.alias("_VALUE"))
    pdf = F.when(k % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" https://d.example/"), k))
    r = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 4 == 0, F.array(F.lit(" "), "p_name")).when(k % 4 == 1, F.array("p_name", "p_brand")).alias("title"),
        F.when(k % 5 > 0, F.array(link("html", F.lit("h")), link("pdf", pdf), link("pdf", F.lit("tweede")))).alias("itemUrl"),
    )
    return records.announcements(r).select("p_partkey", "titel", "pdf_url")


def module_menu(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    entries = F.array_sort(F.collect_list(F.struct(F.upper("n_name").alias("name"), F.lit("x").alias("label"))))
    groups = n.groupBy("n_regionkey").agg(entries.alias("e"))
    more = F.array(F.struct(F.lit("Calendar").alias("name"), F.lit("x").alias("label")), F.struct(F.lit("kenya").alias("name"), F.lit("x").alias("label")))
    menus = groups.select("n_regionkey", F.to_json(F.array(F.struct(F.lit("a").alias("label"), F.col("e").alias("entries")), F.struct(F.lit("b").alias("label"), more.alias("entries")))).alias("json"))
    return records.menu_modules(menus).select("n_regionkey", F.array_join("modules", ",").alias("modules"))


def item_links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    inner = F.struct(F.concat(F.lit("f/showdoc/"), k, F.when(F.col("p_partkey") % 3 == 0, F.lit(".exe")).otherwise(F.lit(".PDF?x=1"))).alias("link"))
    other = F.struct(F.concat(F.lit("/g/showannex/"), k, F.lit(".docx")).alias("link"), F.array(inner).alias("in"))
    d = table(spark, sf, "part").select(F.concat(F.lit("https://s.example/m/"), k, F.lit("/")).alias("base"), F.when(F.col("p_partkey") % 7 == 0, F.lit("geen json")).otherwise(F.to_json(F.struct(other.alias("a"), F.lit("leeg").alias("link")))).alias("json"))
    return records.detail_links(d).select("base", "url", F.col("fout").isNotNull().alias("mislukt"))


def meeting_levels(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    doc = F.struct(F.concat(k, F.lit("-"), n).alias("Id"), F.concat(F.lit("stuk"), n, F.when(n % 2 == 0, F.lit(".DOCX")).otherwise(F.lit(""))).alias("FileName"), F.when(n % 3 == 0, F.col("flag")).otherwise(F.lit("")).alias("DisplayName"), F.when(n == 4, F.lit(True)).alias("Confidential"), F.when(n < 7, F.concat(F.lit("https://r.example/"), k, F.lit("/"), n)).alias("PublicDownloadURL"))
    level = lambda c: F.collect_list(F.when(c, doc))
    m = li.groupBy("l_orderkey").agg(level(n <= 2).alias("Documents"), level(n.between(3, 4)).alias("i"), level(n > 4).alias("l"))
    m = m.select(k.alias("Id"), F.when(F.col("l_orderkey") % 3 > 0, (F.col("l_orderkey") % 3).cast("string")).alias("MeetingtypeId"), F.lit("2024-05-06T10:00").alias("MeetingDate"), "Documents", F.array(F.struct(F.lit("3").alias("Features"), F.col("i").alias("Documents"))).alias("MeetingItems"), F.array(F.struct(F.col("l").alias("Documents"))).alias("ListItems"))
    types = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("Id"), F.col("r_name").alias("Meetingtype"))
    return records.meeting_documents(m, types, "s").select("doc_id", "url", "ext", "titel", "agendatype", "vergaderdatum", "niveau", "vertrouwelijk")


def portal_pages(spark: SparkSession, sf: str) -> DataFrame:
    guid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    item = F.concat(F.lit('<li class="document x"><a href="/api-public/document/'), guid, F.lit('"></a><div>kaart '), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(".XLSX")).otherwise(F.lit("")), F.lit("</div></li>"))
    html = F.concat(F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("<h2 class=t>Plan <b>"), "p_brand", F.lit("</b>\n</h2>"))).otherwise(F.lit("")), item, F.lit('<li class="document">niets</li>'))
    return records.portal_documents(table(spark, sf, "part").select("p_partkey", guid.alias("url"), html.alias("html")), "https://p.example/")


def paged_search(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements of five creators in pages of three, one creator without any since a day and so searched again without it."""
    by: dict[str, list[str]] = {}
    names = {r[0]: r[1] for r in table(spark, sf, "region").select("r_regionkey", "r_name").collect()}
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():
        by.setdefault(names[r["n_regionkey"]], []).append(r["n_name"])
    answers = {}
    for creator, nations in by.items():
        since = None if creator == "ASIA" else "2024-01-01"
        for at in range(0, len(nations), 3):
            rows = "".join(f"<x:record xmlns:x='u'><x:title>{n}</x:title><x:itemUrl manifestation='pdf'>https://d.example/{n.replace(' ', '_')}</x:itemUrl></x:record>" for n in nations[at : at + 3])
            url = live._search_url("https://z.example", records.search_query(creator, since), at + 1, 3)
            answers[fetch.landed_name(url)] = f"<r>{rows}<nextRecordPosition>{at + 4}</nextRecordPosition></r>"
        end = live._search_url("https://z.example", records.search_query(creator, since), (len(nations) + 2) // 3 * 3 + 1, 3)
        answers[fetch.landed_name(end)] = "<r/>"
        if since is None:
            answers[fetch.landed_name(live._search_url("https://z.example", records.search_query(creator, "2024-01-01"), 1, 3))] = "<r/>"
    found = live.announcements(spark, sorted(by), "2024-01-01", opener="lakmoes.sources.fetch:given", answers=json.dumps(answers), endpoint="https://z.example", page_size="3")
    return found.select("slice", "url", "titel")


def _packed(parts: dict[str, str]) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _pdf(first: str, second: str) -> bytes:
    """Two pages, of which the first has the higher number."""
    out = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [7 0 R 5 0 R]>> endobj\n"
    for page, stream, text in ((7, 4, first), (5, 3, second)):
        z = zlib.compress(f"BT ({text}) Tj ET".encode())
        out += b"%d 0 obj <</Type /Page /Contents %d 0 R>> endobj\n%d 0 obj <</Filter /FlateDecode>> stream\n%s\nendstream endobj\n" % (page, stream, stream, z)
    return out + b"trailer <</Root 1 0 R>>"


def decoded_files(spark: SparkSession, sf: str) -> DataFrame:
    """A document, a slide show, a PDF and a broken file for each nation, as chunks."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    rows = []
    for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect():
        k, n = r
        rows.append((f"{k}.docx", "docx", _packed({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>{n}</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>{k}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})))
        rows.append((f"{k}.pptx", "pptx", _packed({f"ppt/slides/slide{i}.xml": f"<s {a}><a:p><a:t>{n} {i}</a:t></a:p></s>" for i in (2, 10)})))
        rows.append((f"{k}.pdf", "pdf", _pdf(n, str(k))))
        rows.append((f"{k}.xlsx", "xlsx", f"kapot {k}".encode()))
    d = spark.createDataFrame(rows, "path string, ext string, content binary").withColumn("sha256", F.sha2("content", 256))
    return files.decode(d).select("path", "status", F.posexplode_outer("chunks").alias("i", "c")).select("path", "status", "i", F.col("c.loc").alias("loc"), F.col("c.text").alias("tekst"))


def redacted(spark: SparkSession, sf: str) -> DataFrame:
    n = F.lpad((F.col("c_custkey") * 7919 % 10**9).cast("string"), 9, "0")
    t = F.concat(F.lit("mail klant"), F.col("c_custkey").cast("string"), F.lit("@post.example of bel "), n, F.lit(", kamer "), (F.col("c_custkey") % 1000).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", S.redact(t).alias("tekst"))


def hidden_sheet_findings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    meta = F.create_map(F.lit("_verborgen_tabbladen"), F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, F.lit("")), F.lit("auteur"), F.col("c_name"))
    return detectors.hidden_sheets(table(spark, sf, "customer").select("c_custkey", meta.alias("meta")), ["c_custkey"]).select("c_custkey", "soort", "ernst", "waarde_masked")


def email_by_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail addresses in chunks, or in the text of documents without, and in metadata."""
    f = detectors.scan_documents(table(spark, sf, "bron_document"), ["rij_id"], (), _only("email"))
    return f.groupBy("rij_id", "chunk_idx", "locatie").agg(F.count("*").alias("n"))


def stream_email(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail addresses of the documents, read as a stream."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = stage_path(spark, "stream")
    docs = resume.documents(spark, f"{sf}/documents.parquet*", d.schema)
    resume.scan_stream(docs, ["doc_id"], f"{out}/out", f"{out}/progress", enabled=_only("email"), chunks=None, meta=None).awaitTermination()
    return spark.read.parquet(f"{out}/out").groupBy("doc_id").agg(F.count("*").alias("n"))


def robots_gate(spark: SparkSession, sf: str) -> DataFrame:
    robots = table(spark, sf, "files").select(crawl.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    robots = robots.where(F.length("host") % 2 == 0).withColumn("txt", F.lit("User-agent: *\nDisallow: /d\nAllow: /documenten # open\nUser-agent: ander\nDisallow: /"))
    return crawl.robots_allows(table(spark, sf, "files").select("file_id", "url"), robots).select("file_id", "mag")


def _first_states(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files").select("url", "file_id", "sha256", "local_path", "note", normal_status(F.col("status")).alias("status"))
    return manifest.first_by_key(f.where(F.col("url").isNotNull()), ["url"], "file_id")


def manifest_marked(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each address with what its later rows told laid over it."""
    later = table(spark, sf, "files").select("url", "sha256", "local_path", "note", normal_status(F.col("status")).alias("status"), F.col("file_id").alias("nr"))
    later = later.join(_first_states(spark, sf).select(F.col("file_id").alias("f")), F.col("nr") == F.col("f"), "left_anti")
    return manifest.marked(_first_states(spark, sf), later)


def manifest_claimed(spark: SparkSession, sf: str) -> DataFrame:
    """All rows to do, claimed by three runners."""
    m = _first_states(spark, sf)
    parts = [manifest.claimed(m, k, 3, "file_id") for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("url", "status")


def manifest_requeued(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.state_counts(manifest.requeued(_first_states(spark, sf)))


def manifest_migrated(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "files").select("file_id", "url")
    return manifest.migrated(old)


def document_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = manifest.split_documents(table(spark, sf, "bron_document"))
    out = [p.groupBy("bron").agg(F.count("*").alias("n")).withColumn("deel", F.lit(x)) for p, x in zip(parts, ("tekst", "adres", "geen"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def report_shown(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.shown(table(spark, sf, "findings").where(F.col("ernst").isNotNull())).select("finding_id", "local_path", "ernst")


def text_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), S.html_unescaped(S.html_escaped(F.col("text"))).eqNullSafe(F.col("text")).alias("heen_en_terug"))


def number_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat_ws(" ", F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("9.876.543,00")).otherwise(F.col("o_orderpriority")))
    return table(spark, sf, "orders").select("o_orderkey", detectors.number_table(t).alias("tabel"))


def retry_waits(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(r[0], s, h, fetch.wait_before(r[0], s, h)) for r in table(spark, sf, "region").select("r_regionkey").collect() for s in (429, 503) for h in (None, "60", "5000", "Wed")]
    return spark.createDataFrame(rows, "poging int, toestand int, gevraagd string, wacht int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (announcement_fields, module_menu, item_links, meeting_levels, portal_pages, paged_search, decoded_files, redacted, hidden_sheet_findings, email_by_chunk, stream_email, robots_gate, manifest_marked, manifest_claimed, manifest_requeued, manifest_migrated, document_split, report_shown, text_digest, number_tables, retry_waits)}
