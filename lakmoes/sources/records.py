"""Parsers of landed responses: announcements (XML), council records (JSON), menus and details (JSON), meetings, and portal pages (HTML).

Each takes responses that stand in a table or folder and gives documents or addresses; no parser opens a connection.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakmoes.functions.scalars import first_filled
from lakmoes.plans.stage import small

ANNOUNCEMENT = "title array<string>, itemUrl array<struct<_manifestation:string,_VALUE:string>>, externeBijlage array<string>, modified string, creator string"
COUNCIL = "`@id` string, original_url string, name string, text string, md_text string, text_pages array<struct<page:int,text:string>>, file_name string, content_type string, date_modified string, has_organization_name string"
# File kinds offered by detail pages, modules that hold no documents, and those to fall back on.
DOCUMENT_KINDS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
NO_MODULES = ("calendar", "councilperiod")
FALLBACK_MODULES = ("postin", "councildocument", "bestuursdocument", "beleidsdocument", "dossier", "question", "motie", "toezegging", "verordening", "publicdocument", "raadsbesluit")


def read_announcements(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """Announcements of landed search responses; names are taken without their namespace."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(ANNOUNCEMENT).load(path)


def announcements(records: DataFrame) -> DataFrame:
    """records with titel and pdf_url: the first title and the first address of manifestation pdf that aren't blank."""
    filled = lambda c: F.length(F.trim(c)) > 0
    pdf = F.filter(F.coalesce("itemUrl", F.array().cast("array<struct<_manifestation:string,_VALUE:string>>")), lambda x: (x["_manifestation"] == "pdf") & filled(x["_VALUE"]))
    title = F.filter(F.coalesce("title", F.array().cast("array<string>")), filled)
    return records.withColumn("titel", F.trim(F.get(title, F.lit(0)))).withColumn("pdf_url", F.trim(F.get(pdf, F.lit(0))["_VALUE"]))


def attachment(entry: Column) -> tuple[Column, Column]:
    """(name, id) of an entry "file name|exb-id": split at the last bar; the id is the tail, else looked for in all of it; an empty name is the id. No id gives null."""
    tail = F.trim(F.substring_index(entry, "|", -1))
    exb = F.when(tail.rlike(r"^exb-\d{4}-\d+$"), tail).otherwise(F.regexp_extract(entry, r"exb-\d{4}-\d+", 0))
    exb = F.nullif(exb, F.lit(""))
    name = F.when(entry.contains("|"), F.trim(F.regexp_extract(entry, r"(?s)^(.*)\|[^|]*$", 1))).otherwise(F.lit(""))
    return F.when(exb.isNotNull(), first_filled(name, exb)), exb


def attachments(records: DataFrame, resolved: DataFrame | None = None, pattern: str = "https://repository.example/exb/{}.pdf") -> DataFrame:
    """(url, titel) of the attachments of announcements. resolved (exb, url) holds what listings told; else the address follows the pattern."""
    a = records.select("titel", F.explode("externeBijlage").alias("e"))
    name, exb = attachment(F.col("e"))
    a = a.select("titel", name.alias("naam"), exb.alias("exb")).where(F.col("exb").isNotNull())
    titel = F.when(F.length("titel") > 0, F.concat("titel", F.lit(" · bijlage: "), "naam")).otherwise(F.concat(F.lit("bijlage: "), "naam"))
    fixed = F.format_string(pattern.replace("{}", "%s"), "exb")
    if resolved is None:
        return a.select("exb", fixed.alias("url"), titel.alias("titel"))
    r = resolved.select(F.col("exb").alias("_e"), F.col("url").alias("_u"))
    return a.join(r, F.col("exb") == F.col("_e"), "left").select("exb", F.coalesce("_u", fixed).alias("url"), titel.alias("titel"))


def search_query(creator: str, since: str | None = None, until: str | None = None) -> str:
    """The filter of the search service: area, creator and dates of change joined by and."""
    parts = ["c.product-area==officielepublicaties", f'dt.creator=="{creator}"']
    parts += [f'dt.modified>="{since}"'] if since else []
    parts += [f'dt.modified<="{until}"'] if until else []
    return " AND ".join(parts)


def council_documents(raw: DataFrame, source: str, gemeente: str, json_col: str = "json", id_col: str = "es_id") -> DataFrame:
    """Documents of council records (JSON): pages before marked-up text before plain text; records without any are left out."""
    r = raw.select(F.col(id_col).alias("es_id"), F.from_json(json_col, COUNCIL).alias("r"))
    pages = F.filter(F.coalesce("r.text_pages", F.array().cast("array<struct<page:int,text:string>>")), lambda p: F.length(F.trim(p["text"])) > 0)
    chunks = F.transform(pages, lambda p, i: F.named_struct(F.lit("idx"), i, F.lit("loc"), F.concat(F.lit("pagina "), F.coalesce(p["page"], i + 1)), F.lit("text"), p["text"]))
    text = first_filled(F.col("r.md_text"), F.col("r.text"))
    keys = ("file_name", "content_type", "date_modified", "has_organization_name", "original_url")
    meta = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"r.{k}"))]), lambda k, v: F.length(v) > 0)
    d = r.select(
        F.lit(source).alias("bron"),
        F.concat(F.lit(gemeente + ":"), first_filled(F.col("r.@id"), F.col("r.original_url"), F.col("es_id"))).alias("doc_id"),
        F.col("r.original_url").alias("url"),
        F.coalesce("r.name", F.lit("")).alias("titel"),
        F.when(F.size(chunks) > 0, F.lit(None)).otherwise(text).alias("text"),
        F.when(F.size(chunks) > 0, chunks).alias("chunks"),
        meta.alias("meta"),
    )
    return d.where(F.col("text").isNotNull() | F.col("chunks").isNotNull())


def newest_snapshot(indices: DataFrame, prefix: str = "ori_") -> DataFrame:
    """(gemeente, index): the last snapshot of each municipality by name."""
    i = indices.where(F.col("index").startswith(prefix))
    return i.groupBy(F.regexp_extract("index", f"^{prefix}(.+)_[^_]*$", 1).alias("gemeente")).agg(F.max("index").alias("index"))


def menu_modules(menus: DataFrame, json_col: str = "json") -> DataFrame:
    """menus with `modules`: the lower-case names of a menu's entries in order, without double ones and those that hold no documents."""
    groups = F.from_json(json_col, "array<struct<label:string,entries:array<struct<name:string,label:string>>>>")
    names = F.flatten(F.transform(groups, lambda g: F.transform(F.coalesce(g["entries"], F.array().cast("array<struct<name:string,label:string>>")), lambda e: F.lower(e["name"]))))
    return menus.withColumn("modules", F.array_distinct(F.filter(names, lambda n: F.length(n).isNotNull() & (F.length(n) > 0) & ~n.isin(*NO_MODULES))))


def _walk_links(x, out: list[str]) -> None:
    stack = [x]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            link = x.get("link")
            if isinstance(link, str) and ("showdoc" in link.lower() or "showannex" in link.lower()) and link.split("?")[0].rsplit(".", 1)[-1].lower() in DOCUMENT_KINDS:
                out.append(link)
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)


def document_links(details) -> list[str]:
    """The links to documents anywhere inside the details of an item."""
    out: list[str] = []
    _walk_links(details, out)
    return out


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for base, text in zip(batch.column("base").to_pylist(), batch.column("json").to_pylist()):
            try:
                rows += [(base, urljoin(base or "", f), None) for f in document_links(json.loads(text or "null"))]
            except ValueError as e:
                rows.append((base, None, f"no JSON: {e}"[:200]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["base", "url", "fout"])


def detail_links(details: DataFrame) -> DataFrame:
    """(base, url, fout) of the document links anywhere inside details (base, json), made absolute. Details that are no JSON give one row with fout."""
    return details.select("base", "json").mapInArrow(_details, "base string, url string, fout string")


DOC = "array<struct<Id:string,FileName:string,DisplayName:string,Confidential:boolean,PublicDownloadURL:string>>"


def meeting_documents(meetings: DataFrame, types: DataFrame, site: str) -> DataFrame:
    """Documents of meetings at their three levels; those without an address are left out. types (Id, Meetingtype) is a small dimension."""
    m = meetings.join(small(types.select(F.col("Id").alias("_t"), "Meetingtype")), F.col("MeetingtypeId") == F.col("_t"), "left")
    none = F.array().cast(DOC)
    own = m.select("*", F.explode(F.coalesce("Documents", none)).alias("d"), F.lit("vergadering").alias("niveau"))
    items = m.select("*", F.explode("MeetingItems").alias("i")).select("*", F.explode(F.coalesce("i.Documents", none)).alias("d"), F.concat(F.lit("agendapunt "), F.coalesce("i.Features", F.lit(""))).alias("niveau")).drop("i")
    lists = m.select("*", F.explode("ListItems").alias("i")).select("*", F.explode(F.coalesce("i.Documents", none)).alias("d"), F.lit("lijstitem").alias("niveau")).drop("i")
    rows = own.unionByName(items).unionByName(lists).where(F.length("d.PublicDownloadURL") > 0)
    ext = F.lower(F.regexp_extract("d.FileName", r"\.([A-Za-z0-9]+)$", 1))
    return rows.select(
        F.col("d.Id").alias("doc_id"), F.col("d.PublicDownloadURL").alias("url"), F.when(ext == "", F.lit("pdf")).otherwise(ext).alias("ext"), first_filled(F.col("d.DisplayName"), F.col("d.FileName")).alias("titel"),
        F.lit(site).alias("site"), F.col("Meetingtype").alias("agendatype"), F.left(F.col("MeetingDate"), F.lit(10)).alias("vergaderdatum"), F.col("Id").alias("meeting_id"), F.trim("niveau").alias("niveau"),
        F.col("d.FileName").alias("bestandsnaam"), F.coalesce("d.Confidential", F.lit(False)).alias("vertrouwelijk"),
    ).dropDuplicates(["doc_id"])


def resolve_types(wanted: list[str] | None, types: DataFrame) -> list[str] | None:
    """The ids of the wanted meeting types, given by id or by name in any case; an unknown one is an error that lists the choices. None means no filter."""
    if not wanted:
        return None
    rows = types.select("Id", "Meetingtype").collect()
    by = {r[0]: r[0] for r in rows} | {(r[1] or "").strip().lower(): r[0] for r in rows}
    unknown = [w for w in wanted if w not in by and w.strip().lower() not in by]
    if unknown:
        raise ValueError(f"unknown meeting types {sorted(unknown)}; there are {sorted(r[1] for r in rows if r[1])}")
    return list(dict.fromkeys(by.get(w) or by[w.strip().lower()] for w in wanted))


def meetings_per_type(meetings: DataFrame, types: DataFrame) -> DataFrame:
    n = meetings.groupBy("MeetingtypeId").agg(F.count("*").alias("n"))
    return n.join(small(types.select(F.col("Id").alias("MeetingtypeId"), "Meetingtype")), "MeetingtypeId", "left")


def portal_publications(pages: DataFrame) -> DataFrame:
    """(url, publicatie) of the publication ids on listing pages (url, html), each once per page in order."""
    ids = F.array_distinct(F.regexp_extract_all("html", F.lit("/Publicatie/([0-9a-f-]{36})"), F.lit(1)))
    return pages.select("url", F.explode(ids).alias("publicatie"))


def portal_documents(pages: DataFrame, base: str) -> DataFrame:
    """Documents of publication pages (url, html): the title of the page's heading joined with each document's name; kind by that name."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    titel = plain(F.regexp_extract("html", r"(?s)<h[12][^>]*>(.*?)</h[12]>", 1))
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*\bdocument\b[^>]*>(.*?)</li>"), F.lit(1))
    b = pages.select("url", titel.alias("t"), F.explode(blocks).alias("b"))
    b = b.select("url", "t", F.regexp_extract("b", r"(?i)/api-public/document/([0-9a-f-]{36})", 1).alias("guid"), plain(F.regexp_extract("b", "<div[^>]*>([^<]+)</div>", 1)).alias("naam")).where("guid <> ''")
    ext = F.lower(F.regexp_extract("naam", r"\.([A-Za-z0-9]{2,5})$", 1))
    return b.select(F.concat(F.lit(base.rstrip("/") + "/api-public/document/"), "guid").alias("url"), F.when(ext == "", F.lit("pdf")).otherwise(ext).alias("ext"), F.concat_ws(" - ", F.nullif("t", F.lit("")), F.nullif("naam", F.lit(""))).alias("titel"), F.col("guid").alias("doc_id"))
