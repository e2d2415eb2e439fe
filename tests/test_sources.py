import io
import json
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lakmoes.config import Config
from lakmoes.operators import crawl, manifest
from lakmoes.sources import fetch, files, records, registry, sinks
from lakmoes.streaming import resume


def test_announcements(spark, tmp_path):
    p = tmp_path / "a.xml"
    p.write_text("""<r xmlns:x="u"><record><x:title> </x:title><x:title>Besluit</x:title><x:itemUrl manifestation="html">h</x:itemUrl><x:itemUrl manifestation="pdf">https://a/x.pdf</x:itemUrl>
    <x:externeBijlage>kaart|1.pdf|exb-2024-12</x:externeBijlage><x:externeBijlage>|exb-2024-13</x:externeBijlage><x:externeBijlage>geen|x</x:externeBijlage></record><record><x:title>Leeg</x:title></record></r>""")
    a = records.announcements(records.read_announcements(spark, str(p))).orderBy("titel").collect()
    assert [(r["titel"], r["pdf_url"]) for r in a] == [("Besluit", "https://a/x.pdf"), ("Leeg", None)]
    b = records.attachments(records.announcements(records.read_announcements(spark, str(p)))).orderBy("exb").collect()
    assert [(r["exb"], r["titel"]) for r in b] == [("exb-2024-12", "Besluit · bijlage: kaart|1.pdf"), ("exb-2024-13", "Besluit · bijlage: exb-2024-13")]
    assert records.search_query("X", "2024-01-01") == 'c.product-area==officielepublicaties AND dt.creator=="X" AND dt.modified>="2024-01-01"'


def test_council_and_menus(spark):
    rows = [json.dumps({"@id": "1", "text": "t", "md_text": "m", "text_pages": [{"page": 3, "text": "p"}, {"page": 4, "text": " "}]}), json.dumps({"@id": "2", "text": "t", "md_text": "m"}), json.dumps({"name": "niets"}), "geen json"]
    d = {r["doc_id"]: r for r in records.council_documents(spark.createDataFrame([(x, str(i)) for i, x in enumerate(rows)], "json string, es_id string"), "raad", "g").collect()}
    assert set(d) == {"g:1", "g:2"} and [c["loc"] for c in d["g:1"]["chunks"]] == ["pagina 3"] and d["g:1"]["text"] is None and d["g:2"]["text"] == "m"
    m = spark.createDataFrame([(json.dumps([{"label": "a", "entries": [{"name": "Raad"}, {"name": "calendar"}, {"name": "raad"}, {"name": "Motie"}]}]),)], "json string")
    assert records.menu_modules(m).first()["modules"] == ["raad", "motie"]
    det = spark.createDataFrame([("https://s/", json.dumps({"a": [{"link": "x?"}, {"b": {"link": "f/showdoc/1.pdf?q=1"}}, {"link": "f/showannex/2.exe"}]})), ("https://s/", "{")], "base string, json string")
    links = records.detail_links(det).collect()
    assert [r["url"] for r in links if r["fout"] is None] == ["https://s/f/showdoc/1.pdf?q=1"] and sum(r["fout"] is not None for r in links) == 1


def test_meetings(spark):
    doc = lambda i, u="u": {"Id": i, "FileName": f"{i}.DOCX", "DisplayName": "", "Confidential": None, "PublicDownloadURL": u}
    kind = f"Id string, MeetingtypeId string, MeetingDate string, Documents {records.DOC}, MeetingItems array<struct<Features:string,Documents:{records.DOC}>>, ListItems array<struct<Documents:{records.DOC}>>"
    m = spark.createDataFrame([("m", "t", "2024-05-06T10:00", [doc("a"), doc("z", None)], [{"Features": "3", "Documents": [doc("b")]}], [{"Documents": [doc("c")]}]), ("n", "onbekend", None, None, None, None)], kind)
    t = spark.createDataFrame([("t", "Raad")], "Id string, Meetingtype string")
    d = {r["doc_id"]: r for r in records.meeting_documents(m, t, "s").collect()}
    assert {k: v["niveau"] for k, v in d.items()} == {"a": "vergadering", "b": "agendapunt 3", "c": "lijstitem"}
    assert d["a"]["ext"] == "docx" and d["a"]["titel"] == "a.DOCX" and d["a"]["vergaderdatum"] == "2024-05-06" and d["a"]["vertrouwelijk"] is False
    assert records.resolve_types([" raad "], t) == ["t"] and records.resolve_types(None, t) is None
    with pytest.raises(ValueError, match="Raad"):
        records.resolve_types(["x"], t)


def test_portal(spark):
    g = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    html = f'<h1>Bouw <b>plan</b></h1><a href="/Publicatie/{g}"></a><a href="/Publicatie/{g}"></a><li class="document"><a href="/api-public/document/{g}"></a><div>Kaart.PDF</div></li><li class="document">niets</li>'
    p = spark.createDataFrame([("u", html), ("leeg", ""), ("nul", None)], "url string, html string")
    assert [r["publicatie"] for r in records.portal_publications(p).collect()] == [g]
    d = records.portal_documents(p, "https://b/").collect()
    assert [(r["ext"], r["titel"], r["url"]) for r in d] == [("pdf", "Bouw plan - Kaart.PDF", f"https://b/api-public/document/{g}")]


def _zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def make_pdf(text=b"(Hallo \\(wereld\\)) Tj", image=False):
    return pdf_of({4: b"BT " + text + b" ET" + (b" /I Do" if image else b"")}, b"")


def pdf_of(pages, resources, extra=b""):
    """A file whose page tree lists the pages in the order given, whatever their numbers."""
    kids = b" ".join(b"%d 0 R" % (k + 100) for k in pages)
    out = b"%%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [%s] %s>> endobj\n3 0 obj <</Title (T)>> endobj\n" % (kids, resources)
    for k, data in pages.items():
        z = zlib.compress(data)
        out += b"%d 0 obj <</Type /Page /Parent 2 0 R /Contents %d 0 R>> endobj\n%d 0 obj <</Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj\n" % (k + 100, k, k, len(z), z)
    return out + extra + b"trailer <</Root 1 0 R /Info 3 0 R>>"


def test_pdf_order_and_fonts():
    two = pdf_of({9: b"BT (een) Tj ET", 5: b"BT (twee) Tj ET"}, b"")
    assert files.decode_one(two, "pdf")[1] == [("pagina 1", "een"), ("pagina 2", "twee")]
    fonts = b"/Resources <</Font <</F1 20 0 R /F2 22 0 R>> /ProcSet [/PDF]>>"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0024> <0041> <0048> <00660069> endbfchar 1 beginbfrange <0055> <0056> <0062> endbfrange"
    extra = b"20 0 obj <</Type /Font /Subtype /Type0 /ToUnicode 21 0 R>> endobj\n21 0 obj <</Length 9>> stream\n" + cmap + b"\nendstream endobj\n22 0 obj <</Type /Font /Subtype /Type0>> endobj\n"
    mapped = pdf_of({4: b"BT /F1 12 Tf <0024004800550056> Tj ET"}, fonts, extra)
    assert files.decode_one(mapped, "pdf")[1] == [("pagina 1", "Afibc")]
    blind = pdf_of({4: b"BT /F2 12 Tf <0024004800550056> Tj ET"}, fonts, extra)
    assert files.decode_one(blind, "pdf")[0] == "unreadable"
    half = pdf_of({4: b"BT /F2 12 Tf <0024> Tj ET", 5: b"BT (leesbaar) Tj ET"}, fonts, extra)
    assert files.decode_one(half, "pdf")[:2] == ("ok", [("pagina 2", "leesbaar")]) and "1 page" in files.decode_one(half, "pdf")[2]["_fout"]


def test_decoders(spark, tmp_path):
    docx = _zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Een</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "docProps/core.xml": "<c><creator>Ik</creator></c>"})
    assert files.decode_one(docx, "docx") == ("ok", [("document", "Een\na | b")], {"creator": "Ik"})
    out = tmp_path / "x.xlsx"
    assert sinks.write_workbook(str(out), ["k1", "k2"], [["v", None], ["<&>", "w"]]) == 2
    status, chunks, meta = files.decode_one(out.read_bytes(), "xlsx")
    assert status == "ok" and chunks == [("tabblad Bevindingen", "k1 | k2\nv\n<&> | w")] and meta == {}
    hidden = out.read_bytes().replace(b"", b"")
    z = zipfile.ZipFile(io.BytesIO(hidden))
    parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b'sheetId="1"', b'sheetId="1" state="hidden"')
    status, chunks, meta = files.decode_one(_zip(parts), "xlsx")
    assert chunks[0][0].endswith("[VERBORGEN]") and meta["_verborgen_tabbladen"] == "Bevindingen"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide"
    pptx = _zip({"ppt/slides/slide2.xml": f"<s {A}><a:p><a:t>Twee</a:t></a:p></s>", "ppt/slides/slide10.xml": f"<s {A}><a:p><a:t>Tien</a:t></a:p></s>", "ppt/slides/_rels/slide2.xml.rels": f'<R><r Type="{rel}" Target="../notesSlides/n.xml"/></R>', "ppt/notesSlides/n.xml": f"<s {A}><a:p><a:t>noot</a:t></a:p></s>"})
    assert files.decode_one(pptx, "pptx")[1] == [("dia 1", "Twee\n[notities] noot"), ("dia 2", "Tien")]
    assert files.decode_one(make_pdf(), "pdf") == ("ok", [("pagina 1", "Hallo (wereld)")], {"title": "T"})
    assert files.decode_one(make_pdf(b"", True), "pdf")[0] == "empty" and files.decode_one(make_pdf(b"", True), "pdf")[2]["_ocr_kandidaat_paginas"] == "1"
    assert files.decode_one(b"stuk", "docx")[0] == "unreadable" and files.decode_one(None, "pdf")[0] == "unreadable" and files.decode_one(b"x", "doc")[0] == "unsupported"
    folder = tmp_path / "map"
    folder.mkdir()
    for n, c in (("a.docx", docx), ("b.docx", docx), ("c.pdf", b"stuk"), ("d.doc", b"x")):
        (folder / n).write_bytes(c)
    rows = files.decode(files.read_files(spark, str(folder))).collect()
    assert sorted((os.path.basename(r["path"]), r["status"]) for r in rows) == [("a.docx", "ok"), ("c.pdf", "unreadable"), ("d.doc", "unsupported")]


def test_retry_schedule(tmp_path):
    assert [fetch.wait_before(i, 503) for i in range(5)] == [5, 15, 45, 120, 120]
    assert [fetch.wait_before(i, 429) for i in range(4)] == [300, 600, 900, 900]
    assert fetch.wait_before(0, 503, "60") == 60 and fetch.wait_before(0, 429, "60") == 300 and fetch.server_wait("5000") == 900 and fetch.server_wait("Wed") is None
    replies, slept = [fetch.Response(503, {"Retry-After": "7"}, []), fetch.Response(200, {}, [b"ab", b"c"])], []
    sha, path, n = fetch.download(lambda u: replies.pop(0), "https://a/x.pdf?y", str(tmp_path), sleep=slept.append)
    assert slept == [7] and n == 3 and path.endswith(sha + ".pdf") and open(path, "rb").read() == b"abc"
    with pytest.raises(fetch.GivenUp):
        fetch.download(lambda u: fetch.Response(404, {}, []), "https://a/x", str(tmp_path))
    with pytest.raises(fetch.TooLarge):
        fetch.download(lambda u: fetch.Response(200, {}, [b"x" * 2_000_000]), "https://a/x", str(tmp_path), max_mb=1)
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".part")]
    t, now, waits = None, [0.0], []
    t = fetch.Throttle(1.0, lambda: now[0], waits.append)
    t.wait("a"), t.wait("b"), t.wait("a")
    assert waits == [1.0]


def test_registry(spark, tmp_path):
    for s, n in (("2023", 1), ("2024", 2)):
        (tmp_path / "in" / s).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "in" / s / f"{i}.txt").write_text(f"{s}-{i}")
    registry.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("lakmoes_landed").load(str(tmp_path / "in"))
    assert df.count() == 3 and df.where("slice = '2024' and body like '%-1'").count() == 1 and df.where("slice = '1999'").count() == 0
    (tmp_path / "c.json").write_text('{"@id":"1","text":"t"}\n')
    docs, status = registry.read_sources(spark, [{"type": "openraadsinformatie", "naam": "raad", "gemeente": "g", "path": str(tmp_path / "c.json")}, {"type": "notubiz"}, {"type": "wat"}, {"type": "tabel", "path": "/is/er/niet"}])
    assert [(r["bron"], r["doc_id"]) for r in docs.collect()] == [("raad", "g:1")]
    assert {r["naam"]: r["gelezen"] for r in status.collect()} == {"raad": True, "notubiz": False, "wat": False, "tabel": False}


def test_pipeline_leaves_nothing_out(spark, tmp_path):
    import json

    from lakmoes import cli
    from lakmoes.operators import incremental
    from lakmoes.sources import live

    book = tmp_path / "x.xlsx"
    sinks.write_workbook(str(book), ["k"], [["v"]])
    z = zipfile.ZipFile(book)
    parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b'sheetId="1"', b'sheetId="1" state="hidden"')
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "geheim.xlsx").write_bytes(_zip(parts))
    (tmp_path / "map" / "groot.pdf").write_bytes(b"x" * (1 << 20) + b"x")
    doc = {"Id": "d1", "FileName": "stuk.docx", "PublicDownloadURL": "https://r.nl/d1"}
    (tmp_path / "m.json").write_text(json.dumps({"Id": "m", "MeetingtypeId": "t", "MeetingItems": [{"Features": "3", "Documents": [doc]}]}) + "\n")
    (tmp_path / "t.json").write_text('{"Id":"t","Meetingtype":"Raad"}\n')
    pages = [("https://g.nl/", '<a href="/a">a</a><a href="https://elders.example/weg.pdf">x</a>'), ("https://g.nl/a", '<a href="b.PDF">b</a>'), ("https://g.nl/los", '<a href="c.pdf">c</a>')]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "paginas"))
    sources = [{"type": "map", "path": str(tmp_path / "map")}, {"type": "ibabs", "naam": "raad", "sitename": "s", "path": str(tmp_path / "m.json"), "types": str(tmp_path / "t.json"), "meetingtypes": ["raad"]}, {"type": "ibabs", "naam": "zonder"}]
    (tmp_path / "c.yaml").write_text(json.dumps({"seeds": ["https://g.nl/"], "paginas": "paginas", "max_mb": 1, "bronnen": sources}))
    assert cli.main(["--config", str(tmp_path / "c.yaml")]) == 0
    log = str(tmp_path / "output" / "log")
    read = lambda n, schema, **k: incremental.committed(spark, log, n, schema, **k)
    assert [(r["soort"], r["ernst"], os.path.basename(r["url"])) for r in read("bevindingen", cli.FOUND).collect()] == [("Verborgen tabblad", "Middel", "geheim.xlsx")]
    assert {r["naam"]: r["gelezen"] for r in read("bronnen", cli.STATUS).collect()} == {"seeds": True, "map": True, "raad": True, "zonder": False}
    rest = {os.path.basename(r["url"]): (r["bron"], r["reden"][:9]) for r in read("zonder_tekst", cli.LEFT).collect()}
    assert rest == {"b.PDF": ("seeds", ""), "d1": ("raad", ""), "groot.pdf": ("map", "too large"), "geheim.xlsx": ("map", "")} or rest == {"b.PDF": ("seeds", ""), "d1": ("raad", ""), "groot.pdf": ("map", "too large")}
    assert cli.main(["--config", str(tmp_path / "c.yaml")]) == 0 and read("bevindingen", cli.FOUND).count() == 1
    # with an opener the addresses are fetched, and a year that fails is listed
    pdf = make_pdf(b"(mail a.b@voorbeeld.nl) Tj")
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / fetch.landed_name("https://r.nl/stuk.pdf")).write_bytes(pdf)
    year = live._search_url("https://z", records.search_query("A", "2023-01-01", "2023-12-31"), 1, 100)
    (tmp_path / "web" / fetch.landed_name(year)).write_text("<r><record><itemUrl manifestation='pdf'>https://r.nl/stuk.pdf</itemUrl></record><record><itemUrl manifestation='pdf'>https://r.nl/weg.pdf</itemUrl></record></r>")
    o = {"opener": "lakmoes.sources.fetch:landed", "folder": str(tmp_path / "web")}
    (tmp_path / "d.yaml").write_text(json.dumps({"output_dir": "b", "opener": o["opener"], "opener_options": {"folder": o["folder"]}, "gemeenten": ["A"], "bronnen": [{"type": "sru", "endpoint": "https://z", **o}]}))
    assert cli.main(["--config", str(tmp_path / "d.yaml"), "--van", "2023", "--tot", "2024", "--sru-max", "100"]) == 0
    log = str(tmp_path / "b" / "log")
    assert [(r["soort"], r["url"]) for r in read("bevindingen", cli.FOUND).collect()] == [("E-mail", "https://r.nl/stuk.pdf")]
    assert [(r["url"], r["reden"]) for r in read("zonder_tekst", cli.LEFT).collect()] == [("https://r.nl/weg.pdf", "GivenUp: HTTP 404")]
    assert [(r["naam"], r["gelezen"]) for r in read("bronnen", cli.STATUS).orderBy("naam").collect()] == [("sru", True), ("sru: A", False)]
    status = registry.read_sources(spark, registry.configured(Config.of({"seeds": ["https://g.nl/"]})))[1].collect()
    assert [(r["naam"], r["gelezen"]) for r in status] == [("seeds", False)] and "landed pages" in status[0]["reden"]


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("a", None)], "url string, link string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    assert {r["url"]: r["depth"] for r in crawl.walk(seeds, edges, 2).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}
    assert [r["url"] for r in crawl.walk(seeds, edges, 8, 2).collect()] == ["a", "b"]
    p = spark.createDataFrame([("https://h.nl/geheim/x",), ("https://h.nl/geheim/open",), ("https://h.nl/x",), ("https://vrij.nl/x",)], "url string")
    r = spark.createDataFrame([("h.nl", "User-agent: *\nDisallow: /geheim\nAllow: /geheim/open\nUser-agent: anders\nDisallow: /"), ("leeg.nl", None)], "host string, txt string")
    assert {x["url"]: x["mag"] for x in crawl.robots_allows(p, r).collect()} == {"https://h.nl/geheim/x": False, "https://h.nl/geheim/open": True, "https://h.nl/x": True, "https://vrij.nl/x": True}
    u = spark.createDataFrame([("https://www.a.nl/x.PDF?q",), ("https://b.nl/x.png",), ("https://sub.a.nl/",), ("geen",)], "url string")
    assert [tuple(x) for x in u.select(crawl.allowed(F.col("url"), ["x.a.nl"]), crawl.link_class(F.col("url"))).collect()] == [(True, "file"), (False, None), (True, "page"), (False, "page")]


def test_manifest_and_sinks(spark, tmp_path):
    f = spark.createDataFrame([("u1", None, "BSN", "Kritiek", "1*", "p", "c<b>", None), ("u2", "x/y.pdf", "E-mail", "Middel", "e*", None, "c\x01", "o")], "url string, local_path string, soort string, ernst string, waarde_masked string, locatie string, context string, opmerking string")
    m = spark.createDataFrame([("u1", "gem", "Kapvergunning " + "x" * 100)], "url string, herkomst string, titel string")
    rows = manifest.report_rows(f, m)
    got = {r["url"]: r for r in rows.collect()}
    assert got["u1"]["vergunning"] == "Kapvergunning" and len(got["u1"]["onderwerp"]) == 90 and got["u2"]["gemeente"] == "" and got["u2"]["locatie"] == ""
    sinks.write_html(rows, str(tmp_path / "r.html"), 1, 2, "<i>intro</i>")
    html = (tmp_path / "r.html").read_text()
    assert "<i>intro</i>" in html and "c&lt;b&gt;" in html and "Gemeente" in html and "Middel: E-mail (1)" in html and "u2" not in html
    assert sinks.write_excel(rows, str(tmp_path / "r.xlsx")) == 2
    text = files.decode_one((tmp_path / "r.xlsx").read_bytes(), "xlsx")[1][0][1]
    assert "Ernst | Soort" in text and "\x01" not in text
    none = manifest.report_rows(f.limit(0), m.limit(0))
    sinks.write_html(none, str(tmp_path / "l.html"), 0, 0)
    assert "colspan='8'" in (tmp_path / "l.html").read_text()
    with pytest.raises(ValueError):
        sinks.append_findings(f.withColumn("waarde", F.lit("x")), str(tmp_path / "t"))
    d = spark.createDataFrame([(1, "a", "error"), (2, "a", "done"), (3, "a", "todo"), (4, None, "done"), (5, "a", "done")], "file_id long, d string, status string")
    assert sorted(tuple(r) for r in manifest.content_duplicates(d, F.col("d")).collect()) == [(3, 2), (5, 2)]


def test_stream_resumes(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "mail x@y.nl"), ("b", "niets")])
    for rows in (None, [("a", "mail x@y.nl"), ("c", "mail z@y.nl")], None):
        if rows:
            put(rows)
        resume.scan_stream(resume.documents(spark, str(tmp_path / "in"), "id string, text string"), ["id"], str(tmp_path / "out"), str(tmp_path / "chk"), chunks=None, meta=None).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_config(tmp_path):
    c = Config.of({"seeds": ["https://A.nl/x", None, ""], "toegestane_domeinen": ["b.nl"], "eigen_domeinen": ["@C.nl"], "max_pages": "7", "onbekend": 1, "detectors": {"bsn": False}}, str(tmp_path))
    assert c.toegestane_domeinen == ["a.nl", "b.nl"] and c.eigen_domeinen == ["c.nl"] and c.max_pages == 7 and c.detectors == {"bsn": False} and c.output_dir == str(tmp_path / "output")


def service(conf=None):
    """A meeting service with two types, one without public meetings, and a meeting that only the second operation gives."""
    meetings = {"m1": {"Id": "m1", "MeetingtypeId": "t1", "MeetingDate": "2024-05-06T10:00", "Documents": {"iBabsDocument": [{"Id": "d1", "FileName": "a.DOCX", "PublicDownloadURL": "https://r/d1"}, None]}}, "m2": {"Id": "m2", "MeetingtypeId": "t1", "MeetingItems": [{"Features": "3", "Documents": [{"Id": "d2", "FileName": "b", "PublicDownloadURL": "https://r/d2"}]}]}}

    def call(operation, **a):
        if operation == "GetMeetingtypes":
            return {"Status": "OK", "Meetingtypes": {"iBabsMeetingtype": [{"Id": "t1"}, {"Id": "t2"}]}}
        if operation == "GetMeetingsByMeetingtype":
            return {"Status": "OK", "Meetings": [{"Id": "m1"}, {"Id": "m2"}, {"Id": "m1"}]} if a["MeetingtypeId"] == "t1" else {"Status": "ERR", "Message": "No public meetings"}
        if operation == "GetMeetingsChangedSince":
            return {"Status": "OK", "MeetingHeaders": [{"MeetingId": "m2", "MeetingtypeId": "t1"}, {"MeetingId": "x", "MeetingtypeId": "t2"}]}
        if operation == "GetMeetingsByPublishDateRange":
            return {"Status": "ERR", "Message": "kapot"}
        if operation == "GetMeeting":
            return {"Status": "OK", "Meeting": meetings[a["MeetingId"]]} if a["MeetingId"] == "m1" else {"Status": "ERR"}
        return {"Status": "OK", "Meeting": meetings[a["MeetingId"]]}

    return call


def test_meeting_service(spark):
    from lakmoes.sources import live

    assert live.meeting_ids(service(), "s") == ["m1", "m2"] and live.meeting_ids(service(), "s", types=["t1"], since="2024-01-01") == ["m2"]
    for bad in ({"types": ["t9"]}, {"start": "2024-01-01"}, {"since": "gisteren"}, {"types": ["t9"], "since": "2024-01-01"}):
        with pytest.raises(live.ServiceError):
            live.meeting_ids(service(), "s", **bad)
    docs, status = registry.read_sources(spark, [{"type": "ibabs", "naam": "raad", "sitename": "s", "service": "tests.test_sources:service"}])
    assert sorted((r["doc_id"], r["ext"], r["meta"]["niveau"]) for r in docs.collect()) == [("d1", "docx", "vergadering"), ("d2", "pdf", "agendapunt 3")]
    assert status.first()["gelezen"] and live.items_of({"x": 1, "y": [1, None]}) == [1] and live.items_of("a") == ["a"] and live.items_of(None) == []


def land(folder, answers):
    folder.mkdir()
    for (url, data), text in answers.items():
        (folder / fetch.landed_name(url, data)).write_text(text)


def test_paged_services(spark, tmp_path):
    from lakmoes.sources import live

    q = lambda at, n, since=None: live._search_url("https://z", records.search_query("A", since), at, n)
    rec = lambda i, more="": f"<record><title>T{i}</title><itemUrl manifestation='pdf'>https://d/{i}</itemUrl>{more}</record>"
    g = "0" * 8 + "-0000-0000-0000-" + "0" * 11
    land(tmp_path / "in", {
        (q(1, 2), None): f"<r><numberOfRecords>5</numberOfRecords>{rec(1, '<externeBijlage>k|1.pdf|exb-2024-7</externeBijlage>')}<record/><nextRecordPosition>3</nextRecordPosition></r>",
        (q(3, 2), None): f"<r>{rec(2)}<nextRecordPosition>3</nextRecordPosition></r>", (q(None, 0), None): "<r><numberOfRecords>5</numberOfRecords></r>",
        (q(1, 2, "2025-01-01"), None): "<r/>", ("https://b/exb-2024-7/1/", None): "<w><expression label='2'><manifestation label='pdf'><item label='x.pdf'/></manifestation></expression></w>",
        ("https://c/_cat/indices?format=json&h=index,docs.count", None): '[{"index":"ori_x_1"},{"index":"ori_x_2"},{"index":"ori_y_3"}]',
        ("https://c/ori_x_2/_search", '{"size": 1, "sort": ["_doc"], "query": {"exists": {"field": "text"}}}'): '{"hits":{"hits":[{"_id":"1","_source":{"text":"t"},"sort":[7]}]}}',
        ("https://c/ori_x_2/_search", '{"size": 1, "sort": ["_doc"], "query": {"exists": {"field": "text"}}, "search_after": [7]}'): '{"hits":{"hits":[]}}',
        ("https://h.nl/vji/public/motie/action=datalist/yr=2024", None): '{"rows":[{"hexkey":"k","subject":"S"}]}', ("https://h.nl/vji/public/motie/action=datalist/yr=2025", None): '[{"hexkey":"k","subject":"S"}]',
        ("https://h.nl/vji/public/motie/action=detaildata/gd=k", None): '{"x":[{"link":"/f/showdoc/1.pdf"}]}',
        ("https://p/", None): f'<a href="/Organisatie/{g}1"><b>Stad</b> A</a>', (f"https://p/Organisatie/{g}1?p=1", None): f"/Publicatie/{g}2 /Publicatie/{g}3", (f"https://p/Organisatie/{g}1?p=2", None): f"/Publicatie/{g}2",
        (f"https://p/Publicatie/{g}2", None): f'<h1>Bouw</h1><li class="document"><a href="/api-public/document/{g}4"></a><div>K.XLSX</div></li>', (f"https://p/Publicatie/{g}3", None): "<h1>Leeg</h1>",
    })
    o = {"opener": "lakmoes.sources.fetch:landed", "folder": str(tmp_path / "in")}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    opts = {**o, "endpoint": "https://z", "page_size": "2", "attachments": "https://b"}
    df = live.announcements(spark, ["A", "niet"], **opts)
    assert [(r["url"], r["titel"]) for r in df.where("slice = 'A'").orderBy("url").collect()] == [("https://b/exb-2024-7/2/pdf/x.pdf", "T1 · bijlage: k|1.pdf"), ("https://d/1", "T1"), ("https://d/2", "T2")]
    assert [r["slice"] for r in live.failed_slices(df).collect()] == ["niet"]
    assert live.announcements(spark, ["A"], "2025-01-01", **opts).count() == 3  # nothing since: all of it
    assert live.search_count(fetch.landed(o), "https://z", "A") == 5 and live.search_count(fetch.landed(o), "https://z", "B") == -1
    conf = [{"type": "openraadsinformatie", "naam": "raad", "gemeenten": ["X"], "endpoint": "https://c", "page_size": 1, **o}, {"type": "parlaeus", "naam": "m", "sites": [{"host": "h.nl"}], "modules": ["motie"], "van": 2024, "tot": 2025, **o}, {"type": "mijnpublicaties", "naam": "p", "endpoint": "https://p", "organisatie_naam": "Stad A", **o}, {"type": "sru", "naam": "z", "creators": ["niet"], "endpoint": "https://z", **o}]
    docs, status = registry.read_sources(spark, conf)
    assert sorted((r["bron"], r["doc_id"], r["url"], r["ext"], r["titel"]) for r in docs.collect()) == sorted([("raad", "X:1", None, None, ""), ("m", None, "https://h.nl/f/showdoc/1.pdf", "pdf", "S"), ("p", g + "4", f"https://p/api-public/document/{g}4", "xlsx", "Bouw - K.XLSX")])
    assert {r["naam"]: r["gelezen"] for r in status.collect()} == {"raad": True, "m": True, "p": True, "z": False}
    assert live.modules_of(fetch.landed(o), "https://h.nl/vji/public") == list(records.FALLBACK_MODULES)
