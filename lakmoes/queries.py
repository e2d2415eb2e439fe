"""The queries of the core, by name: (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakmoes import source_queries, source_sql
from lakmoes.functions import scalars as S
from lakmoes.functions.urls import normal_digest, normal_key, normal_status, normal_url
from lakmoes.operators import crawl, detectors, incremental, manifest
from lakmoes.plans.stage import stage_path
from lakmoes.sources import records
from lakmoes.streaming import resume


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs on one log: one up to the batch before the newest, then one over what came after it, merged with the state; gives the work list that the second has committed."""
    t = {n: table(spark, sf, n) for n in ("files", "bron_document", "text_done", "runs")}
    root = stage_path(spark, "p5-runs")
    newest = t["files"].agg(F.max("batch_nr")).first()[0] or 0
    most = {"files": incremental.upper_bound(t["files"].where(F.col("batch_nr") < newest), "file_id"), "bron_document": incremental.upper_bound(t["bron_document"], "rij_id") * 39 // 40}
    for bounds in (most, None):
        run, outputs = incremental.next_run(spark, root, t["files"], t["bron_document"], t["text_done"], t["runs"], bounds)
        run.commit(outputs)
    return incremental.committed(spark, root, "werk", "tabel string, id long", last=True)


def p5_runs(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, commit): which commit delivered each row of files, over five runs of which one fails when it has written and one is overtaken by a rival."""
    files = table(spark, sf, "files").select("file_id", "batch_nr")
    root = stage_path(spark, "p5-log")
    bound = lambda k: {"files": incremental.upper_bound(files.where(F.col("batch_nr") <= k), "file_id")}

    def opened(k: int | None) -> incremental.IncrementalRun:
        return incremental.open_run(spark, root, {"files": (files, "file_id")}, bound(k) if k else None)

    def rows(run: incremental.IncrementalRun) -> DataFrame:
        return run.arrived("files", files, "file_id").select("file_id", F.lit(run.base + 1).alias("commit"))

    first = opened(10)
    first.commit({"rijen": rows(first)})
    broken = opened(20)
    broken.write({"rijen": rows(broken)})  # and ends there, before its marker
    slow, rival = opened(20), opened(30)
    rival.commit({"rijen": rows(rival)})
    try:
        slow.commit({"rijen": rows(slow)})
    except incremental.Overtaken:
        pass
    rest = opened(None)
    rest.commit({"rijen": rows(rest)})
    return incremental.committed(spark, root, "rijen", "file_id long, commit int")


def _digits(c: str, factor: int, n: int) -> Column:
    return F.lpad((F.col(c) * factor % 10**n).cast("string"), n, "0")


def _scan(df: DataFrame, key: str, only: str, own: tuple[str, ...] = ()) -> DataFrame:
    """Findings of one detector in a derived text."""
    on = {d.key: d.key == only for d in detectors.detectors()}
    return detectors.scan_documents(df, [key], own, on, chunks=None, meta=None)


def elfproef_valid(spark: SparkSession, sf: str) -> DataFrame:
    d = _digits("c_custkey", 123457, 9)
    return table(spark, sf, "customer").select("c_custkey", d.alias("nummer"), S.valid_bsn(d).alias("geldig"))


def iban_mod97(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat(F.lit("NL"), _digits("c_custkey", 31, 2), F.lit("ABNA"), _digits("c_custkey", 7919, 10))
    return table(spark, sf, "customer").select("c_custkey", v.alias("iban"), S.valid_iban_nl(v).alias("geldig"))


def mask_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("file_id", S.mask(F.col("url")).alias("url_masked"), S.mask(F.col("ext")).alias("ext_masked"), S.mask(F.left("url", F.lit(7))).alias("kort_masked"))


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders")
    day = [(F.col("o_orderkey") * k % m).cast("int") for k, m in ((7, 35), (5, 14))]
    return d.select(
        "o_orderkey",
        S.valid_date(day[0], day[1], F.year("o_orderdate")).alias("datum_ok"),
        S.html_escaped(F.concat(F.lit("<b>"), "o_orderpriority", F.lit("&'\""))).alias("html"),
        S.without_controls(F.concat("o_orderstatus", F.lit("\x01\x0b"), F.lit("x"))).alias("schoon"),
        S.first_filled(F.when(F.col("o_orderkey") % 2 == 0, F.lit("")), F.col("o_orderstatus")).alias("eerste"),
        S.own_domain(F.concat(F.lit("a@"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("Sub.")).otherwise(F.lit("")), F.lit("Eigen.nl"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.lit(""))), ["@eigen.nl"]).alias("eigen"),
    )


def files_normal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("file_id", normal_url(F.col("url")).alias("adres"), normal_digest(F.col("sha256")).alias("digest"), normal_status(F.col("status")).alias("toestand"))


def email_hits(spark: SparkSession, sf: str) -> DataFrame:
    f = _scan(table(spark, sf, "documents"), "doc_id", "email")
    return f.groupBy("doc_id", "waarde_masked").agg(F.count("*").alias("n"))


def email_own_domain_grade(spark: SparkSession, sf: str) -> DataFrame:
    f = _scan(table(spark, sf, "documents"), "doc_id", "email", ("zolder.invalid", "mijnmail.test"))
    return f.groupBy("doc_id", "ernst").agg(F.count("*").alias("n"))


_BSN_TEXTS = ("burgerservicenummer {} hoort erbij", "tel: {} is bereikbaar", "Artikel {} van de verordening", "Situatietekening: {} in de bijlage", "Er staat {} in het stuk", "een bedrag van € {} is betaald", "zie rapport.pdf en {} daarin")
_BSN_GRADES = ("Kritiek", "Laag", "Laag", "Laag", "Kritiek", "Laag", "Laag")


def _by_key(texts: tuple[str, ...], key: Column, value: Column) -> Column:
    out = None
    for i, t in enumerate(texts):
        a, b = t.split("{}")
        c = F.concat(F.lit(a), value, F.lit(b))
        out = F.when(key % len(texts) == i, c) if out is None else out.when(key % len(texts) == i, c)
    return out


def bsn_context_grade(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "customer").select("c_custkey", _by_key(_BSN_TEXTS, F.col("c_custkey"), _digits("c_custkey", 123457, 9)).alias("text"))
    return _scan(d, "c_custkey", "bsn").select("c_custkey", "ernst", "waarde_masked")


_IBAN_TEXTS = ("kvk 12345678, rekening {} graag", "mijn rekening {} graag", "factuur met btw en {} erbij")


def iban_business_grade(spark: SparkSession, sf: str) -> DataFrame:
    n = _digits("c_custkey", 7919, 10)
    # ABNA is 10112310, NL is 2321; the check digits make the whole 1 by 97
    check = F.lpad((98 - F.concat(F.lit("10112310"), n, F.lit("232100")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    v = F.concat(F.lit("NL"), check, F.lit(" ABNA "), F.left(n, F.lit(4)), F.lit(" "), F.substring(n, 5, 4), F.lit(" "), F.right(n, F.lit(2)))
    d = table(spark, sf, "customer").select("c_custkey", _by_key(_IBAN_TEXTS, F.col("c_custkey"), v).alias("text"))
    return _scan(d, "c_custkey", "iban").select("c_custkey", "soort", "ernst", "waarde_masked")


_PHONE_TEXTS = ("bel +31 6{} nu", "bel 071-{} nu", "zaak 9{} loopt", "bel 06{}1 nu")


def phone_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("k"), _digits("c_custkey", 7919, 8).alias("a"), _digits("c_custkey", 7919, 7).alias("b"))
    t = F.when(F.col("k") == 0, F.concat(F.lit("bel +31 6"), "a", F.lit(" nu"))).when(F.col("k") == 1, F.concat(F.lit("bel 071-"), "b", F.lit(" nu"))).when(F.col("k") == 2, F.concat(F.lit("zaak 9"), "a", F.lit(" loopt"))).otherwise(F.concat(F.lit("bel 06"), "a", F.lit(" nu")))
    return _scan(d.select("c_custkey", t.alias("text")), "c_custkey", "telefoon").select("c_custkey", "soort", "ernst", "waarde_masked")


def birthdate_grade(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("geboren op ")).otherwise(F.lit("besproken op ")), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" te Leiden"))
    return _scan(table(spark, sf, "orders").select("o_orderkey", t.alias("text")), "o_orderkey", "geboortedatum").select("o_orderkey", "ernst", "waarde_masked")


_NAW_TEXTS = ("Dorpsstraat 12, {} Leiden", "Postbus 9100, {} Leiden", "het stuk {} zonder meer", "{}, nr 14")


def _postcode(key: str) -> Column:
    return F.concat((F.col(key) * 37 % 9000 + 1000).cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("EG", "SA", "en", "BZ", "kw")]), (F.col(key) % 5 + 1).cast("int")))


def naw_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "customer").select("c_custkey", _by_key(_NAW_TEXTS, F.col("c_custkey"), _postcode("c_custkey")).alias("text"))
    c = detectors.chunked(d, ["c_custkey"], chunks=None, meta=None)
    on = {x.key: x.key == "naw" for x in detectors.detectors()}
    return detectors.masked(detectors.scan(c, ["c_custkey"], on)).select("c_custkey", "ernst", "waarde_masked")


def postcode_filter(spark: SparkSession, sf: str) -> DataFrame:
    v = _postcode("p_partkey")
    return table(spark, sf, "part").select("p_partkey", v.alias("postcode"), S.postcode_ok(v).alias("geldig"))


_NAME_TEXTS = ("Geachte heer B. van der {}, uw brief", "mevrouw {} woont aan Straat 1, 2311 EG Leiden", "De Heer {} zegene u", "Dhr. {} via Postbus 9100, 2300 PC Leiden")


def person_name_grade(spark: SparkSession, sf: str) -> DataFrame:
    name = F.initcap(F.translate(_digits("c_custkey", 7919, 6), "0123456789", "abcdefghij"))
    d = table(spark, sf, "customer").select("c_custkey", _by_key(_NAME_TEXTS, F.col("c_custkey"), name).alias("text"))
    return _scan(d, "c_custkey", "persoonsnaam").select("c_custkey", "ernst", "waarde_masked")


_ID_TEXTS = ("paspoort {} is kwijt", "document {} is kwijt", "Documentnummer: {}.RAP003 hoort erbij", "rijbewijs nr. {} ingeleverd")


def passport_grade(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "customer").select("c_custkey", _by_key(_ID_TEXTS, F.col("c_custkey"), F.concat(F.lit("XK"), _digits("c_custkey", 7919, 7))).alias("text"))
    return _scan(d, "c_custkey", "paspoort_rijbewijs").select("c_custkey", "ernst", "waarde_masked")


def subject_address_regrade(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_linenumber <= 7").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    chunk = F.struct(F.col("l_linenumber").alias("idx"), F.concat(F.lit("pagina "), "l_linenumber").alias("loc"), F.concat(F.lit("Straat 1, "), (F.col("p") % 3 + 2311).cast("string"), F.lit(" EG")).alias("text"))
    d = li.groupBy("l_orderkey").agg(F.collect_list(chunk).alias("chunks")).withColumn("text", F.lit(None).cast("string"))
    on = {x.key: x.key == "naw" for x in detectors.detectors()}
    return detectors.scan_documents(d, ["l_orderkey"], (), on, meta=None).select("l_orderkey", "chunk_idx", "ernst", "waarde_masked")


def snippet_redact(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.scan_documents(table(spark, sf, "bron_document"), ["rij_id"]).select("rij_id", "chunk_idx", "start", "soort", "ernst", "context")


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = detectors.scan_documents(table(spark, sf, "documents"), ["doc_id"], chunks=None, meta=None)
    return f.groupBy("soort", "ernst").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documenten"))


def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.by_severity(table(spark, sf, "findings"))


def findings_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.by_kind(table(spark, sf, "findings"))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.first_by_key(table(spark, sf, "files").select("url", "file_id", "herkomst", "titel"), ["url"], "file_id")


def manifest_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf)


def findings_left_join_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.with_manifest(table(spark, sf, "findings"), _manifest(spark, sf)).select("finding_id", "url", "herkomst", "titel")


def report_rows_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.ordered(manifest.report_rows(table(spark, sf, "findings"), _manifest(spark, sf)))


def permit_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("file_id", S.permit_type(F.col("titel")).alias("vergunning"))


def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files")
    return manifest.content_duplicates(f, normal_digest(F.col("sha256")), "file_id", normal_status(F.col("status")))


def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bron_document").select("rij_id", "bron", normal_key(F.col("doc_id")).alias("sleutel"))
    return manifest.unseen(d, table(spark, sf, "text_done").select("bron", normal_key(F.col("doc_id")).alias("sleutel")), ["bron", "sleutel"]).select("rij_id", "bron", "sleutel")


def metadata_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bron_document").select("rij_id", S.flat_metadata(F.col("meta")).alias("plat"))


def per_source_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bron_document").withColumn("_text", F.coalesce(F.col("text").isNotNull() | (F.size("chunks") > 0), F.lit(False)))
    hits = _scan(table(spark, sf, "bron_document"), "bron", "email")
    return manifest.per_source(d, hits, "bron", "rij_id")


def per_source_findings(spark: SparkSession, sf: str) -> DataFrame:
    """As per_source_summary, with the findings of all detectors in text, chunks and metadata; SQL can't tell those."""
    d = table(spark, sf, "bron_document")
    with_text = d.withColumn("_text", F.coalesce(F.col("text").isNotNull() | (F.size("chunks") > 0), F.lit(False)))
    hits = detectors.scan_documents(d, ["bron", "rij_id"]).select("bron").unionByName(detectors.hidden_sheets(d, ["bron"]).select("bron"))
    return manifest.per_source(with_text, hits, "bron", "rij_id")


def capped_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.capped(table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


def slice_cross_join(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.slices(table(spark, sf, "region").select("r_name"), 2019, 2025)


def newest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "orders").select(F.concat(F.lit("ori_plaats"), (F.col("o_custkey") % 20).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("index"))
    return records.newest_snapshot(i)


def events_per_type(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("MeetingtypeId"))
    t = e.distinct().select(F.col("MeetingtypeId").alias("Id"), F.upper("MeetingtypeId").alias("Meetingtype"))
    return records.meetings_per_type(e, t)


def crawl_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("file_id", crawl.allowed(F.col("url"), ["gemeente.kromello.example", "loengasluis.example"]).alias("mag"))


def crawl_classify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("file_id", crawl.link_class(F.col("url")).alias("soort"))


def crawl_links(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(F.lit('<html><a href="'), "url", F.lit('">x</a><a name=y></a><A HREF="/vast/pad#deel">z</A><a href="mailto:a@b.nl">m</a></html>'))
    pages = table(spark, sf, "files").select(F.concat(F.lit("https://start.example/p/"), F.col("file_id")).alias("url"), html.alias("html"))
    return crawl.links(pages)


def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    to = n.select("k", F.explode(F.array(F.col("k") * 2 % 25, (F.col("k") * 3 + 1) % 25)).alias("j"))
    edges = to.select(F.concat(F.lit("p"), "k").alias("url"), F.concat(F.lit("p"), "j").alias("link"))
    return crawl.walk(n.where("k = 1").select(F.concat(F.lit("p"), "k").alias("url")), edges, 3)


def sru_records_explode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    exb = F.concat(F.lit("exb-2024-"), k)
    entry = F.when(k % 4 == 0, F.concat(F.lit("kaart|blad.pdf|"), exb)).when(k % 4 == 1, F.concat(F.lit("|"), exb)).when(k % 4 == 2, exb).otherwise(F.lit("niets.pdf|zonder"))
    r = table(spark, sf, "part").select(F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("titel"), F.array(entry).alias("externeBijlage"))
    resolved = table(spark, sf, "part").where(k % 8 == 0).select(exb.alias("exb"), F.concat(F.lit("https://opgezocht.example/"), k).alias("url"))
    return records.attachments(r, resolved)


def ori_text_preference(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = F.when(k % 3 == 0, F.array(F.struct(F.lit(4).alias("page"), F.col("o_orderpriority").alias("text"))))
    r = F.struct(k.cast("string").alias("@id"), F.col("o_orderstatus").alias("name"), F.when(k % 2 == 0, F.lit("plat")).alias("text"), F.when(k % 5 == 0, F.lit("opgemaakt")).alias("md_text"), pages.alias("text_pages"))
    raw = table(spark, sf, "orders").select(F.to_json(r).alias("json"), k.cast("string").alias("es_id"))
    d = records.council_documents(raw, "raad", "plaats")
    return d.select("doc_id", "titel", "text", F.element_at("chunks", 1)["loc"].alias("loc"), F.element_at("chunks", 1)["text"].alias("pagina"))


def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    docs = resume.documents(spark, f"{sf}/documents.parquet*", d.schema)
    out = stage_path(spark, "stream")
    resume.scan_stream(docs, ["doc_id"], f"{out}/out", f"{out}/progress", chunks=None, meta=None).awaitTermination()
    return spark.read.parquet(f"{out}/out").groupBy("soort", "ernst").agg(F.count("*").alias("n"))


_URL_SQL = r"""
url_a AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM files),
url_b AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM url_a),
url_c AS (SELECT *, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(rest, '\?(.*)$', 1) AS query FROM url_b),
url_d AS (SELECT *, CASE WHEN (scheme = 'http' AND host LIKE '%:80') OR (scheme = 'https' AND host LIKE '%:443') THEN regexp_replace(host, ':\d+$', '') ELSE host END AS host2,
  array_to_string(list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|gclid|fbclid|msclkid|dclid|gbraid|wbraid|yclid|mc_eid|mc_cid|igshid|_ga|_gl)(=|$)')), lambda p: url_decode(p))), '&') AS params FROM url_c),
url_n AS (SELECT * EXCLUDE (u, scheme, rest, host, path, query, host2, params),
  CASE WHEN u IS NULL THEN chr(0) || file_id WHEN scheme = '' THEN u ELSE host2 || url_decode(path) || CASE WHEN params <> '' THEN '?' || params ELSE '' END END AS adres,
  CASE WHEN regexp_matches(dg, '^[0-9a-f]{64}$') AND dg <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' THEN dg END AS digest
  FROM (SELECT *, regexp_replace(regexp_replace(lower(sha256), '^\s*sha-?256\s*[:=]?', ''), '[\s:_-]+', '', 'g') AS dg FROM url_d))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": p5_found,
    "p5_runs": p5_runs,
    "elfproef_valid": elfproef_valid,
    "iban_mod97": iban_mod97,
    "mask_values": mask_values,
    "scalar_functions": scalar_functions,
    "files_normal": files_normal,
    "email_hits": email_hits,
    "email_own_domain_grade": email_own_domain_grade,
    "bsn_context_grade": bsn_context_grade,
    "iban_business_grade": iban_business_grade,
    "phone_hits": phone_hits,
    "birthdate_grade": birthdate_grade,
    "naw_hits": naw_hits,
    "postcode_filter": postcode_filter,
    "person_name_grade": person_name_grade,
    "passport_grade": passport_grade,
    "subject_address_regrade": subject_address_regrade,
    "snippet_redact": snippet_redact,
    "scan_summary": scan_summary,
    "findings_by_severity": findings_by_severity,
    "findings_by_kind": findings_by_kind,
    "manifest_first_wins": manifest_first_wins,
    "findings_left_join_manifest": findings_left_join_manifest,
    "report_rows_ranked": report_rows_ranked,
    "permit_type": permit_type,
    "content_dedup": content_dedup,
    "resume_anti_join": resume_anti_join,
    "metadata_flatten": metadata_flatten,
    "per_source_summary": per_source_summary,
    "per_source_findings": per_source_findings,
    "capped_per_source": capped_per_source,
    "slice_cross_join": slice_cross_join,
    "newest_snapshot": newest_snapshot,
    "events_per_type": events_per_type,
    "crawl_allowed": crawl_allowed,
    "crawl_classify": crawl_classify,
    "crawl_links": crawl_links,
    "crawl_bfs": crawl_bfs,
    "sru_records_explode": sru_records_explode,
    "ori_text_preference": ori_text_preference,
    "stream_scan": stream_scan,
}

QUERIES |= source_queries.QUERIES


def _case(texts: tuple[str, ...], key: str, value: str) -> str:
    """The SQL for a text by key."""
    return "CASE " + " ".join(f"WHEN {key} % {len(texts)} = {i} THEN '{a}' || {value} || '{b}'" for i, (a, b) in enumerate(t.replace("'", "''").split("{}") for t in texts)) + " END"


def _d(key: str, factor: int, n: int) -> str:
    return f"lpad(CAST({key} * {factor} % {10**n} AS VARCHAR), {n}, '0')"


_ELF = "list_sum(list_transform(range(1, 10), lambda i: CAST(substr(d, i, 1) AS INTEGER) * [9, 8, 7, 6, 5, 4, 3, 2, -1][i])) % 11 = 0 AND d <> '000000000'"


def _m(v: str) -> str:
    return f"CASE WHEN length({v}) = 0 THEN '' WHEN length({v}) <= 4 THEN left({v}, 1) || repeat('*', length({v}) - 1) WHEN length({v}) <= 8 THEN left({v}, 1) || repeat('*', length({v}) - 2) || right({v}, 1) ELSE left({v}, 2) || repeat('*', length({v}) - 4) || right({v}, 2) END"


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_RANK = "CASE ernst WHEN 'Kritiek' THEN 0 WHEN 'Hoog' THEN 1 WHEN 'Middel' THEN 2 WHEN 'Laag' THEN 3 ELSE 9 END"
_PERMIT = "CASE " + " ".join(f"WHEN contains(lower(titel), '{w}') THEN '{v}'" for w, v in S.PERMITS) + " ELSE '' END"
_PC = "CAST({k} * 37 % 9000 + 1000 AS VARCHAR) || ' ' || ['EG', 'SA', 'en', 'BZ', 'kw'][{k} % 5 + 1]"
_PC_OK = "(upper(right(v, 2)) NOT IN ('SA', 'SD', 'SS') AND (regexp_matches(v, '[A-Z]{2}$') OR (right(v, 2) <> 'en' AND CAST(left(v, 4) AS INTEGER) NOT BETWEEN 1900 AND 2099)))"
_FIRST = "first_m AS (SELECT url, min(file_id) AS file_id, arg_min(struct_pack(h := herkomst), file_id).h AS herkomst, arg_min(struct_pack(t := titel), file_id).t AS titel FROM files GROUP BY url)"
_REPORT = "coalesce(f.url, '') AS url, coalesce(local_path, '') AS local_path, coalesce(soort, '') AS soort, coalesce(ernst, '') AS ernst, coalesce(waarde_masked, '') AS waarde_masked, coalesce(locatie, '') AS locatie, coalesce(context, '') AS context, coalesce(opmerking, '') AS opmerking, coalesce(herkomst, '') AS gemeente, left(coalesce(titel, ''), 90) AS onderwerp"

SQL: dict[str, str] = {
    "p5_runs": "SELECT file_id, CASE WHEN file_id <= (SELECT max(file_id) FROM files WHERE batch_nr <= 10) THEN 0 WHEN file_id <= (SELECT max(file_id) FROM files WHERE batch_nr <= 30) THEN 1 ELSE 2 END AS commit FROM files",
    "elfproef_valid": f"SELECT c_custkey, d AS nummer, {_ELF} AS geldig FROM (SELECT c_custkey, {_d('c_custkey', 123457, 9)} AS d FROM customer)",
    "iban_mod97": f"SELECT c_custkey, 'NL' || c || 'ABNA' || n AS iban, CAST('10112310' || n || '2321' || c AS HUGEINT) % 97 = 1 AS geldig FROM (SELECT c_custkey, {_d('c_custkey', 31, 2)} AS c, {_d('c_custkey', 7919, 10)} AS n FROM customer)",
    "mask_values": f"SELECT file_id, {_m('url')} AS url_masked, {_m('ext')} AS ext_masked, {_m('left(url, 7)')} AS kort_masked FROM files",
    "scalar_functions": r"""SELECT o_orderkey, (o_orderkey * 7 % 35 BETWEEN 1 AND 31 AND o_orderkey * 5 % 14 BETWEEN 1 AND 12 AND year(o_orderdate) BETWEEN 1900 AND 2025) AS datum_ok, '&lt;b&gt;' || o_orderpriority || '&amp;&#x27;&quot;' AS html, o_orderstatus || 'x' AS schoon, o_orderstatus AS eerste, o_orderkey % 5 <> 0 AS eigen FROM orders""",
    "files_normal": "WITH " + _URL_SQL + r" SELECT file_id, adres, digest, coalesce(nullif(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), ''), 'todo') AS toestand FROM url_n",
    "email_hits": f"SELECT doc_id, {_m('v')} AS waarde_masked, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents) GROUP BY ALL",
    "email_own_domain_grade": f"SELECT doc_id, CASE WHEN d IN ('zolder.invalid', 'mijnmail.test') OR d LIKE '%.zolder.invalid' OR d LIKE '%.mijnmail.test' THEN 'Laag' ELSE 'Middel' END AS ernst, count(*) AS n FROM (SELECT doc_id, lower(split_part(unnest(regexp_extract_all(text, '{_EMAIL}')), '@', 2)) AS d FROM documents) GROUP BY ALL",
    "bsn_context_grade": f"SELECT c_custkey, {list(_BSN_GRADES)}[c_custkey % {len(_BSN_TEXTS)} + 1] AS ernst, {_m('d')} AS waarde_masked FROM (SELECT c_custkey, {_d('c_custkey', 123457, 9)} AS d FROM customer) WHERE {_ELF}",
    "iban_business_grade": f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'IBAN' ELSE 'IBAN (zakelijk)' END AS soort, CASE WHEN c_custkey % 3 = 1 THEN 'Hoog' ELSE 'Laag' END AS ernst, {_m('v')} AS waarde_masked FROM (SELECT c_custkey, 'NL' || lpad(CAST(98 - CAST('10112310' || n || '232100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || ' ABNA ' || left(n, 4) || ' ' || substr(n, 5, 4) || ' ' || right(n, 2) AS v FROM (SELECT c_custkey, {_d('c_custkey', 7919, 10)} AS n FROM customer))",
    "phone_hits": f"""WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, {_d('c_custkey', 7919, 8)} AS a, {_d('c_custkey', 7919, 7)} AS b FROM customer),
r AS (SELECT c_custkey, 'Telefoon (mobiel)' AS soort, 'Middel' AS ernst, CASE k WHEN 0 THEN '+31 6' || a ELSE '06' || a END AS v FROM c WHERE k IN (0, 3)
UNION ALL SELECT c_custkey, 'Telefoon (vast)', 'Laag', CASE k WHEN 1 THEN '071-' || b ELSE '06' || a END FROM c WHERE k IN (1, 3))
SELECT c_custkey, soort, ernst, {_m('v')} AS waarde_masked FROM r""",
    "birthdate_grade": f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Hoog' ELSE 'Laag' END AS ernst, {_m('v')} AS waarde_masked FROM (SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS v FROM orders WHERE year(o_orderdate) BETWEEN 1900 AND 2025)",
    "naw_hits": f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'Laag' ELSE 'Middel' END AS ernst, {_m('v')} AS waarde_masked FROM (SELECT c_custkey, {_PC.format(k='c_custkey')} AS v FROM customer) WHERE c_custkey % 4 <> 2 AND {_PC_OK}",
    "postcode_filter": f"SELECT p_partkey, v AS postcode, {_PC_OK} AS geldig FROM (SELECT p_partkey, {_PC.format(k='p_partkey')} AS v FROM part)",
    "person_name_grade": f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'Hoog' ELSE 'Middel' END AS ernst, {_m('v')} AS waarde_masked FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'B. van der ' ELSE '' END || upper(left(n, 1)) || substr(n, 2) AS v FROM (SELECT c_custkey, translate({_d('c_custkey', 7919, 6)}, '0123456789', 'abcdefghij') AS n FROM customer WHERE c_custkey % 4 <> 2))",
    "passport_grade": f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'Laag' ELSE 'Kritiek' END AS ernst, {_m('v')} AS waarde_masked FROM (SELECT c_custkey, 'XK' || {_d('c_custkey', 7919, 7)} AS v FROM customer WHERE c_custkey % 4 <> 1)",
    "subject_address_regrade": "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) % 3 AS p FROM lineitem WHERE l_linenumber <= 7 GROUP BY ALL), f AS (SELECT l_orderkey, arg_min(p, l_linenumber) AS p1 FROM l GROUP BY ALL) SELECT l_orderkey, l_linenumber AS chunk_idx, CASE WHEN p = p1 THEN 'Laag' ELSE 'Middel' END AS ernst, '2*****G' AS waarde_masked FROM l JOIN f USING (l_orderkey)",
    "findings_by_severity": f"SELECT ernst, {_RANK} AS rang, count(*) AS n FROM findings GROUP BY ernst",
    "findings_by_kind": "SELECT ernst, soort, n, CAST(row_number() OVER (PARTITION BY ernst ORDER BY n DESC, soort NULLS FIRST) AS INTEGER) AS volgorde FROM (SELECT ernst, soort, count(*) AS n FROM findings WHERE ernst IN ('Middel', 'Laag') GROUP BY ALL)",
    "manifest_first_wins": f"WITH {_FIRST} SELECT url, file_id, herkomst, titel FROM first_m",
    "findings_left_join_manifest": f"WITH {_FIRST} SELECT finding_id, f.url, herkomst, titel FROM findings f LEFT JOIN first_m m ON f.url = m.url",
    "report_rows_ranked": f"WITH {_FIRST} SELECT {_REPORT}, {_PERMIT} AS vergunning, {_RANK} AS rang FROM findings f LEFT JOIN first_m m ON f.url = m.url",
    "permit_type": f"SELECT file_id, {_PERMIT} AS vergunning FROM files",
    "content_dedup": "WITH " + _URL_SQL + r", d AS (SELECT digest, min(file_id) AS eerste FROM url_n WHERE digest IS NOT NULL AND lower(trim(status)) = 'done' GROUP BY digest) SELECT file_id, eerste FROM url_n JOIN d USING (digest) WHERE file_id > eerste",
    "resume_anti_join": r"SELECT rij_id, bron, lower(regexp_replace(doc_id, '\s+', '', 'g')) AS sleutel FROM bron_document b WHERE NOT EXISTS (SELECT 1 FROM text_done t WHERE t.bron = b.bron AND lower(regexp_replace(t.doc_id, '\s+', '', 'g')) = lower(regexp_replace(b.doc_id, '\s+', '', 'g')))",
    "metadata_flatten": "SELECT rij_id, nullif(array_to_string(list_transform(list_sort(list_filter(map_entries(meta), lambda e: e.value <> '')), lambda e: e.key || ': ' || e.value), chr(10)), '') AS plat FROM bron_document",
    "per_source_summary": f"WITH h AS (SELECT bron, sum(len(regexp_extract_all(text, '{_EMAIL}'))) AS n FROM bron_document GROUP BY bron) SELECT bron, count(*) FILTER (WHERE NOT (text IS NOT NULL OR coalesce(len(chunks), 0) > 0)) AS n_url, count(*) FILTER (WHERE text IS NOT NULL OR coalesce(len(chunks), 0) > 0) AS n_tekst, CAST(coalesce(any_value(h.n), 0) AS BIGINT) AS n_hit FROM bron_document JOIN h USING (bron) GROUP BY bron",
    "capped_per_source": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5",
    "slice_cross_join": "SELECT r_name, CAST(unnest(range(2019, 2026)) AS INTEGER) AS jaar FROM region",
    "newest_snapshot": "SELECT 'plaats' || (o_custkey % 20) AS gemeente, max('ori_plaats' || (o_custkey % 20) || '_' || strftime(o_orderdate, '%Y%m%d')) AS \"index\" FROM orders GROUP BY ALL",
    "events_per_type": 'SELECT event_type AS "MeetingtypeId", count(*) AS n, upper(event_type) AS "Meetingtype" FROM events GROUP BY ALL',
    "crawl_allowed": r"SELECT file_id, (h LIKE '%.kromello.example' OR h = 'kromello.example' OR h LIKE '%.loengasluis.example' OR h = 'loengasluis.example') AS mag FROM (SELECT file_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':\d+$', '')) AS h FROM files)",
    "crawl_classify": r"SELECT file_id, CASE WHEN e IN ('pdf', 'docx', 'xlsx', 'xlsm', 'pptx') THEN 'file' WHEN e IN ('jpg', 'jpeg', 'png', 'gif', 'css', 'js', 'svg') THEN NULL ELSE 'page' END AS soort FROM (SELECT file_id, regexp_extract(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '\.([a-z0-9]+)$', 1) AS e FROM files)",
    "crawl_links": "SELECT 'https://start.example/p/' || file_id AS url, unnest([split_part(url, '#', 1), 'https://start.example/vast/pad']) AS link FROM files",
    "crawl_bfs": "WITH RECURSIVE e AS (SELECT n_nationkey AS k, unnest([n_nationkey * 2 % 25, (n_nationkey * 3 + 1) % 25]) AS j FROM nation), w AS (SELECT 1 AS k, 0 AS depth UNION ALL SELECT e.j, w.depth + 1 FROM w JOIN e ON e.k = w.k WHERE w.depth < 3) SELECT 'p' || k AS url, min(depth) AS depth FROM w GROUP BY k",
    "sru_records_explode": "WITH p AS (SELECT p_partkey AS k, 'exb-2024-' || p_partkey AS exb, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS t FROM part WHERE p_partkey % 4 <> 3) SELECT exb, CASE WHEN k % 8 = 0 THEN 'https://opgezocht.example/' || k ELSE 'https://repository.example/exb/' || exb || '.pdf' END AS url, CASE WHEN t <> '' THEN t || ' · ' ELSE '' END || 'bijlage: ' || CASE WHEN k % 4 = 0 THEN 'kaart|blad.pdf' ELSE exb END AS titel FROM p",
    "ori_text_preference": "SELECT 'plaats:' || o_orderkey AS doc_id, o_orderstatus AS titel, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'opgemaakt' ELSE 'plat' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'pagina 4' END AS loc, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS pagina FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 2 = 0",
    "p5_found": "WITH " + _URL_SQL + r""",
good AS (SELECT DISTINCT run_id FROM runs WHERE lower(trim(uitkomst)) = 'ok'),
f AS (SELECT *, lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) AS st, row_number() OVER (PARTITION BY adres ORDER BY gezien_op DESC NULLS LAST, file_id DESC) AS rn FROM url_n),
done AS (SELECT DISTINCT adres, digest FROM f WHERE st = 'done' AND digest IS NOT NULL AND run_id IN (SELECT run_id FROM good)),
b AS (SELECT *, lower(regexp_replace(doc_id, '\s+', '', 'g')) AS sl, row_number() OVER (PARTITION BY bron, lower(regexp_replace(doc_id, '\s+', '', 'g')) ORDER BY gewijzigd_op DESC, rij_id) AS rn FROM bron_document),
m AS (SELECT bron, lower(regexp_replace(doc_id, '\s+', '', 'g')) AS sl, max(gedaan_op) AS gedaan FROM text_done WHERE run_id IN (SELECT run_id FROM good) GROUP BY ALL)
SELECT 'files' AS tabel, f.file_id AS id FROM f LEFT JOIN done USING (adres, digest) WHERE rn = 1 AND coalesce(st, 'todo') <> 'skipped' AND done.digest IS NULL
UNION ALL SELECT 'bron_document', b.rij_id FROM b LEFT JOIN m ON b.bron = m.bron AND b.sl = m.sl WHERE rn = 1 AND NOT coalesce(m.gedaan >= b.opgehaald_op, false)""",
}

SQL |= source_sql.SQL
