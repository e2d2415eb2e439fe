"""The queries of this subpackage, by name: (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakmoes.llm import areas, dedup, encoding, leaks, lines, packing, pii

from lakmoes.plans.stage import spread, stage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_sequences(spark: SparkSession, sf: str) -> DataFrame:
    a = lines.line_sequences(table(spark, sf, "documents"), "documents", "doc_id", "source")
    b = lines.line_sequences(table(spark, sf, "bron_document"), "bron_document", "rij_id", "bron")
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return lines.repeated_lines(p1_sequences(spark, sf)).select("tabel", "id", "regel_nr")


def p1_patterns(spark: SparkSession, sf: str) -> DataFrame:
    patterns, _ = lines.prefixspan(stage(p1_sequences(spark, sf), "p1-seqs"))
    return patterns.select("tabel", "source", "stappen", "length", "support", F.hex(F.col("p")).alias("patroon"))


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned texts of both tables, by digest."""
    docs, bron = table(spark, sf, "documents"), table(spark, sf, "bron_document")
    texts = docs.select(F.lit("documents").alias("tabel"), F.col("doc_id").alias("id"), "text").unionByName(bron.select(F.lit("bron_document").alias("tabel"), F.col("rij_id").alias("id"), "text"))
    out = lines.remove_lines(texts, lines.repeated_lines(p1_sequences(spark, sf)), "id", tabel=F.col("tabel"))
    return out.select("tabel", "id", F.col("n_weg").cast("bigint").alias("n_weg"), F.sha2("schoon", 256).alias("schoon_sha256"))


def _p2_batches(spark: SparkSession, sf: str) -> list[DataFrame]:
    """All batches but the newest, then the newest, appended to an index."""
    files, docs = table(spark, sf, "files").select("file_id", "sha256", "url", "batch_nr"), table(spark, sf, "documents").select("file_id", "text")
    newest = files.agg(F.max("batch_nr")).first()[0]
    before = files.where(F.col("batch_nr") < newest).agg(F.max("file_id")).first()[0] if newest is not None else None
    return dedup.appended(files.drop("batch_nr"), docs, (before,) if before is not None else ())


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    first, *more = _p2_batches(spark, sf)
    for m in more:
        first = first.unionByName(m)
    return first


def p2_last_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What the newest batch repeats of all before it."""
    return _p2_batches(spark, sf)[-1]


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each text and its links to other classes."""
    return dedup.linked_classes(table(spark, sf, "documents").select("file_id", "text"))


_P3 = (("documents", "doc_id", "text"), ("bron_document", "rij_id", "text"), ("files", "file_id", "titel"))


def p3_words(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = (encoding.words_of(table(spark, sf, t), t, i, x) for t, i, x in _P3)
    return a.unionByName(b).unionByName(c)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.found(p3_words(spark, sf))


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = (table(spark, sf, t).select(F.lit(t).alias("tabel"), F.col(i).cast("bigint").alias("id"), F.col(x).alias("text")) for t, i, x in _P3)
    return encoding.restore(a.unionByName(b).unionByName(c), encoding.garbled_words(p3_words(spark, sf)))


def p4_texts(spark: SparkSession, sf: str) -> DataFrame:
    bron = table(spark, sf, "bron_document")
    parts = [
        table(spark, sf, "documents").select(F.lit("documents").alias("tabel"), F.col("doc_id").alias("id"), F.lit(-1).alias("chunk_idx"), "text"),
        bron.select(F.lit("bron_document").alias("tabel"), F.col("rij_id").alias("id"), F.lit(-1).alias("chunk_idx"), "text"),
        bron.select("rij_id", F.explode("chunks").alias("c")).select(F.lit("bron_document").alias("tabel"), F.col("rij_id").alias("id"), F.col("c.idx").alias("chunk_idx"), F.col("c.text").alias("text")),
        table(spark, sf, "findings").select(F.lit("findings").alias("tabel"), F.col("finding_id").alias("id"), F.lit(-1).alias("chunk_idx"), F.col("context").alias("text")),
    ]
    out = spread(parts[0], "id")
    for p in parts[1:]:
        out = out.unionByName(spread(p, "id"))
    return out


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Account numbers are masked but have no kind of their own among the cases."""
    return pii.values(p4_texts(spark, sf)).where("soort <> 'rekening'").drop("end_pos")


def p4_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.mask(p4_texts(spark, sf))


def p3_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Texts read as Latin-1 once or twice, restored."""
    k = F.col("n_nationkey")
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    clean = F.concat(F.lit("Coöperatie Ångström in "), "n_name", F.lit(" – één café"))
    t = table(spark, sf, "nation").select(F.lit("t").alias("tabel"), k.cast("bigint").alias("id"), F.when(k % 3 == 0, clean).when(k % 3 == 1, wrong(clean)).otherwise(wrong(wrong(clean))).alias("text"))
    return encoding.restore(t, encoding.garbled_words(encoding.words_of(t, "t", "id", "text"))).select("id", "hersteld", "n_verloren")


def p4_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Values of every kind in one sentence, masked."""
    k = F.col("c_custkey")
    n = F.lpad((k * 7919 % 10**10).cast("string"), 10, "0")
    check = F.lpad((98 - F.concat(F.lit("10112310"), n, F.lit("232100")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    iban = F.concat(F.lit("NL"), check, F.when(k % 2 == 0, F.lit("ABNA")).otherwise(F.lit(" ABNA ")), n)
    mail = F.concat(F.repeat(F.lit("a"), (k % 200 + 1).cast("int")), F.when(k % 3 == 0, F.lit(" (at) ")).otherwise(F.lit("@")), F.lit("post.example"))
    t = F.concat(F.lit("Geachte heer Voorbeeld, mail "), mail, F.lit(" of bel 06-"), F.lpad((k * 31 % 10**8).cast("string"), 8, "0"), F.lit(", rekening "), iban, F.lit("; Dorpsstraat "), (k % 200 + 1).cast("string"), F.lit(", 2311 EG Leiden. Kenmerk "), k.cast("string"), F.lit("."))
    texts = table(spark, sf, "customer").select(F.lit("customer").alias("tabel"), k.cast("bigint").alias("id"), F.lit(-1).alias("chunk_idx"), t.alias("text"))
    return pii.mask(texts).select("id", "gemaskeerd", "n_waarden")


def p8_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The labels that rules are taught from, spelt as the areas."""
    return areas.clean_labels(table(spark, sf, "area_labels"), table(spark, sf, "areas"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.was_split(p6_pack(spark, sf))


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.sizes(table(spark, sf, "documents"), table(spark, sf, "bakken")))


def p6_room(spark: SparkSession, sf: str) -> DataFrame:
    return packing.room_left(p6_pack(spark, sf))


def p6_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Packing under limits that bind, held against what has to hold: at most six documents, and half the attention of one text of full length. All documents are packed, those above the capacity of attention in pieces; the SQL counts the others only."""
    cap, t = F.col("capaciteit"), F.col("tokens")
    bins = table(spark, sf, "bakken").select("capaciteit", F.lit(6).alias("max_documenten"), (cap.cast("double") * cap / 2).alias("max_aandacht"))
    sized = packing.sizes(table(spark, sf, "documents"), bins)
    return packing.held(packing.pack(sized), sized, (t > cap) | (t.cast("double") * t <= cap.cast("double") * cap / 2))


def p6_held(spark: SparkSession, sf: str) -> DataFrame:
    """The packing of p6_pack, held against what has to hold."""
    sized = packing.sizes(table(spark, sf, "documents"), table(spark, sf, "bakken"))
    return packing.held(packing.pack(sized), sized)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    hits = leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return hits.groupBy("item_id").agg(F.count("*").alias("documenten"), F.max("woorden").alias("langste"))


def p7_proximity(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.proximity(leaks.build_index(table(spark, sf, "documents")), table(spark, sf, "eval_items"))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "areas")
    blocks = areas.tokenised(table(spark, sf, "documents"), table(spark, sf, "area_labels"), names)
    return areas.assign(blocks, areas.mine(blocks, names))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("doc_id", "area")


def p8_by_source(spark: SparkSession, sf: str) -> DataFrame:
    found = _assigned(spark, sf).select(F.col("doc_id").alias("d"), "area")
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(found, F.col("doc_id") == F.col("d")).groupBy("source", "area").agg(F.count("*").alias("documenten"))


def p8_rules(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "areas")
    blocks = areas.tokenised(table(spark, sf, "documents"), table(spark, sf, "area_labels"), names)
    return areas.rule_table(blocks, areas.mine(blocks, names))


_P1 = r"""
WITH t AS (SELECT 'documents' AS tabel, source AS bron, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'bron_document', bron, rij_id, text FROM bron_document WHERE text IS NOT NULL),
l AS (SELECT tabel, bron, id, unnest(string_split(text, chr(10))) AS regel, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS regel_nr FROM t),
k AS (SELECT tabel, bron, id, regel_nr, lower(regexp_replace(regel, '[^\p{L}]', '', 'g')) AS k FROM l),
n AS (SELECT tabel, bron, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT tabel, bron, k, count(DISTINCT id) AS c FROM k WHERE length(k) >= 15 GROUP BY ALL),
r AS (SELECT g.tabel, g.bron, g.k FROM g JOIN n ON g.tabel = n.tabel AND g.bron IS NOT DISTINCT FROM n.bron WHERE c >= 3 AND c * 100 >= n.n * 15)
"""

_P7 = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
d AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw)),
i AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS w FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw))
"""

_P6 = "SELECT CAST(capaciteit AS BIGINT) AS capaciteit, count(*) AS documenten, CAST(sum(t) AS BIGINT) AS tokens, count(*) FILTER (WHERE t <= capaciteit) AS heel, 0 AS gaten, 0 AS te_vol, 0 AS te_veel, 0 AS te_duur FROM (SELECT octet_length(encode(text)) + 1 AS t FROM documents WHERE text IS NOT NULL), bakken WHERE {where} GROUP BY capaciteit"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_patterns": p1_patterns, "p1_clean": p1_clean, "p2_found": p2_found, "p2_last_batch": p2_last_batch, "p2_classes": p2_classes, "p3_found": p3_found, "p3_restored": p3_restored, "p3_derived": p3_derived, "p4_found": p4_found, "p4_masked": p4_masked, "p4_derived": p4_derived, "p6_found": p6_found, "p6_pack": p6_pack, "p6_room": p6_room, "p6_limits": p6_limits, "p6_held": p6_held, "p7_found": p7_found, "p7_items": p7_items, "p7_proximity": p7_proximity, "p8_found": p8_found, "p8_by_source": p8_by_source, "p8_rules": p8_rules, "p8_labels": p8_labels}

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT k.tabel, k.id, CAST(regel_nr AS INTEGER) AS regel_nr FROM k JOIN r ON k.tabel = r.tabel AND k.bron IS NOT DISTINCT FROM r.bron AND k.k = r.k",
    "p1_clean": _P1 + """, d AS (SELECT l.tabel, l.id, list(l.regel ORDER BY l.regel_nr) FILTER (WHERE r.k IS NULL) AS over_, count(r.k) AS n_weg FROM l JOIN k ON l.tabel = k.tabel AND l.id = k.id AND l.regel_nr = k.regel_nr
LEFT JOIN r ON k.tabel = r.tabel AND k.bron IS NOT DISTINCT FROM r.bron AND k.k = r.k GROUP BY l.tabel, l.id),
a AS (SELECT 'documents' AS tabel, doc_id AS id FROM documents UNION ALL SELECT 'bron_document', rij_id FROM bron_document)
SELECT a.tabel, a.id, coalesce(n_weg, 0) AS n_weg, CASE WHEN d.id IS NOT NULL THEN sha256(coalesce(array_to_string(over_, chr(10)), '')) END AS schoon_sha256 FROM a LEFT JOIN d ON a.tabel = d.tabel AND a.id = d.id""",
    "p2_classes": r"""WITH w AS (SELECT file_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT file_id, hash(array_to_string(w[k:k+4], ' ')) AS s FROM (SELECT file_id, w, unnest(range(1, len(w) - 3)) AS k FROM w)),
c AS (SELECT file_id, min(file_id) OVER (PARTITION BY z, n) AS klasse, n FROM (SELECT file_id, count(*) AS n, sum(s::HUGEINT) AS z FROM s GROUP BY file_id)),
r AS (SELECT s.file_id AS k, s.s, n FROM s JOIN c USING (file_id) WHERE c.klasse = c.file_id),
p AS (SELECT a.k AS a, b.k AS b FROM r a JOIN r b ON a.s = b.s AND a.k < b.k AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 7 GROUP BY a.k, b.k, a.n, b.n HAVING count(*) * 10 >= (a.n + b.n - count(*)) * 7),
l AS (SELECT k, count(*) AS m FROM (SELECT a AS k FROM p UNION ALL SELECT b FROM p) GROUP BY k)
SELECT file_id, klasse, coalesce(m, 0) AS buren FROM c LEFT JOIN l ON l.k = c.klasse""",
    "p6_found": "SELECT CAST(capaciteit AS BIGINT) AS capaciteit, doc_id FROM documents, bakken WHERE octet_length(encode(text)) + 1 > capaciteit",
    "p3_derived": "SELECT n_nationkey AS id, 'Coöperatie Ångström in ' || n_name || ' – één café' AS hersteld, 0 AS n_verloren FROM nation WHERE n_nationkey % 3 > 0",
    "p4_derived": "SELECT c_custkey AS id, 'Geachte heer [NAAM], mail [EMAIL] of bel [TELEFOON], rekening [REKENING]; [ADRES]. Kenmerk ' || c_custkey || '.' AS gemaskeerd, 5 AS n_waarden FROM customer",
    "p8_labels": r"SELECT DISTINCT doc_id, a.area FROM area_labels l JOIN areas a ON regexp_replace(lower(trim(regexp_replace(l.area, '[\s\x{A0}]+', ' ', 'g'))), '[ _\-]+', '_', 'g') = regexp_replace(lower(trim(a.area)), '[ _\-]+', '_', 'g') WHERE doc_id IS NOT NULL",
    "p6_held": _P6.format(where="1 = 1"),
    "p6_limits": _P6.format(where="t > capaciteit OR CAST(t AS DOUBLE) * t <= CAST(capaciteit AS DOUBLE) * capaciteit / 2"),
    "p7_found": _P7 + "SELECT DISTINCT doc_id, item_id FROM d JOIN i ON d.w = i.w",
}
