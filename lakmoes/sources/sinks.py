"""Where findings go: a table, an HTML report and a workbook. Every sink takes masked findings; raw values are refused."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Sequence
from html import escape
from xml.sax.saxutils import escape as xml_escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakmoes.functions.scalars import without_controls
from lakmoes.operators.manifest import by_kind, by_severity, has_routing, ordered, shown

BASE = (("ernst", "Ernst"), ("soort", "Soort"), ("waarde_masked", "Waarde (gemaskeerd)"), ("locatie", "Locatie"), ("url", "URL"), ("local_path", "Bestand"), ("context", "Context"), ("opmerking", "Opmerking"))
#: Rows below the header, by the format.
SHEET_ROWS = 1_048_575
EXTRA = (("gemeente", "Gemeente"), ("onderwerp", "Onderwerp"), ("vergunning", "Vergunning"))


def refuse_raw(df: DataFrame) -> None:
    """An error if findings still have raw values."""
    if "waarde" in df.columns:
        raise ValueError("raw values must be masked before a sink")


def append_findings(findings: DataFrame, path: str) -> None:
    """Append masked findings to the table at path, in folders by severity."""
    refuse_raw(findings)
    findings.write.mode("append").partitionBy("ernst").parquet(path)


def _columns(rows: DataFrame) -> list[tuple[str, str]]:
    return [*BASE, *(EXTRA if has_routing(rows) else ())]


def write_html(rows: DataFrame, path: str, n_files: int, n_pages: int, intro: str = "") -> None:
    """The report: counts by severity, the kinds of the lower ones, and each row of the higher ones. Rows come to the driver one partition at a time."""
    refuse_raw(rows)
    cols = _columns(rows)
    counts = by_severity(rows).orderBy("rang", "ernst").collect()
    kinds = by_kind(rows).orderBy("ernst", "volgorde").collect()
    top = ordered(shown(rows))
    with open(path, "w", encoding="utf-8") as f:
        f.write("<!doctype html><html lang='nl'><head><meta charset='utf-8'><title>Bevindingen</title></head><body>\n<h1>Bevindingen</h1>\n")
        f.write(intro + f"\n<p>{n_files} bestanden, {n_pages} pagina's, {sum(r['n'] for r in counts)} bevindingen</p>\n<p>" + " · ".join(f"{escape(r['ernst'] or '')}: {r['n']}" for r in counts) + "</p>\n")
        for r in kinds:
            f.write(f"<p>{escape(r['ernst'])}: {escape(r['soort'] or '')} ({r['n']})</p>\n")
        f.write("<table><tr>" + "".join(f"<th>{escape(h)}</th>" for _, h in cols) + "</tr>\n")
        n = 0
        for r in top.toLocalIterator():
            n += 1
            f.write("<tr>" + "".join(f"<td>{escape(str(r[c] or ''))}</td>" for c, _ in cols) + "</tr>\n")
        if not n:
            f.write(f"<tr><td colspan='{len(cols)}'>Geen bevindingen van deze ernst</td></tr>\n")
        f.write("</table></body></html>\n")


def _cell(column: int, row: int, text: str, style: int = 0) -> str:
    name, n = "", column + 1
    while n:
        n, k = divmod(n - 1, 26)
        name = chr(65 + k) + name
    return f'<c r="{name}{row}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{xml_escape(text[:32767])}</t></is></c>'


def write_workbook(path: str, header: Sequence[str], rows: Iterable[Sequence[str]]) -> int:
    """A workbook of one sheet, written as it comes: styled header, frozen first row. Gives the number of rows."""
    n = 1
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Bevindingen" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetFormatPr defaultRowHeight="15"/><cols><col min="1" max="20" width="24" customWidth="1"/></cols><sheetData>')
            f.write(('<row r="1">' + "".join(_cell(i, 1, h, 1) for i, h in enumerate(header)) + "</row>").encode())
            for row in rows:
                n += 1
                f.write((f'<row r="{n}">' + "".join(_cell(i, n, x or "") for i, x in enumerate(row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    return n - 1


def write_excel(rows: DataFrame, path: str) -> int:
    """All findings as a workbook on the driver, without control characters. More rows than a sheet takes are an error: the table has them all."""
    refuse_raw(rows)
    if (n := rows.count()) > SHEET_ROWS:
        raise ValueError(f"{n} findings, a sheet takes {SHEET_ROWS}; use the table of findings")
    cols = _columns(rows)
    out = ordered(rows).select(*[without_controls(F.col(c)).alias(c) for c, _ in cols])
    return write_workbook(path, [h for _, h in cols], ([r[c] for c, _ in cols] for r in out.toLocalIterator()))
