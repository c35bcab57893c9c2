"""Workbooks with one sheet, with coloured runs of text in cells (SNK-12)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_FILES = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}

#: A cell: None, a text, or runs of (text, colour as RRGGBB or '').
Cell = str | None | Sequence[tuple[str, str]]


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cell(ref: str, value: Cell) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        body = f'<t xml:space="preserve">{escape(value)}</t>'
    else:
        run = lambda t, c: f'<r>{f"<rPr><color rgb=\"FF{c}\"/></rPr>" if c else ""}<t xml:space="preserve">{escape(t)}</t></r>'
        body = "".join(run(t, c) for t, c in value)
    return f'<c r="{ref}" t="inlineStr"><is>{body}</is></c>'


def workbook(rows: Iterable[Sequence[Cell]]) -> bytes:
    """The content of an .xlsx file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _FILES.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for i, row in enumerate(rows, 1):
                f.write(f'<row r="{i}">{"".join(_cell(f"{_column(c)}{i}", v) for c, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()
