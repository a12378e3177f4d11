"""A minimal writer of xlsx workbooks: rows are streamed into a ZIP of OOXML parts."""

from __future__ import annotations

import itertools
import json
import math
import re
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape, quoteattr

# Styles by number, in the order of the cellXfs below.
PLAIN, HEADER, BAND, ROUNDED, ROUNDED_BAND, GOOD, BAD, TITLE, HIGH, MIDDLE, LOW = range(11)
_STYLES = """<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<numFmts count="1"><numFmt numFmtId="164" formatCode="0.00"/></numFmts>
<fonts count="3"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font><font><b/><sz val="14"/><name val="Calibri"/></font></fonts>
<fills count="7"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>%s</fills>
<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="11"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fillId="3" applyFill="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="164" fillId="3" applyNumberFormat="1" applyFill="1"/><xf fillId="4" applyFill="1"/><xf fillId="5" applyFill="1"/><xf fontId="2" applyFont="1"/>%s</cellXfs>
</styleSheet>""" % (
    "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("1F4E79", "F2F2F2", "C6EFCE", "FFC7CE", "FFEB9C")),
    "".join(f'<xf numFmtId="164" fillId="{k}" applyNumberFormat="1" applyFill="1"/>' for k in (4, 6, 5)),
)
_BAD = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uD800-\uDFFF￾￿]")
MAX_ROWS = 1_048_576


def letters(n: int) -> str:
    """Column letters: 1 is A."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v: Any, style: int) -> str:
    if v is None or v == "":
        return f'<c r="{ref}" s="{style}"/>' if style else ""
    if isinstance(v, bool):
        return f'<c r="{ref}" s="{style}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float) and math.isfinite(v):
        return f'<c r="{ref}" s="{style}"><v>{v!r}</v></c>'
    text = escape(_BAD.sub("", str(v)))
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


#: Characters that a cell holds, less room for the mark of one that goes on; counted as UTF-16 does.
MOST, MORE = 32_700, " … (goes on in sheet {})"
LONG = "Long cells"


def pieces(text: str) -> list[str]:
    """A text in stretches that a cell holds."""
    step = MOST if not text or max(text) <= "\uffff" else MOST // 2
    return [text[i : i + step] for i in range(0, len(text), step)] or [""]


_END = "</sheetData></worksheet>"


def _head(widths: Sequence[float], header: int) -> str:
    """What stands before a sheet's rows."""
    out = ['<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">']
    if header:
        out.append(f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{header}" topLeftCell="A{header + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>')
    if widths:
        out.append("<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w:g}" customWidth="1"/>' for i, w in enumerate(widths, 1)) + "</cols>")
    return "".join([*out, "<sheetData>"])


def row_xml(count: int, row: Sequence[Any], header: int = 1, band: bool = False, marks: dict[int, Callable[[Any], int | None]] | None = None) -> tuple[str, list[list[Any]]]:
    """A sheet's row of that number, and what its cells don't hold: (cell, part, text)."""
    cells, long = [], []
    for i, v in enumerate(row):
        v, style = v if isinstance(v, tuple) else (v, None)
        if style is None:
            shaded = band and count > header and (count - header) % 2 == 0
            style = HEADER if count <= header else BAND if shaded else PLAIN
            if isinstance(v, float) and count > header:
                v, style = round(v, 2), ROUNDED_BAND if shaded else ROUNDED
            if marks and i in marks and count > header:
                style = style if (mark := marks[i](v)) is None else mark
        if isinstance(v, str) and len(v) > MOST // 2 and len(parts := pieces(_BAD.sub("", v))) > 1:
            v = parts[0] + MORE.format(LONG)
            long += [[f"{letters(i + 1)}{count}", k, x] for k, x in enumerate(parts[1:], 2)]
        cells.append(_cell(f"{letters(i + 1)}{count}", v, style))
    return f'<row r="{count}">{"".join(cells)}</row>', long


class Workbook:
    """A workbook that is written as its rows come. A text that no cell holds goes on, piece by piece, in a sheet of its own."""

    def __init__(self, path: str | Path):
        self.path, self.names = Path(path), []
        self.long = tempfile.TemporaryFile("w+", encoding="utf-8")
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.zip = zipfile.ZipFile(self.path, "w", zipfile.ZIP_DEFLATED, compresslevel=1)

    def __enter__(self) -> "Workbook":
        return self

    def sheet(self, name: str, rows: Iterable[Sequence[Any]], widths: Sequence[float] = (), header: int = 1, band: bool = False, marks: dict[int, Callable[[Any], int | None]] | None = None) -> int:
        """Adds a sheet; returns its rows. The first `header` rows are styled as headers and frozen; marks maps columns
        (from 0) to the style of a value, or None; a cell may be (value, style)."""
        name, count = self._named(name), 0
        with self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w") as f:
            put = lambda s: f.write(s.encode())
            put(_head(widths, header))
            for count, row in enumerate(rows, 1):
                if count > MAX_ROWS:
                    raise ValueError(f"a sheet holds {MAX_ROWS} rows at most; write csv or parquet")
                xml, long = row_xml(count, row, header, band, marks)
                self.long.writelines(json.dumps([name, *x]) + "\n" for x in long)
                put(xml)
            put(_END)
        return count

    def rendered(self, name: str, head: Sequence[str], pieces: Iterable[bytes], long: Iterable[Sequence[Any]], widths: Sequence[float] = (), size: int = 0) -> None:
        """Adds a sheet of a header and rows that are XML already, about `size` bytes, which are copied as they come; long has the entries of
        row_xml."""
        name = self._named(name)
        with self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=size > 1 << 30) as f:
            xml, more = row_xml(1, head, 1)
            f.write((_head(widths, 1) + xml).encode())
            for piece in pieces:
                f.write(piece)
            f.write(_END.encode())
        self.long.writelines(json.dumps([name, *x]) + "\n" for x in itertools.chain(more, long))

    def _named(self, name: str) -> str:
        name = re.sub(r"[\[\]:*?/\\]", "_", name)[:31]
        base, n = name, 1
        while name.lower() in {x.lower() for x in self.names}:
            n += 1
            name = f"{base[:28]} {n}"
        self.names.append(name)
        return name

    def __exit__(self, *error: Any) -> None:
        if not self.names and error[0] is None:
            self.sheet("Data", [], header=0)
        if self.long.tell() and error[0] is None:
            self.long.seek(0)
            self.sheet(LONG, itertools.chain([["Sheet", "Cell", "Part", "Text"]], map(json.loads, self.long)))
        self.long.close()
        ids = range(1, len(self.names) + 1)
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        parts = {
            "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}styles+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}worksheet+xml"/>' for i in ids) + "</Types>",
            "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(self.names, 1)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
            + f'<Relationship Id="rId{len(self.names) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": _STYLES,
        }
        for name, text in parts.items():
            self.zip.writestr(name, text)
        self.zip.close()


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheets(path: str | Path) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [x.attrib["name"] for x in ET.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets")]  # noqa: S314


def parts_of(path: str | Path, name: str) -> list[str]:
    """A table's sheet and those it goes on in."""
    have, out = set(sheets(path)), [name]
    while (more := f"{name[:28]} {len(out) + 1}") in have:
        out.append(more)
    return out


def rows(path: str | Path, name: str) -> Iterator[list[Any]]:
    """The rows of a sheet that this module wrote, one at a time: none is kept."""
    number = sheets(path).index(name) + 1
    with zipfile.ZipFile(path) as z, z.open(f"xl/worksheets/sheet{number}.xml") as f:
        data = None
        for event, r in ET.iterparse(f, ("start", "end")):  # noqa: S314
            if event == "start":
                data = r if r.tag == f"{_NS}sheetData" else data
                continue
            if r.tag != f"{_NS}row":
                continue
            cells: dict[str, Any] = {}
            for c in r:
                x = c[0] if len(c) else None
                key = c.attrib["r"].rstrip("0123456789")
                if x is None:
                    cells[key] = None
                elif x.tag == f"{_NS}is":
                    cells[key] = x[0].text or ""
                else:
                    cells[key] = bool(int(x.text)) if c.attrib.get("t") == "b" else float(x.text)
            last = max((sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(x))) for x in cells), default=0)
            yield [cells.get(letters(k)) for k in range(1, last + 1)]
            data.clear()


def read(path: str | Path) -> dict[str, list[list[Any]]]:
    """The cells of a workbook that this module wrote, by sheet: of small ones."""
    return {name: list(rows(path, name)) for name in sheets(path)}
