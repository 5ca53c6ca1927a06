"""Text units and cells of word-processor and spreadsheet packages, and packages with new texts.

Packages are read from their bytes in Arrow batches: one row of units for a paragraph, one row of cells
for a cell. A paragraph's text is that of its own runs: text boxes in it are paragraphs for themselves,
and settings such as tab stops are no text. Rewriting puts a unit's new text into its first run and
empties its other runs; parts without a changed unit are passed on as they are. A package that can't be
read is one row with the reason in `err`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import shuffled
from .batches import pairs, schema_of, together

W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
UNITS = "doc_id long, part_no int, seq int, part string, text string, sus_ok boolean, hdr boolean, visible boolean, visible_text string, err string"
CELLS = "doc_id long, sheet string, hidden boolean, ref string, type string, text string, formula string, err string"
#: Packages in packages that are read, and how deep.
EMBEDDED, DEPTH = re.compile(r"word/embeddings/[^/]+\.docx$"), 2
REFERENCE = re.compile(r"(\$?)([A-Z]{1,3})(\$?)([0-9]{1,7})(?![0-9A-Za-z(_])")
WORD_PART = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")


DAMAGE = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, EOFError, NotImplementedError)
MARKS = {f"{W_NS}tab": "\t", f"{W_NS}br": "\n", f"{W_NS}cr": "\n"}


def own_runs(p: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The runs of a paragraph, without those of paragraphs inside it."""
    for e in p:
        if e.tag == f"{W_NS}r":
            yield e
        if e.tag != f"{W_NS}p":
            yield from own_runs(e)


def run_text(run: ElementTree.Element) -> str:
    return "".join((e.text or "") if e.tag == f"{W_NS}t" else MARKS.get(e.tag, "") for e in run)


def hidden(run: ElementTree.Element) -> bool:
    mark = run.find(f"{W_NS}rPr/{W_NS}vanish")
    return mark is not None and mark.get(f"{W_NS}val", "1") not in ("0", "false", "off")


def paragraphs(data: bytes, depth: int = DEPTH) -> Iterator[tuple[str, str, str]]:
    """(part, text, text of the visible runs) of a word-processor package's paragraphs, in the order of its
    parts; those of packages inside it come last, with both parts' names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in sorted(filter(WORD_PART.match, z.namelist()), key=lambda n: ("document" not in n, n)):
            for p in ElementTree.fromstring(z.read(part)).iter(f"{W_NS}p"):
                runs = list(own_runs(p))
                yield part, "".join(map(run_text, runs)), "".join(run_text(r) for r in runs if not hidden(r))
        for inner in sorted(filter(EMBEDDED.match, z.namelist())) if depth else ():
            for part, text, shown in paragraphs(z.read(inner), depth - 1):
                yield f"{inner}!{part}", text, shown


def sheet_cells(data: bytes) -> Iterator[tuple[str, bool, str, str, str, str | None]]:
    """(sheet, hidden, ref, type, text, formula) of a workbook; phonetic runs are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S_NS}si"):
                shared.append(plain(si))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S_NS}sheet"):
            target = rels[sheet.get(R_ID)].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            groups: dict[str, tuple[str, str]] = {}
            for c in ElementTree.fromstring(z.read(part)).iter(f"{S_NS}c"):
                kind, value, formula = c.get("t", "n"), c.findtext(f"{S_NS}v") or "", c.findtext(f"{S_NS}f")
                f = c.find(f"{S_NS}f")
                if f is not None and f.get("t") == "shared":
                    if formula:
                        groups[f.get("si")] = c.get("r"), formula
                    elif f.get("si") in groups:
                        formula = moved(groups[f.get("si")][1], groups[f.get("si")][0], c.get("r"))
                if kind == "s":
                    value = shared[int(value)] if value else ""
                elif kind == "inlineStr":
                    value = plain(c)
                yield sheet.get("name"), sheet.get("state") in ("hidden", "veryHidden"), c.get("r"), kind, value, formula


def column_number(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def moved(formula: str, start: str, end: str) -> str:
    """A shared formula as it stands in another cell: references move with it unless a dollar holds them."""
    (_, c0, _, r0), (_, c1, _, r1) = (REFERENCE.match(x).groups() for x in (start, end))
    right, down = column_number(c1) - column_number(c0), int(r1) - int(r0)

    def one(m: re.Match) -> str:
        fixed_column, column, fixed_row, row = m.groups()
        return fixed_column + (column if fixed_column else column_letters(column_number(column) + right)) + fixed_row + (row if fixed_row else str(int(row) + down))

    return REFERENCE.sub(one, formula)


def plain(e: ElementTree.Element) -> str:
    """Text of a string item without its phonetic runs."""
    if e.tag == f"{S_NS}rPh":
        return ""
    return (e.text or "" if e.tag == f"{S_NS}t" else "") + "".join(map(plain, e))


def document_units(files: DataFrame) -> DataFrame:
    """Units of files (doc_id, content) that are word-processor packages."""

    def units_of(doc_id: int, content: bytes) -> list[tuple]:
        rows, parts = [], {}
        try:
            for part, text, shown in paragraphs(content):
                rows.append((doc_id, parts.setdefault(part, len(parts)), len(rows), part, text, True, "header" in part or "footer" in part, bool(shown) or not text, shown, None))
        except DAMAGE as e:
            return [(doc_id, 0, 0, None, None, False, False, False, None, f"{type(e).__name__}: {e}")]
        return rows

    schema = schema_of(UNITS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together((row for doc_id, content in pairs(batches, "doc_id", "content") for row in units_of(doc_id, content)), schema)

    return files.select("doc_id", "content").mapInArrow(read, UNITS)


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells of files (doc_id, content) that are workbooks."""

    def cells_of(doc_id: int, content: bytes) -> list[tuple]:
        try:
            return [(doc_id, *c, None) for c in sheet_cells(content)]
        except DAMAGE as e:
            return [(doc_id, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    schema = schema_of(CELLS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together((row for doc_id, content in pairs(batches, "doc_id", "content") for row in cells_of(doc_id, content)), schema)

    return files.select("doc_id", "content").mapInArrow(read, CELLS)


def rewritten(content: bytes, texts: dict[int, str], depth: int = DEPTH) -> bytes:
    """A word-processor package with new texts for some of its units, by their seq, also in packages inside."""
    changed: dict[str, ElementTree.Element] = {}
    replaced: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        seq = 0
        for part in sorted(filter(WORD_PART.match, z.namelist()), key=lambda n: ("document" not in n, n)):
            root = ElementTree.fromstring(z.read(part))
            for p in root.iter(f"{W_NS}p"):
                if seq in texts:
                    runs = [t for r in own_runs(p) for t in r.iter(f"{W_NS}t")]
                    for i, t in enumerate(runs):
                        t.text = texts[seq] if i == 0 else ""
                        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                    if runs:
                        changed[part] = root
                seq += 1
        for inner in sorted(filter(EMBEDDED.match, z.namelist())) if depth else ():
            n = sum(1 for _ in paragraphs(z.read(inner), depth - 1))
            own = {k - seq: t for k, t in texts.items() if seq <= k < seq + n}
            if own:
                replaced[inner] = rewritten(z.read(inner), own, depth - 1)
            seq += n
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for item in z.infolist():
                new.writestr(item, ElementTree.tostring(changed[item.filename], encoding="UTF-8", xml_declaration=True) if item.filename in changed else replaced.get(item.filename) or z.read(item.filename))
    return out.getvalue()


def rewritten_workbook(content: bytes, texts: dict[tuple[str, str], str]) -> bytes:
    """A workbook with new texts for some of its cells, by sheet and ref; a new text takes the place of
    value and formula."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S_NS}sheet"):
            target = rels[sheet.get(R_ID)]
            sheets[target if target.startswith("xl/") else f"xl/{target}"] = sheet.get("name")
        for item in z.infolist():
            data = z.read(item.filename)
            wanted = {ref: t for (sheet, ref), t in texts.items() if sheet == sheets.get(item.filename)}
            if wanted:
                root = ElementTree.fromstring(data)
                for c in root.iter(f"{S_NS}c"):
                    if c.get("r") in wanted:
                        for child in list(c):
                            c.remove(child)
                        c.set("t", "inlineStr")
                        t = ElementTree.SubElement(ElementTree.SubElement(c, f"{S_NS}is"), f"{S_NS}t")
                        t.text = wanted[c.get("r")]
                        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                data = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            new.writestr(item, data)
    return out.getvalue()


def many_parts(files: DataFrame) -> DataFrame:
    """files by doc_id in as many parts as a shuffle has. Packages that are alike are few bytes in a shuffle, but each is
    taken apart and put together again, so their parts are not to be put together by size."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def rewritten_workbooks(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files (doc_id, content) with the new texts of their cells (doc_id, sheet, ref, text)."""
    from pyspark.sql import functions as F

    by = texts.groupBy("doc_id").agg(F.collect_list(F.struct("sheet", "ref", "text")).alias("texts"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["content"] = [c if t is None else rewritten_workbook(c, {(x["sheet"], x["ref"]): x["text"] for x in t}) for c, t in zip(batch["content"], batch["texts"], strict=True)]
            yield batch[["doc_id", "content"]]

    return many_parts(files.select("doc_id", "content")).join(shuffled(by), "doc_id", "left").mapInPandas(write, "doc_id long, content binary")


def rewritten_documents(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files (doc_id, content) with the new texts of their units (doc_id, seq, text)."""
    from pyspark.sql import functions as F

    by = texts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("seq", "text"))).alias("texts"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["content"] = [c if t is None else rewritten(c, {int(k): v for k, v in dict(t).items()}) for c, t in zip(batch["content"], batch["texts"], strict=True)]
            yield batch[["doc_id", "content"]]

    return many_parts(files.select("doc_id", "content")).join(shuffled(by), "doc_id", "left").mapInPandas(write, "doc_id long, content binary")


def simple_document(title: str, paras: list[str]) -> bytes:
    """A new word-processor package of a title and paragraphs."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in (title, *paras))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{W_NS[1:-1]}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()
