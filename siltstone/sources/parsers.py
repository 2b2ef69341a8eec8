"""Parsing bodies into blocks: one Arrow-batched pass for each format, with failures as rows."""

from __future__ import annotations

import ast
import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "uri string, page string, number int, block_type string, text string, headers array<string>, rows array<array<string>>, caption string, error string"
SKIPPED = frozenset("script style nav footer header aside form iframe".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 li".split())
FURNITURE_HINTS = ("page", "©", "confidential", "copyright", "all rights reserved")


def markdown_table(rows: list[list[str]]) -> str:
    """Rows as a markdown table, ragged ones padded."""
    if not rows:
        return ""
    width = max(map(len, rows))
    full = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [full[0], ["---"] * width, *full[1:]])


class _HtmlBlocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.skip = 0
        self.text: list[str] | None = None
        self.tag = ""
        self.table: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "table":
            self.table = []
        elif self.table is not None:
            if tag == "tr":
                self.table.append([])
            elif tag in ("td", "th") and self.table:
                self.cell = []
        elif tag in TEXT_BLOCKS:
            self.end_text()
            self.text, self.tag = [], tag
        if tag == "img":
            found = dict(attrs)
            self.blocks.append(("image", found.get("alt") or "", [], [], found.get("title") or found.get("alt") or ""))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("td", "th") and self.cell is not None and self.table:
            self.table[-1].append("".join(self.cell).strip())
            self.cell = None
        elif tag == "table" and self.table is not None:
            rows = [r for r in self.table if r]
            if rows:
                self.blocks.append(("table", markdown_table(rows), rows[0], rows[1:], ""))
            self.table = None
        elif tag == self.tag:
            self.end_text()

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.text is not None:
            self.text.append(data)

    def end_text(self):
        if self.text is not None:
            joined = re.sub(r"\s+", " ", "".join(self.text)).strip()
            if joined:
                self.blocks.append(("heading" if self.tag.startswith("h") else "text", joined, [], [], ""))
        self.text, self.tag = None, ""


def html_blocks(raw: bytes) -> list[tuple]:
    parser = _HtmlBlocks()
    parser.feed(raw.decode("utf-8", "replace"))
    parser.close()
    parser.end_text()
    return [("1", *b) for b in parser.blocks]


def text_blocks(raw: bytes) -> list[tuple]:
    text = raw.decode("utf-8", "replace")
    return [("1", "text", p.strip(), [], [], "") for p in re.split(r"\n\s*\n", text) if p.strip()]


def drop_furniture(page: str) -> tuple[str, int]:
    """A page's text without short lines that look like headers or footers, and how many went."""
    lines = page.split("\n")
    kept = [x for x in lines if not (x.strip() and len(x) <= 80 and any(h in x.lower() for h in FURNITURE_HINTS))]
    return "\n".join(kept), len(lines) - len(kept)


def pdf_blocks(raw: bytes) -> list[tuple]:
    """Needs pdfplumber, which is optional."""
    import io

    import pdfplumber

    out = []
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            body, _ = drop_furniture(page.extract_text() or "")
            if body.strip():
                out.append((str(n), "text", body.strip(), [], [], ""))
            for table in page.extract_tables():
                rows = [[c or "" for c in r] for r in table]
                out.append((str(n), "table", markdown_table(rows), rows[0], rows[1:], ""))
    return out


def docx_blocks(raw: bytes, page_chars: int = 1500) -> list[tuple]:
    """Needs python-docx, which is optional.  Pages are counted by characters."""
    import io

    import docx

    out, page, size = [], 1, 0
    document = docx.Document(io.BytesIO(raw))
    for item in document.iter_inner_content():
        if hasattr(item, "rows"):
            rows = [[c.text for c in r.cells] for r in item.rows]
            out.append((str(page), "table", markdown_table(rows), rows[0] if rows else [], rows[1:], ""))
        elif item.text.strip():
            out.append((str(page), "heading" if item.style.name.startswith("Heading") else "text", item.text.strip(), [], [], ""))
            size += len(item.text)
            if size > page_chars:
                page, size = page + 1, 0
    return out


def xlsx_blocks(raw: bytes) -> list[tuple]:
    """Needs openpyxl, which is optional.  One table for each visible sheet; merged cells are filled."""
    import io

    import openpyxl

    out = []
    for sheet in openpyxl.load_workbook(io.BytesIO(raw), data_only=True).worksheets:
        if sheet.sheet_state != "visible":
            continue
        cells = [["" if c.value is None else str(c.value) for c in row] for row in sheet.iter_rows()]
        for area in sheet.merged_cells.ranges:
            for r in range(area.min_row - 1, area.max_row):
                for c in range(area.min_col - 1, area.max_col):
                    cells[r][c] = cells[area.min_row - 1][area.min_col - 1]
        if cells:
            heads = [h or f"col_{i + 1}" for i, h in enumerate(cells[0])]
            out.append((sheet.title, "table", markdown_table([heads, *cells[1:]]), heads, cells[1:], ""))
    return out


PARSERS = {"html": html_blocks, "markdown": text_blocks, "text": text_blocks, "pdf": pdf_blocks, "docx": docx_blocks, "xlsx": xlsx_blocks}


def parse_blocks(bodies: DataFrame) -> DataFrame:
    """Blocks of (uri, source_format, raw); a body that can't be parsed gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for uri, kind, raw in zip(frame["uri"], frame["source_format"], frame["raw"], strict=True):
                try:
                    parser = PARSERS[kind]
                    out += [(uri, page, i, kind_, text, heads, rows, caption, None) for i, (page, kind_, text, heads, rows, caption) in enumerate(parser(bytes(raw)))]
                except Exception as e:  # one broken body mustn't fail the batch: it goes to the dead letters
                    out.append((uri, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in re.split(r", (?=\w+ )", BLOCK)])

    return bodies.select("uri", "source_format", "raw").mapInPandas(run, BLOCK)


UNIT = "uri string, kind string, name string, signature string, docstring string, excerpt string, lineno int"


def python_units(sources: DataFrame, excerpt_lines: int = 20) -> DataFrame:
    """Modules, classes, functions and methods of Python files (uri, text); files with syntax errors give none."""

    def units(text: str):
        try:
            tree = ast.parse(text)
        except SyntaxError:
            return
        lines = text.split("\n")
        yield "module", "", "", ast.get_docstring(tree) or "", "\n".join(lines[:excerpt_lines]), 1
        todo = [(tree, False)]
        while todo:
            node, in_class = todo.pop()
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                    is_class = isinstance(child, ast.ClassDef)
                    signature = f"class {child.name}" if is_class else f"{child.name}({ast.unparse(child.args)})"
                    kind = "class" if is_class else "method" if in_class else "function"
                    yield kind, child.name, signature, ast.get_docstring(child) or "", "\n".join(lines[child.lineno - 1 : child.lineno - 1 + excerpt_lines]), child.lineno
                    todo.append((child, is_class))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(u, *x) for u, t in zip(frame["uri"], frame["text"], strict=True) for x in units(t)], columns=["uri", "kind", "name", "signature", "docstring", "excerpt", "lineno"])

    return sources.select("uri", "text").mapInPandas(run, UNIT)


def table_rows(text: str) -> list[list[str]]:
    """Cells of the markdown tables in a text, without separator rows."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("|") and bare.endswith("|") and len(bare) > 1:
            cells = [html.unescape(c.strip()) for c in bare[1:-1].split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                out.append(cells)
    return out


def unsupported(bodies: DataFrame) -> DataFrame:
    return bodies.filter(~F.col("source_format").isin(*PARSERS))
