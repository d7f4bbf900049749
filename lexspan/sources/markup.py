"""Legal XML and HTML as unit rows.

Mixed content with offsets isn't relational, so each file is walked in Python,
one pass of mapInArrow over binary files; files are independent of each other.
Formats: uslm (U.S. Code XML), ecfr (Code of Federal Regulations XML), formex
(EU acts), ca_html (California code pages).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.outline import APPENDIX_KINDS

TABLE_ROWS = 30
UNIT_SCHEMA = (
    "path string, unit_type string, unit_id string, unit_path string, parent_unit_path string, org_path string, ord long, depth int, "
    "unit_title string, text string, breakpoints array<struct<pos:int,prio:int>>, notes map<string,string>, annotation string, "
    "table_html string, table_row_count int, table_headers array<string>, table_caption string, error string"
)

_PLAIN = {0xA0: " ", 0x202F: " ", 0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2011: "-", 0x2013: "-", 0x2014: "--", 0xAD: ""}


def plain(text: str | None) -> str:
    """Plain quotes, dashes and spaces, single line breaks."""
    t = (text or "").replace("&nbsp;", " ").replace("&ndash;", "-").replace("&mdash;", "--").translate(_PLAIN)
    return re.sub("\n+", "\n", re.sub("\n\t+ *", " ", t)).strip("\n")


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


@dataclass
class Node:
    """An element without its namespace; a text is a child of the type str."""

    tag: str
    attrs: dict[str, str]
    kids: list = field(default_factory=list)

    def texts(self) -> str:
        return "".join(k if isinstance(k, str) else k.texts() for k in self.kids)

    def all(self, *tags: str) -> Iterator[Node]:
        for k in self.kids:
            if isinstance(k, Node):
                if k.tag in tags:
                    yield k
                yield from k.all(*tags)

    def first(self, *tags: str) -> Node | None:
        return next(self.all(*tags), None)

    def child(self, *tags: str) -> Node | None:
        return next((k for k in self.kids if isinstance(k, Node) and k.tag in tags), None)

    def markup(self) -> str:
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + "".join(k if isinstance(k, str) else k.markup() for k in self.kids) + f"</{self.tag}>"


def from_xml(data: bytes) -> Node:
    def convert(e: ElementTree.Element) -> Node:
        n = Node(e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else "", {k.rpartition("}")[2].lower(): v for k, v in e.attrib.items()})
        if e.text:
            n.kids.append(e.text)
        for c in e:
            if isinstance(c.tag, str):
                n.kids.append(convert(c))
            if c.tail:
                n.kids.append(c.tail)
        return n

    return convert(ElementTree.fromstring(data))


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("", {})
        self.open = [self.top]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.open) > 1 and self.open[-1].tag in self.CLOSES.get(tag, ()):
            self.open.pop()
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(n)
        if tag not in self.VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def from_html(text: str) -> Node:
    p = _Html()
    p.feed(text)
    p.close()
    return p.top


@dataclass
class Text:
    """A growing text with breakpoints and notes."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    points: dict[int, int] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def add(self, t: str) -> None:
        if t:
            self.parts.append(t)
            self.size += len(t)

    def line(self) -> None:
        """Begins a new line unless one was just begun."""
        if self.size and not self.parts[-1].endswith("\n"):
            self.add("\n")

    def point(self, level: int) -> None:
        if self.size:
            self.points[self.size] = min(level, self.points.get(self.size, level))

    def done(self) -> tuple[str, list[tuple[int, int]]]:
        t = "".join(self.parts).rstrip()
        return t, sorted((p, q) for p, q in self.points.items() if p < len(t))


@dataclass
class Units:
    """Rows of one file."""

    rows: list[dict] = field(default_factory=list)
    taken: set[str] = field(default_factory=set)

    def add(self, kind: str, ident: str, org: list[tuple[str, str]], title: str, text: Text | None, parent: dict | None = None, **more: object) -> dict:
        org_path = "/".join(f"{k}_{v}" for k, v in org)
        base = parent["unit_path"] if parent else ""
        while (path := f"{base}/{kind}_{ident}".lstrip("/")) in self.taken:
            ident += "_dup"
        self.taken.add(path)
        body, points = text.done() if text else ("", [])
        row = {
            "unit_type": kind, "unit_id": ident, "unit_path": path, "parent_unit_path": base or None, "org_path": org_path, "ord": len(self.rows),
            "depth": parent["depth"] + 1 if parent else 0, "unit_title": title, "text": body, "breakpoints": [{"pos": p, "prio": q} for p, q in points],
            "notes": list(text.notes.items()) if text else [],
        } | more
        self.rows.append(row)
        return row

    def tables(self, pending: list[Node], owner: dict, org: list[tuple[str, str]]) -> None:
        for i, t in enumerate(pending, 1):
            self.add("table", str(i), org, "", None, owner, **table_facts(t))


def rows_of_table(t: Node) -> list[Node]:
    return list(t.all("tr", "row"))


def table_facts(t: Node) -> dict:
    rows = rows_of_table(t)
    heads = [squeeze(c.texts()) for c in rows[0].all("th")] if rows else []
    caption = t.first("caption", "title", "ti.tbl")
    return {"table_html": t.markup(), "table_row_count": len(rows), "table_headers": heads, "table_caption": squeeze(caption.texts()) if caption else ""}


_BLOCKS = {"p", "tr", "row", "item", "level", "subsection", "paragraph", "subparagraph", "clause", "subclause", "subitem", "alinea", "parag", "np", "fp", "li", "psect", "block"}
_BREAKS = {"subsection": 1, "parag": 1, "alinea": 2, "block": 2, "p": 2, "content": 2}
_SKIP = {"sourcecredit", "quot.start", "quot.end", "ti.art", "sti.art", "script", "style"}


def render(n: Node, out: Text, pending: list[Node], notes: bool = True, top: bool = True) -> None:
    """Text of an element: blocks begin lines, table cells are in brackets,
    footnotes go aside, and large tables leave a placeholder."""
    if n.tag in _SKIP or (not notes and n.tag == "note"):
        return
    if n.tag in ("table", "gpotable", "tbl") and len(rows_of_table(n)) >= TABLE_ROWS:
        pending.append(n)
        out.add(f" [Table {len(pending)} extracted as sub-unit table {len(pending)}] ")
        return
    if n.tag == "note" and n.attrs.get("type", "").lower() == "footnote" or n.tag == "ftnt":
        num = n.child("num", "no.p")
        inner = Text()
        for k in n.kids:
            if k is not num:
                inner.add(plain(k)) if isinstance(k, str) else render(k, inner, pending, False, False)
        name = squeeze(num.texts()) if num else str(len(out.notes) + 1)
        out.notes[name] = inner.done()[0].strip()
        return
    if n.tag == "ref" and n.attrs.get("class", "").lower() == "footnoteref":
        out.add(f"(note: {n.texts()})")
        return
    if not top and n.tag in _BLOCKS:
        out.line()
        if n.tag in _BREAKS:
            out.point(_BREAKS[n.tag])
    if n.tag in ("td", "th", "entry"):
        out.add("[ ")
    heads = n.tag == "section" or n.attrs.get("type", "").upper() in ("SECTION", "APPENDIX")
    for k in n.kids:
        if isinstance(k, str):
            t = plain(k) if n.tag in ("section", "content") else re.sub(r"\s+", " ", plain(k))
            out.add(t if t.strip() else " " * (bool(t) and out.size > 0 and not out.parts[-1].endswith(("\n", " "))))
        elif heads and k.tag in ("num", "heading", "head"):
            continue
        else:
            heads = heads and k.tag in ("num", "heading", "head")
            render(k, out, pending, notes, False)
    if n.tag in ("td", "th", "entry"):
        out.add(" ]")
    if n.tag in ("heading", "content") or n.tag in _BLOCKS:
        out.line()


def _unit_of(n: Node, units: Units, kind: str, ident: str, org: list[tuple[str, str]], title: str, parent: dict | None = None, **more: object) -> dict:
    out, pending = Text(), []
    render(n, out, pending)
    row = units.add(kind, ident, org, title, out, parent, **more)
    units.tables(pending, row, org)
    return row


USLM_LEVELS = ["title", "subtitle", "division", "subdivision", "part", "subpart", "chapter", "subchapter", "article", "subarticle", "appendix"]


def parse_uslm(data: bytes, specific: dict[str, str] | None = None) -> list[dict]:
    """Sections below titles, chapters and so on; a repeated section number is an error.

    specific: only sections whose levels are as given.  Sections that stand in a
    section (in an act that it quotes, say) are its sub-units, besides being in its text."""
    units = Units()
    seen: set[str] = set()

    def inner(n: Node, org: list[tuple[str, str]], owner: dict) -> None:
        for k in n.kids:
            if not isinstance(k, Node):
                continue
            if k.tag == "section":
                num, head = k.child("num"), k.child("heading")
                value = num.attrs.get("value") or squeeze(num.texts()) if num else ""
                row = _unit_of(k, units, "section", value or f"Blank_{len(units.rows) + 1}", org, squeeze(plain(head.texts())) if head else "", parent=owner)
                inner(k, org, row)
            else:
                inner(k, org, owner)

    def walk(n: Node, org: list[tuple[str, str]]) -> None:
        for k in n.kids:
            if not isinstance(k, Node):
                continue
            num, head = k.child("num"), k.child("heading")
            value = num.attrs.get("value") or squeeze(num.texts()) if num else ""
            if k.tag == "section":
                if value in seen:
                    raise ValueError(f"section {value} appears twice")
                seen.add(value)
                if context_matches(specific, org):
                    inner(k, org, _unit_of(k, units, "section", value, org, squeeze(plain(head.texts())) if head else ""))
            elif k.tag in USLM_LEVELS and value:
                walk(k, [*org, (k.tag, value)])
            else:
                walk(k, org)

    top = from_xml(data)
    walk(Node("", {}, [top]), [])
    return units.rows


_ECFR_LEVELS = {"TITLE": "title", "SUBTITLE": "subtitle", "CHAPTER": "chapter", "SUBCHAP": "subchapter", "PART": "part", "SUBPART": "subpart", "SUBJGRP": "subject_group"}


def context_matches(wanted: dict[str, str] | None, org: list[tuple[str, str]]) -> bool:
    have = {k: v.strip() for k, v in org}
    return all(have.get(k) == str(v).strip() for k, v in (wanted or {}).items())


def parse_ecfr(data: bytes, specific: dict[str, str] | None = None, residual: bool = False) -> list[dict]:
    """Sections and appendix-like units below DIVs.  specific: only those whose
    levels are as given; residual: without what stands in parts.

    Appendices have the kind that their name opens with (supplement, schedule,
    table, ...).  Of those of one kind and name a blank one goes where another has a text, and
    further texts get _dup."""
    units = Units()
    first: dict[tuple, dict] = {}

    def walk(n: Node, org: list[tuple[str, str]]) -> None:
        for k in n.kids:
            if not isinstance(k, Node):
                continue
            kind, ident = k.attrs.get("type", "").upper(), k.attrs.get("n", "").strip()
            head = k.child("head")
            title = squeeze(plain(head.texts())) if head else ""
            if not k.tag.startswith("div"):
                walk(k, org)
            elif kind == "PART" and residual:
                continue
            elif kind in _ECFR_LEVELS:
                walk(k, [*org, (_ECFR_LEVELS[kind], ident)] if ident else org)
            elif kind in ("SECTION", "APPENDIX") and context_matches(specific, org):
                name = re.sub(r"^§+\s*", "", ident)
                label = "section"
                if kind == "APPENDIX":
                    label, name = appendix_of(name)
                    before = first.get((label, name, *org))
                    if before and not _body(k).strip():
                        continue
                    if before and not before["text"].strip():
                        units.rows.remove(before)
                        units.taken.discard(before["unit_path"])
                row = _unit_of(k, units, label, name or f"Blank_{len(units.rows) + 1}", org, re.sub(r"^§+\s*\S+\s*", "", title))
                if kind == "APPENDIX" and not (before and before["text"].strip()):
                    first[label, name, *org] = row
                if "[reserved]" in title.lower():
                    row["annotation"] = "[Reserved]"
            else:
                walk(k, org)

    walk(Node("", {}, [from_xml(data)]), [])
    return units.rows


def appendix_of(name: str) -> tuple[str, str]:
    """The kind that an appendix's name opens with, and the name without it."""
    for word, plural in APPENDIX_KINDS:
        if name.lower().startswith(word + " "):
            full = next(w for w, p in APPENDIX_KINDS if p == plural)
            return full, name[len(word) + 1 :].strip()
    return "appendix", name


def _body(n: Node) -> str:
    out = Text()
    render(n, out, [])
    return out.done()[0]


def parse_formex(data: bytes) -> list[dict]:
    """Recitals, articles and annexes of an EU act."""
    top = from_xml(data)
    units = Units()
    for i, c in enumerate((c for p in top.all("preamble") for c in p.all("consid")), 1):
        num = c.first("no.p")
        m = re.search(r"\(([^()]*)\)", num.texts()) if num else None
        out = Text()
        for t in c.all("txt"):
            render(t, out, [])
        units.add("recital", m[1] if m else f"recital_{i}", [], "", out)

    def walk(n: Node, org: list[tuple[str, str]]) -> None:
        for k in n.kids:
            if not isinstance(k, Node):
                continue
            if k.tag == "division":
                head = squeeze(plain((k.first("ti") or Node("", {})).texts()))
                m = re.match(r"(\w+)\s+(\S+)", head)
                walk(k, [*org, (m[1].lower(), m[2])] if m else org)
            elif k.tag == "article":
                ti, sub = k.child("ti.art"), k.child("sti.art")
                num = squeeze(re.sub("(?i)article", "", plain(ti.texts()))) if ti else ""
                num = num or k.attrs.get("identifier", "").lstrip("0") or f"art_{len(units.rows) + 1}"
                _unit_of(k, units, "article", num, org, squeeze(plain(sub.texts())) if sub else "")
            else:
                walk(k, org)

    walk(Node("", {}, [top]), [])
    for i, a in enumerate(top.all("annex"), 1):
        head = squeeze(plain((a.first("ti") or Node("", {})).texts()))
        m = re.search(r"(?i)annex\s+(\S+)", head)
        _unit_of(a, units, "annex", m[1] if m else f"annex_{i}", [], head)
    return units.rows


def trailing_paren(text: str) -> tuple[str, str]:
    """A text without its last balanced parenthesis, and what stands in it."""
    t = text.strip()
    if not t.endswith(")"):
        return text, ""
    depth = 0
    for i in range(len(t) - 1, -1, -1):
        depth += (t[i] == ")") - (t[i] == "(")
        if depth == 0:
            return t[:i], t[i + 1 : -1]
    return text, ""


def parse_ca_html(data: bytes) -> list[dict]:
    """Sections of a California code page: a heading with the number, then
    paragraphs; a history note in parentheses at the end becomes the annotation."""
    top = from_html(data.decode("utf-8", "replace"))
    units = Units()
    org: list[tuple[str, str]] = []
    number: str | None = None
    out, pending = Text(), []

    def close() -> None:
        nonlocal number, out, pending
        if number is not None:
            note = ""
            if out.parts:
                last, inside = trailing_paren(out.parts[-1])
                if re.match(r"(?:Amended|Added|Repealed|Enacted|Renumbered)", inside):
                    note = inside
                    out.size -= len(out.parts[-1]) - len(last.rstrip())
                    out.parts[-1] = last.rstrip()
            units.tables(pending, units.add("section", number, org, "", out, annotation=note), org)
        number, out, pending = None, Text(), []

    def walk(n: Node) -> None:
        nonlocal number
        for k in n.kids:
            if not isinstance(k, Node):
                continue
            t = squeeze(plain(k.texts()))
            if k.tag in ("h3", "h4", "h5", "div") and number is None and (m := re.match(r"(?i)^(title|division|part|chapter|article)\s+(\d[\d.]*)\.", t)) and not k.child("div", "h5", "h6", "p"):
                level = m[1].lower()
                at = next((i for i, (x, _) in enumerate(org) if x == level), len(org))
                org[at:] = [(level, m[2].rstrip("."))]
            elif k.tag in ("h5", "h6") and (m := re.match(r"^(\d+[.\d]*)", t)):
                close()
                number = m[1].rstrip(".")
            elif k.tag == "p" and number is not None and not k.first("p"):
                if t:
                    out.line()
                    if re.match(r"^\(\w+\)", t):
                        out.point(1)
                    out.add(t)
            elif k.tag == "table" and number is not None:
                out.line()
                render(k, out, pending, top=False)
            else:
                walk(k)

    walk(top)
    close()
    return units.rows


FORMATS: dict[str, Callable[..., list[dict]]] = {"uslm": parse_uslm, "ecfr": parse_ecfr, "formex": parse_formex, "ca_html": parse_ca_html}
_SUFFIXES = {"uslm": "*.xml", "ecfr": "*.xml", "formex": "*.xml", "ca_html": "*.html"}


def units_of(files: DataFrame, kind: str, **options: object) -> DataFrame:
    """Unit rows of files(path, content).  A file that can't be parsed gives one
    row with its error and nothing else."""
    parse = FORMATS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = parse(content, **options)
                except Exception as e:  # noqa: BLE001
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                full = [{"path": path, **r} for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in full], f.type) for f in _ARROW], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, UNIT_SCHEMA)


_ARROW = pa.schema([
    ("path", pa.string()), ("unit_type", pa.string()), ("unit_id", pa.string()), ("unit_path", pa.string()), ("parent_unit_path", pa.string()), ("org_path", pa.string()), ("ord", pa.int64()), ("depth", pa.int32()),
    ("unit_title", pa.string()), ("text", pa.string()), ("breakpoints", pa.list_(pa.struct([("pos", pa.int32()), ("prio", pa.int32())]))), ("notes", pa.map_(pa.string(), pa.string())), ("annotation", pa.string()),
    ("table_html", pa.string()), ("table_row_count", pa.int32()), ("table_headers", pa.list_(pa.string())), ("table_caption", pa.string()), ("error", pa.string()),
])


def read(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """Unit rows of all files of a format below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _SUFFIXES[kind]).load(path)
    return units_of(files, kind, **options)


def split_units(units: DataFrame, level: str) -> DataFrame:
    """The different org units of a level, with what stands above them: what a
    large document is split by."""
    head = F.regexp_extract("org_path", rf"^((?:.*/)?{level}_[^/]*)", 1)
    return units.select("path", head.alias("org_path")).where("org_path <> ''").distinct()


def table_grid(html: str) -> list[list[str]] | None:
    """Cells of a table with row and column spans filled in; None for nested
    tables and spans over 50 rows or 20 columns."""
    t = from_html(html).first("table")
    if t is None or t.first("table"):
        return None
    grid: dict[tuple[int, int], str] = {}
    rows = list(t.all("tr"))
    for r, row in enumerate(rows):
        c = 0
        for cell in (k for k in row.kids if isinstance(k, Node) and k.tag in ("td", "th")):
            while (r, c) in grid:
                c += 1
            try:
                down, right = int(cell.attrs.get("rowspan") or 1), int(cell.attrs.get("colspan") or 1)
            except ValueError:
                down = right = 1
            if down > 50 or right > 20:
                return None
            for i in range(max(down, 1)):
                for j in range(max(right, 1)):
                    grid[r + i, c + j] = squeeze(plain(cell.texts())) if i == j == 0 else ""
            c += max(right, 1)
    width = max((c for _, c in grid), default=-1) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def table_text(html: str, least: int = 5, most: int = 40) -> str:
    """A table as padded text, cells wrapped at words; the HTML itself where the grid can't be told."""
    import textwrap

    grid = table_grid(html)
    if not grid or not grid[0]:
        return html
    width = [min(most, max(least, *(len(row[c]) for row in grid))) for c in range(len(grid[0]))]
    out = []
    for row in grid:
        cells = [textwrap.wrap(x, w) or [""] for x, w in zip(row, width)]
        for i in range(max(map(len, cells))):
            out.append(" | ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(cells, width)).rstrip())
    return "\n".join(out)


def last_json(text: str) -> str | None:
    """The last complete JSON object or array in a text."""
    decoder, best, i = json.JSONDecoder(), None, 0
    while (m := re.compile(r"[\[{]").search(text, i)) is not None:
        try:
            obj, i = decoder.raw_decode(text, m.start())
            best = obj
        except ValueError:
            i = m.start() + 1
    return None if best is None else json.dumps(best, separators=(",", ":"))
