"""Readers of documents in many formats, as canonical text and blocks.

Each format is a function from raw bytes to ``(text, blocks)``; a block is
``(parent, kind, level, start, end, text, props)`` in reading order with code-point spans of the text.  New formats
register with ``@reader(".ext")``.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

Block = tuple[int, str, int, int, int, str, dict[str, str]]
Parsed = tuple[str, list[Block]]
READERS: dict[str, Callable[[bytes], Parsed]] = {}


class Unsupported(ValueError):
    """A file that can't be read in its format; builds skip it with a warning."""


def reader(*extensions: str) -> Callable[[Callable[[bytes], Parsed]], Callable[[bytes], Parsed]]:
    def register(f: Callable[[bytes], Parsed]) -> Callable[[bytes], Parsed]:
        READERS.update(dict.fromkeys(extensions, f))
        return f

    return register


def canonical(raw: bytes) -> str:
    """Decoded text without a byte order mark, line ends as ``\\n``; each undecodable byte is one U+FFFD."""
    text = raw.decode("utf-8", "surrogateescape").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    text = re.sub("[\ud800-\udfff]", "\ufffd", raw.decode("utf-8", "surrogateescape")) if "\ufffd" in text else text
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def offset_runs(raw: bytes) -> list[tuple[int, int, int, int]]:
    """Runs ``(canonical start, raw start, length, bytes per character)`` of a text's way back to bytes."""
    text = raw.decode("utf-8", "surrogateescape")
    at, runs, i, out = 0, [], 0, 0
    if text.startswith("\ufeff"):
        at, i = 3, 1
    while i < len(text):
        ch = text[i]
        width = 1 if "\udc80" <= ch <= "\udcff" else len(ch.encode("utf-8"))
        step = 1
        if ch == "\r" and i + 1 < len(text) and text[i + 1] == "\n":
            width, step = 2, 2
        if runs and runs[-1][3] == width:
            c, r, n, w = runs[-1]
            runs[-1] = (c, r, n + 1, w)
        else:
            runs.append((out, at, 1, width))
        at, out, i = at + width, out + 1, i + step
    return runs


def to_raw(runs: list[tuple[int, int, int, int]], raw_len: int, position: int) -> int:
    """The byte offset of a canonical position; the end of the text is the end of the bytes."""
    for c, r, n, w in reversed(runs):
        if position >= c:
            return r + (position - c) * w if position < c + n else (raw_len if (c, r, n, w) == runs[-1] else r + n * w)
    return 0 if runs else raw_len


@reader(".txt", ".text", "")
def plain(raw: bytes) -> Parsed:
    text = canonical(raw)
    out: list[Block] = []
    for m in re.finditer(r"[^\n](?:[^\n]|\n(?!\n))*", text):
        body = m.group().rstrip()
        if body:
            out.append((-1, "paragraph", 0, m.start(), m.start() + len(body), body, {}))
    return text, out


@reader(".md", ".markdown", ".mdx")
def markdown(raw: bytes) -> Parsed:
    """Headings (ATX and setext), fences, lists, quotes, tables and paragraphs, by lines.
    Lists and quotes are containers of their items' paragraphs; a table has no text of its own."""
    text = canonical(raw)
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    out: list[Block] = []

    def add(parent: int, kind: str, a: int, b: int, body: str, level: int = 0, **props: str) -> int:
        out.append((parent, kind, level, starts[a], starts[b], body, props))
        return len(out) - 1

    marker = re.compile(r"\s{0,3}(?:[-*+]|\d{1,9}[.)])\s+")

    def walk(a: int, b: int, parent: int) -> None:
        i = a
        while i < b:
            line = lines[i].rstrip("\n")
            if not line.strip():
                i += 1
                continue
            heading = re.match(r"\s{0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*$", line)
            fence = re.match(r"\s{0,3}(`{3,}|~{3,})\s*(\S*)", line)
            j = i + 1
            if heading:
                add(parent, "heading", i, j, (heading.group(2) or "").strip(), len(heading.group(1)))
            elif fence:
                while j < b and not re.match(rf"\s{{0,3}}{re.escape(fence.group(1))}", lines[j]):
                    j += 1
                j = min(b, j + 1)
                add(parent, "code", i, j, "".join(lines[i + 1 : j - 1]), info=fence.group(2))
            elif re.match(r"\s{0,3}>", line):
                while j < b and lines[j].strip() and (re.match(r"\s{0,3}>", lines[j]) or not marker.match(lines[j])):
                    j += 1
                box = add(parent, "quote", i, j, "")
                add(box, "paragraph", i, j, "\n".join(re.sub(r"^\s{0,3}>\s?", "", x.rstrip("\n")) for x in lines[i:j]).strip())
            elif marker.match(line):
                while j < b and (lines[j].strip() and (marker.match(lines[j]) or lines[j].startswith((" ", "\t"))) or not lines[j].strip() and j + 1 < b and marker.match(lines[j + 1])):
                    j += 1
                box, k = add(parent, "list_item", i, j, ""), i
                while k < j:
                    e = k + 1
                    while e < j and not marker.match(lines[e]):
                        e += 1
                    item = add(box, "list_item", k, e, "")
                    body = marker.sub("", "".join(lines[k:e]), count=1).strip()
                    if body:
                        add(item, "paragraph", k, e, re.sub(r"\n\s+", "\n", body))
                    k = e
            elif "|" in line and i + 1 < b and re.match(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
                while j < b and "|" in lines[j]:
                    j += 1
                add(parent, "table", i, j, "")
            else:
                while j < b and lines[j].strip() and not re.match(r"\s{0,3}(#{1,6}\s|>|`{3,}|~{3,})", lines[j]) and not marker.match(lines[j]):
                    if re.match(r"\s{0,3}(=+|-+)\s*$", lines[j]):
                        break
                    j += 1
                under = re.match(r"\s{0,3}(=+|-+)\s*$", lines[j]) if j < b else None
                body = "\n".join(x.strip() for x in lines[i:j])
                if under:
                    j += 1
                    add(parent, "heading", i, j, body, 1 if under.group(1)[0] == "=" else 2)
                else:
                    add(parent, "paragraph", i, j, body)
            i = j

    walk(0, len(lines), -1)
    return text, out


@reader(".log")
def log(raw: bytes) -> Parsed:
    from ..functions.text import LOG_MASKS

    text, at, out = canonical(raw), 0, []
    for line in text.splitlines(keepends=True):
        body = line.rstrip()
        if body:
            template = body
            for pattern, mark in LOG_MASKS:
                template = re.sub(pattern, mark, template)
            out.append((-1, "log_line", 0, at, at + len(body), body, {"template": template.strip()}))
        at += len(line)
    return text, out


@reader(".chat", ".transcript")
def transcript(raw: bytes) -> Parsed:
    from ..functions.text import TURN

    text, at, out = canonical(raw), 0, []
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\n")
        m = re.match(TURN, body)
        if m and body.strip():
            props = {"timestamp": (m.group(1) or "").strip(), "speaker": m.group(2).strip(), "message": m.group(3).strip()}
            out.append((-1, "transcript_turn", 0, at, at + len(body.rstrip()), body.rstrip(), props))
        at += len(line)
    return text, out


def fields(text: str, data: Any) -> list[Block]:
    """One block per leaf, its span the next place where the value stands in the text."""
    out: list[Block] = []
    cursor = 0

    def find(what: str) -> tuple[int, int]:
        nonlocal cursor
        at = text.find(what, cursor) if what else -1
        at = text.find(what) if what and at < 0 else at
        if at < 0:
            return 0, len(text)
        cursor = at + len(what)
        return at, cursor

    stack: list[tuple[str, Any]] = [("", data)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            shown = "" if value is None else str(value)
            a, b = find(shown[:60])
            name = path.lstrip(".")
            out.append((-1, "field", 0, a, b, f"{name} = {shown}", {"path": name, "value": shown}))
    return out


@reader(".json")
def json_document(raw: bytes) -> Parsed:
    text = canonical(raw)
    try:
        return text, fields(text, json.loads(text))
    except ValueError as e:
        raise Unsupported(str(e)) from e


@reader(".yaml", ".yml")
def yaml_document(raw: bytes) -> Parsed:
    try:
        import yaml
    except ImportError as e:
        raise Unsupported("no YAML library") from e
    text = canonical(raw)
    try:
        return text, fields(text, yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise Unsupported(str(e)) from e


@reader(".toml")
def toml_document(raw: bytes) -> Parsed:
    import tomllib

    text = canonical(raw)
    try:
        return text, fields(text, tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise Unsupported(str(e)) from e


def joined(parts: list[tuple[str, int, str]]) -> Parsed:
    """Extracted parts ``(kind, level, text)``: the text is their bodies, two line ends between."""
    out: list[Block] = []
    at, bodies = 0, []
    for kind, level, body in parts:
        out.append((-1, kind, level, at, at + len(body), body, {}))
        bodies.append(body)
        at += len(body) + 2
    return "\n\n".join(bodies), out


class _Html(HTMLParser):
    SKIP = {"script", "style", "head", "nav", "footer"}
    BREAK = {"p", "li", "td", "th", "div", "section", "article", "blockquote", "pre", "tr", "br", "ul", "ol", "table", "dd", "dt", "figcaption"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[str, int, str]] = []
        self.held: list[str] = []
        self.skipping, self.level = 0, 0

    def flush(self) -> None:
        body = re.sub(r"\s+", " ", "".join(self.held)).strip()
        self.held = []
        if body:
            self.parts.append(("heading" if self.level else "paragraph", self.level, body))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skipping += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag in self.BREAK:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipping = max(0, self.skipping - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = 0
        elif tag in self.BREAK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.held.append(data)


@reader(".html", ".htm", ".xhtml")
def html(raw: bytes) -> Parsed:
    p = _Html()
    p.feed(canonical(raw))
    p.close()
    p.flush()
    return joined(p.parts)


def _xml(raw: bytes, member: str) -> ElementTree.Element:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return ElementTree.fromstring(z.read(member))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Unsupported(str(e)) from e


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


@reader(".docx")
def docx(raw: bytes) -> Parsed:
    parts = []
    for p in _xml(raw, "word/document.xml").iter():
        if _local(p.tag) == "p":
            body = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip()
            style = next((v for s in p.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.match(r"(?i)heading\s?(\d)", style)
            if body:
                parts.append(("heading", int(level.group(1)), body) if level else ("paragraph", 0, body))
    return joined(parts)


@reader(".odt")
def odt(raw: bytes) -> Parsed:
    parts = []
    for p in _xml(raw, "content.xml").iter():
        if _local(p.tag) in ("h", "p"):
            body = "".join(p.itertext()).strip()
            level = next((int(v) for k, v in p.attrib.items() if _local(k) == "outline-level" and v.isdigit()), 1)
            if body:
                parts.append(("heading", level, body) if _local(p.tag) == "h" else ("paragraph", 0, body))
    return joined(parts)


@reader(".rtf")
def rtf(raw: bytes) -> Parsed:
    text = re.sub(r"\\pard?\b ?", "\n", raw.decode("latin-1"))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", "", text)
    text = re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", text))
    return joined([("paragraph", 0, x.strip()) for x in text.split("\n") if x.strip()])


@reader(".epub")
def epub(raw: bytes) -> Parsed:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            pages = [z.read(n) for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm"))]
    except zipfile.BadZipFile as e:
        raise Unsupported(str(e)) from e
    return joined([(k, level, body) for page in pages for _, k, level, _, _, body, _ in html(page)[1]])


@reader(".pdf")
def pdf(raw: bytes) -> Parsed:
    """The text layer; needs a PDF library, else the file is skipped."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Unsupported("no PDF library") from e
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]
    return joined([("paragraph", 0, x.strip()) for page in pages for x in re.split(r"\n\s*\n", page) if x.strip()])


def parse(raw: bytes, extension: str) -> Parsed:
    """By extension; unknown ones are plain text."""
    return READERS.get(extension.lower(), plain)(raw)
