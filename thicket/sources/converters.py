"""Conversion of files to Markdown. HTML and DOCX need the standard library only; others plug in a ``Converter``."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from typing import Protocol
from xml.etree import ElementTree


class Converter(Protocol):
    """Bytes of one file to Markdown; raises where it can't."""

    def convert(self, name: str, content: bytes) -> str: ...


def _pipe_table(rows: list[list[str]]) -> str:
    wide = max(map(len, rows))
    rows = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] + [""] * (wide - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in (rows[0], ["---"] * wide, *rows[1:]))


class _Html(HTMLParser):
    """Headings, paragraphs, lists, tables and code; scripts, styles, navigation and footers are left out."""

    DROP = {"script", "style", "nav", "footer", "template", "head"}
    BLOCK = {"p", "div", "section", "article", "main", "header", "ul", "ol", "blockquote", "body", "figure", "br"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.drop = 0
        self.prefix = ""
        self.pre = False
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        raw = "".join(self.text)
        self.text = []
        if self.pre:
            self.out.append("```\n" + raw.strip("\n") + "\n```")
        elif body := re.sub(r"\s+", " ", raw).strip():
            self.out.append(self.prefix + body)
        self.prefix = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.DROP:
            self.drop += 1
        elif self.drop:
            return
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.text = []
        elif self.rows is None and (tag in self.BLOCK or tag in ("li", "pre") or re.fullmatch(r"h[1-6]", tag)):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " " if re.fullmatch(r"h[1-6]", tag) else "- " if tag == "li" else ""
            self.pre = tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROP:
            self.drop = max(0, self.drop - 1)
        elif self.drop:
            return
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("".join(self.text))
            self.text = []
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            self.rows = None
            self.text = []
            if rows:
                self.out.append(_pipe_table(rows))
        elif self.rows is None and (tag in self.BLOCK or tag in ("li", "pre") or re.fullmatch(r"h[1-6]", tag)):
            self.flush()
            self.pre = False

    def handle_data(self, data: str) -> None:
        if not self.drop:
            self.text.append(data)


def html_to_markdown(html: str) -> str:
    p = _Html()
    p.feed(html)
    p.close()
    p.flush()
    joined = ""
    for block in p.out:
        joined += ("" if not joined else "\n" if block.startswith("- ") and joined.rsplit("\n", 1)[-1].startswith("- ") else "\n\n") + block
    return joined


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_to_markdown(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(e: ElementTree.Element) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "\t" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}br", f"{_W}tab"))

    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            if rows := [[text(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]:
                out.append(_pipe_table(rows))
        elif e.tag == f"{_W}p" and (t := text(e).strip()):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            m = re.fullmatch(r"[Hh]eading ?([1-6])", name)
            out.append(f"{'#' * int(m[1])} {t}" if m else f"- {t}" if name.startswith("List") else t)
    return "\n\n".join(out)


class StandardConverter:
    """HTML and DOCX. PDF needs a converter with layout analysis and recognition of characters, which is not here."""

    def convert(self, name: str, content: bytes) -> str:
        suffix = name.lower().rpartition(".")[2]
        if suffix == "html":
            return html_to_markdown(content.decode("utf-8", "replace"))
        if suffix == "docx":
            return docx_to_markdown(content)
        raise NotImplementedError(f"no converter for .{suffix}; plug one in")
