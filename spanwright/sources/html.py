"""HTML to text and links with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: elements whose text is no content, elements that start a new block
_DROP = {"script", "style", "nav", "footer", "header", "aside", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "ul", "ol", "dl", "table", "tr", "br", "blockquote", "dt", "dd", "main", "body"}


class _Text(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.dropped = 0
        self.pre = False
        self.cells: list[str] | None = None
        self.base = base or ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _DROP:
            self.dropped += 1
        if tag == "a" and a.get("href"):
            self.links.append(urljoin(self.base, a["href"]))
        if self.dropped:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag in _BLOCK:
            self.out.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped:
            return
        if tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag in _BLOCK or re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" if tag != "tr" else "|\n")

    def handle_data(self, data):
        if not self.dropped:
            flat = data if self.pre else re.sub(r"\s+", " ", data)
            self.out.append(flat.lstrip() if not self.pre and self.out and self.out[-1].endswith("\n") else flat)


def html_to_text(html: str | None, base: str | None = None) -> tuple[str, list[str]]:
    """(text, absolute links): headings as #, lists as -, code fenced, cells piped, at most one blank line."""
    p = _Text(base)
    p.feed(html or "")
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip(), list(dict.fromkeys(p.links))


def pages_to_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` key columns stay; ``html`` gives way to ``text string, links array<string>``; null pages give ''."""
    keep = [c for c in pages.columns if c != html]
    read = pages.select(*keep, html)
    schema = T.StructType([*read.drop(html).schema.fields, T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(keep.index(url)).to_pylist() if url in keep else [None] * b.num_rows
            done = [html_to_text(h, u) for h, u in zip(b.column(len(keep)).to_pylist(), urls)]
            cols = [*b.columns[: len(keep)], pa.array([t for t, _ in done], pa.string()), pa.array([x for _, x in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "links"])

    return read.mapInArrow(run, schema)
