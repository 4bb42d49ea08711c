"""Main text of scraped pages: a linear-chain CRF over the leaf blocks of a page.

A page that comes as HTML is taken apart into the leaf blocks of its DOM, each with
its ancestor tags (``dom_blocks``).  Text that was scraped already has lost its DOM; there
the lines are the leaf blocks, and the ancestors are what the scraper left of them
on a line: list bullets, indents, heading signs, prompts, pipes of table cells.

States: ``before`` (furniture up to the title), ``main``, ``within`` (controls and
notices put between main lines) and ``after``.  The features of a line are its
words with the page's own name and numbers masked, its shape, the marks that its
ancestors in the page left on it (list bullet, indent, heading sign, prompt), the
lines beside it, the first line of its block, and where the page's own name stands.

Training: a bounded sample of pages (about ``SAMPLE_PAGES``, by the hash of
scrape_id) is labelled by ``label_page`` from facts that hold for the sample as a
whole: where a page names its own member, which lines pages without that name
consist of, and which section headings carry an anchor sign.  The model is fitted
anew for each run, so sites the code has never seen are learnt from their pages.

Defined results: null, empty and blank texts have no main text; pages without a
main part give no rows; repeated rows give their lines once; blank lines are never
given; a null url or library only removes the features made from it; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanwright.llm.crf import LinearChain
from spanwright.llm.sampling import bounded_sample
from spanwright.runtime import spread

#: Pages used to learn the site furniture and to fit the CRF: what the sample costs does not grow with the input.
SAMPLE_PAGES = 4000
FIT_PAGES = 1500
BEFORE, MAIN, WITHIN, AFTER = range(4)
_BITS = 15

# fixed values: words that controls of web pages begin with, and notices; used to label the sample only
_CONTROL = re.compile(
    r"\[?(?:copy|print|share|edit|subscribe|expand|collapse|toggle|show|hide|read|open|run|load(?:ing)?|back|view|download|report|rate|sign|log|follow|tweet|like|source|jump|skip)\b[^.!?;]{0,60}(?:\.\.\.|…)?\]?$"
    r"|(?:advertise(?:ment)?|sponsored|ad)\b|(?:was|is|did) this\b.{0,30}\b(?:helpful|useful|help)\b|.{0,30}\bin (?:your|another) (?:language|browser)\b",
    re.I,
)
_ASIDE = re.compile(r"(?:advertise(?:ment)?|sponsored|ad)\b|(?:was|is|did) this\b.{0,30}\b(?:helpful|useful|help)\b", re.I)
_MONTH = re.compile(r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b")
_DIGITS = re.compile(r"\d[\d.,]*")
_SNAKE = re.compile(r"(?<![\w.])_?[a-z]+(?:_[a-z0-9]+)+(?:\(\))?(?![\w.])")
_CAMEL = re.compile(r"\b(?:[A-Z][a-z0-9]+){2,}\b")
_OWN = re.compile(r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*?)+?)(?:_[0-9a-z]+)?(?:\.html?)?$")
_ARROWS = re.compile(r"^(?:←|<|‹)\s|\s(?:→|>|›)$|^(?:next|previous|prev|related pages|up next|read next)\b(?:\s*:.*)?$|^previous\b.*\bnext\b", re.I)


def own_names(url: str | None, member_fqn: str | None, library: str | None) -> tuple[str, str]:
    """(full name, last part) of what the page is about, '' if unknown."""
    full = member_fqn or ""
    if not full and url:
        path, _, part = url.partition("#")
        m = re.fullmatch(r"([A-Za-z_]\w*(?:\.\w+)+)", part) or _OWN.match(path.rsplit("/", 1)[-1])
        full = m[1] if m else ""
    return full, full.rsplit(".", 1)[-1]


def _pattern(line: str, full: str, short: str, library: str | None) -> str:
    """The line with the page's name, the library and numbers masked."""
    s = line.replace("¶", "").strip()
    if full:
        s = s.replace(full, "OWNFULL")
    if short:
        s = re.sub(rf"(?<!\w){re.escape(short)}(?!\w)", "OWN", s)
    if library:
        s = s.replace(library, "LIB")
    s = _MONTH.sub("MON", _DIGITS.sub("0", s))
    s = re.sub(r"^[-*•]\s+", "", s)
    return _CAMEL.sub("CamelName", _SNAKE.sub("snake_name", s))


_TITLE = re.compile(r"(?:(?:class|def|function|method|module|exception)\s+)?(?:OWNFULL|LIB\.OWN|OWN)(?:\(.*\))?(?:\s+—\s+LIB.*)?$")


_HTML = re.compile(r"<(?:html|body|div|p|section|article|nav|main|ul|table|h[1-6])\b[^>]*>", re.I)
_LEAF_END = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "pre", "br", "section", "article", "nav", "header", "footer", "aside", "main", "ul", "ol", "dl", "table", "form", "button", "blockquote", "body"}


class _Dom(HTMLParser):
    """Leaf blocks: stretches of text between block tags, with the line they begin on and the tags that are open there."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[tuple[int, str, tuple[str, ...]]] = []
        self.text: list[str] = []
        self.line = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.line, text, tuple(self.open)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in _LEAF_END:
            self._flush()
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.open.append(tag)
            role = dict(attrs).get("role") or dict(attrs).get("class") or ""
            self.open[-1] += "." + role.split()[0].lower() if role.split() else ""

    def handle_endtag(self, tag):
        if tag in _LEAF_END:
            self._flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].split(".")[0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if data.strip() and not (self.open and self.open[-1].split(".")[0] in ("script", "style", "template")):
            if not self.text:
                self.line = self.getpos()[0] - 1 + data[: len(data) - len(data.lstrip())].count("\n")
            self.text.append(data)


def dom_blocks(html: str) -> list[tuple[int, str, tuple[str, ...]]]:
    """(line, text, ancestor tags) of the leaf blocks of an HTML page; a tag's class or role is written behind it."""
    dom = _Dom()
    dom.feed(html)
    dom.close()
    dom._flush()
    return dom.blocks


def _ancestors(raw: str) -> tuple[str, ...]:
    """The tags that a scraped line's marks are left of."""
    s = raw.strip()
    out = ["li"] if s[:1] in "-*•▪" and s[1:2] == " " else []
    out += ["pre"] if s.startswith((">>>", "...")) or raw.startswith("    ") else []
    out += ["h"] if s.endswith("¶") or s.startswith("#") else []
    out += ["td"] if "|" in s or "\t" in s else []
    return tuple([*(["nested"] if raw[:1].isspace() else []), *out]) or ("p",)


class Page:
    """The leaf blocks of one page with what the features need."""

    def __init__(self, text: str, url: str | None, fqn: str | None, library: str | None):
        full, short = own_names(url, fqn, library)
        self.tags: list[tuple[str, ...]] = []
        if _HTML.search(text):
            blocks = dom_blocks(text)
            self.at = [at for at, _, _ in blocks]
            self.raw = [t for _, t, _ in blocks]
            self.tags = [tags for _, _, tags in blocks]
            self.block, self.gap = [], []
            for i, tags in enumerate(self.tags):
                new = not i or self.tags[i - 1][:-1] != tags[:-1]
                self.gap.append(new)
                self.block.append(i if new else self.block[-1])
            self.pattern = [_pattern(x, full, short, library) for x in self.raw]
            self.title = [bool(short) and bool(_TITLE.match(p)) for p in self.pattern]
            return
        self.at: list[int] = []
        self.raw: list[str] = []
        self.block: list[int] = []  # index of the first line of the block
        self.gap: list[bool] = []
        first = 0
        blank = True
        for i, line in enumerate(text.split("\n")):
            if not line.strip():
                blank = True
                continue
            if blank:
                first = len(self.at)
            self.at.append(i)
            self.raw.append(line)
            self.tags.append(_ancestors(line))
            self.block.append(first)
            self.gap.append(blank)
            blank = False
        self.pattern = [_pattern(x, full, short, library) for x in self.raw]
        self.title = [bool(short) and bool(_TITLE.match(p)) for p in self.pattern]


def _shape(raw: str, s: str, p: str) -> list[str]:
    out = ["len%d" % min(9, len(s).bit_length()), "w%d" % min(8, s.count(" ") + 1), "end" + ("." if s[-1] in ".!?。！？”\"" else "¶" if s[-1] == "¶" else ":" if s[-1] == ":" else "a" if s[-1].isalnum() else s[-1])]
    if s[0] in "-*•☰←©>([\"":
        out.append("open" + s[0])
    if raw[0].isspace():
        out.append("indent")
    for mark in (" | ", " » ", " / ", " > ", "\t", " · ", "©", "  ", "→", "@", "–", ">>>", "(", " : "):
        if mark in s:
            out.append("has" + mark)
    if p in ("snake_name", "CamelName"):
        out.append(p)
    elif " " not in s:
        out.append("oneword")
    return out


def features(page: Page) -> list[list[int]]:
    """Hashed features of each line."""
    mask, n = (1 << _BITS) - 1, len(page.at)
    patterns = page.pattern
    first_title = next((i for i, t in enumerate(page.title) if t), n)
    seen = Counter(patterns)
    before: Counter = Counter()
    out = []
    opener = under = "^"  # the last two lines of the block that are no list entries
    for i in range(n):
        if page.gap[i]:
            opener = under = "^"
        raw = page.raw[i]
        s, p = raw.strip(), patterns[i]
        prev = patterns[i - 1] if i else "^"
        nxt = patterns[i + 1] if i + 1 < n else "$"
        head = patterns[page.block[i]]
        rel = "pre" if i < first_title else "own" if i == first_title else "post"
        shape = _shape(raw, s, p)
        words = p.lower().split()
        f = ["1", rel, "p" + p, rel + p, "T" if page.title[i] else "t", "g" if page.gap[i] else "G", "P" + prev, "N" + nxt, "B" + head, "BR" + head + rel, "notitle" if first_title == n else "titled"]
        f += shape
        f += [rel + x for x in shape]
        f += ["w" + w for w in words]
        f += ["b" + a + " " + b for a, b in zip(words, words[1:])]
        tags = page.tags[i]
        f += ["a" + t for t in tags] + ["aa" + ">".join(tags[-2:]), "aR" + tags[-1] + rel]
        if s[-1] == "¶":
            f.append("anchor")
        rest = seen[p] - before[p] - 1
        f.append("again" if rest else "once")
        f.append("was" if before[p] else "new")
        f.append("q%d%s" % (min(9, 10 * i // n), rel))
        if p in ("snake_name", "CamelName"):
            f.append("list" + head + rel)
            f += ["O" + opener, "U" + under, "OU" + opener + under, "OR" + opener + rel]
            f.append("under" + (prev if prev not in ("snake_name", "CamelName") else "same") + ("g" if page.gap[i] else "G"))
        else:
            opener, under = p, opener
        before[p] += 1
        out.append([crc32(x.encode()) & mask for x in f])
    return out


class Furniture:
    """What the sample says of lines: patterns of pages without a title or before one, and headings that carry an anchor."""

    def __init__(self, pages: list[Page]):
        self.known: Counter = Counter()
        self.pages: Counter = Counter()
        untitled: Counter = Counter()
        anchored: Counter = Counter()
        for page in pages:
            first = next((i for i, t in enumerate(page.title) if t), len(page.at))
            self.known.update(set(page.pattern[:first]))
            self.pages.update(set(page.pattern))
            if first == len(page.at):
                untitled.update(set(page.pattern))
            for i in range(first + 1, len(page.at)):
                if page.raw[i].rstrip().endswith("¶") and len(page.pattern[i].split()) <= 3:
                    anchored[page.pattern[i]] += 1
        self.headings = {h for h in anchored if not untitled[h]}
        #: section headings that are also entries of menus: the lines beside them decide
        self.unsure = {h for h in anchored if untitled[h]}
        self.long = [k for k, c in self.known.items() if c > 1 and len(k) > 9]

    def control(self, line: str, p: str) -> bool:
        """Does a line begin like a control of a page, and do other pages have it too?"""
        return p not in self.headings and bool(_CONTROL.match(line)) and (self.pages[p] > 2 or bool(_ASIDE.match(line)))

    def has(self, p: str) -> bool:
        if p in self.headings or p in ("snake_name", "CamelName"):
            return False
        if p in self.known or p in self.unsure:
            return True
        parts = [k for k in self.long if k in p]
        return len(parts) >= 2 or bool(parts) and (2 * max(map(len, parts)) > len(p) or "ponsored" in p)


def label_page(page: Page, furniture: Furniture) -> list[int]:
    """The states of a sample page's lines."""
    n = len(page.at)
    first = next((i for i, t in enumerate(page.title) if t), n)
    out = [BEFORE] * n
    kinds = []
    for i in range(first, n):
        s, p = page.raw[i].strip(), page.pattern[i]
        if i == first or page.title[i] and i == first + 1:
            kinds.append(MAIN)
        elif furniture.control(s, p):
            kinds.append(WITHIN)
        elif p in furniture.unsure and (s[-1] == "¶" or i + 1 < n and not page.gap[i + 1] and page.raw[i].lstrip()[0] not in "-*•" and not furniture.has(page.pattern[i + 1]) and page.pattern[i + 1] != "CamelName"):
            kinds.append(MAIN)
        elif p == "0" and page.pattern[i - 1].startswith(">>>"):
            kinds.append(MAIN)
        elif not page.gap[i] and _ARROWS.search(page.raw[i - 1].strip()) and kinds[-1] == AFTER:
            kinds.append(AFTER)
        elif furniture.has(p) or _ARROWS.search(s):
            kinds.append(AFTER)
        elif p in ("snake_name", "CamelName", "OWN"):
            # a list belongs to the section whose heading opens its block; else it is a list of other pages
            k = i - 1
            while k > first and not page.gap[k + 1] and (page.pattern[k] in ("snake_name", "CamelName", "OWN") or kinds[k - first] == WITHIN):
                k -= 1
            opened = k > first and not page.gap[k + 1] and (page.pattern[k] in furniture.headings or page.pattern[k] in furniture.unsure) and kinds[k - first] == MAIN
            kinds.append(MAIN if opened else AFTER)
        else:
            kinds.append(MAIN)
    last = max((k for k, x in enumerate(kinds) if x == MAIN), default=-1)
    for k, x in enumerate(kinds):
        out[first + k] = x if k <= last and x == MAIN else WITHIN if k < last else AFTER
    return out


_COLUMNS = ["scrape_id", "scraped_doc", "url", "member_fqn", "library"]


def fit(rows: list[tuple]) -> LinearChain:
    """The CRF of a sample of (text, url, member_fqn, library)."""
    pages = [Page(*r) for r in rows]
    furniture = Furniture(pages)
    kept = [p for p in pages[:FIT_PAGES] if p.at]  # the rows come in the order of their ids' hashes
    return LinearChain(4, 1 << _BITS).fit([features(p) for p in kept], [label_page(p, furniture) for p in kept], epochs=4)


def main_lines_of(model: LinearChain, text: str, url: str | None, fqn: str | None, library: str | None) -> list[int]:
    page = Page(text, url, fqn, library)
    return [at for at, state in zip(page.at, model.decode(features(page))) if state == MAIN]


def main_lines(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(scrape_id, line_no): the non-blank lines of each page's main text, line_no counted from 0 over ``\\n``."""
    spark = pages.sparkSession
    read = pages.select(*_COLUMNS).where("scraped_doc is not null and scrape_id is not null and trim(scraped_doc) <> ''")
    sample = {r[0]: tuple(r)[1:] for r in bounded_sample(read, "scrape_id", sample_pages)}
    model = fit([sample[k] for k in sorted(sample, key=lambda k: crc32(str(k).encode()))])
    used = np.flatnonzero(np.abs(model.weights).max(1) > 1e-4)
    shared = spark.sparkContext.broadcast((used, model.weights[used].astype(np.float16), model.moves, model.first, model.last))  # 2**15 rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = LinearChain(4, 1 << _BITS)
        ids, weights, chain.moves, chain.first, chain.last = shared.value
        chain.weights[ids] = weights
        for b in batches:
            keys, lines = [], []
            for key, *cells in zip(*(c.to_pylist() for c in b.columns)):
                found = main_lines_of(chain, *cells)
                keys.extend([key] * len(found))
                lines.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.int32())], names=["scrape_id", "line_no"])

    return spread(read).mapInArrow(run, "scrape_id long, line_no int").distinct()
