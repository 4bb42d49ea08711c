"""Functions paired with their documentation.

Comment spans and function spans are extracted independently of each other from
one lexer pass; an as-of interval join over their positions gives each function
the nearest eligible comment, unless a statement lies between.  Python looks
forward from the end of the header (the docstring), ECMAScript backward from the
start of the definition (the ``/** */`` block).  Both sides of the join come from
one file, so it runs as a merge of two sorted span lists where the file is read:
texts are never shuffled.

Documentation is trivial if it is blank, a placeholder or an unfilled form, says
no more than the function's own name, or only points elsewhere.

Defined results: null content and invalid files give nothing; repeated rows give
their functions once; several definitions on one line are told apart by name; an
empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import ast
import bisect
import inspect
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.lexing import PY_TOKEN, javascript_fault, line_ends, python_fault
from spanwright.llm.validity import _parses, _python, extension
from spanwright.runtime import spread

# fixed values: texts that stand where documentation was never written
PLACEHOLDERS = """todo; fixme; tbd; tba; xxx; wip; none; null; n/a; na; pass; docstring; undocumented; internal; description; summary; doc; docs; documentation; comment;
todo: write this; write this; write me; document me; fixme document me; to be documented; to be written; to be done; no description; no documentation; no docs; no docs yet; not documented; not documented yet;
add docs here; add docs; add description; add description here; add documentation; description goes here; your description here; insert description here; missing docstring; empty;
please document; please document this; please document this function; lorem ipsum; coming soon; see code; self-explanatory; self explanatory; placeholder; stub"""
_PLACEHOLDERS = {x.strip() for x in PLACEHOLDERS.replace("\n", " ").split(";")}
# fixed values: words that add nothing to a name
_FILLER = set("the a an this that given function method helper helpers routine procedure class module is are be used for to of and it its will would you your which does do implementation implements docstring simple simply just performs perform call calls called name in on with by from".split())
_OPENS_PLACEHOLDER = re.compile(
    r"(?:todo|fixme|xxx|tbd)\b[\s:.!-]*(?:(?:please |to )?(?:write|document|describe|add|fill|complete|explain|implement|finish)\b.*|(?:docs?|docstring|documentation|description)\b.*)?$"
    r"|please (?:document|describe|write|add|fill in|replace) (?:(?:this|me|the|it)\b.*)?$"
    r"|.*\b(?:placeholder|template)\b.*\b(?:replace|filled in|fill in|fill it|fill this)\b.*$|lorem ipsum\b.*$|.*\bto be (?:documented|filled in|written|replaced)(?: later| soon)?$",
    re.S,
)
_POINTER = re.compile(
    r"(?:please )?(?:(?:see|cf\.?|refer to|same as|as in|as for|look at|check|read|inherited from|overrides|copied from|like|equivalent to|alias (?:of|for)|@see|@inheritdoc|\{@inheritdoc\})(?: also)?[\s:]*"
    r"(?:the )?(?:above|below|there|elsewhere|docs?|documentation|manual|readme|wiki|base|super|parent|(?:base |super |parent )class(?: method)?|superclass|(?:corresponding |other )?(?:method|function|class|module)?\s*[`'\"]?:?[\w:~]*[`\w.]*(?:\(\))?[`'\"]?(?: (?:for (?:details|more|documentation|docs|help)|documentation|docs|method|function|class|module))?)?|inheritdoc|\{@inheritdoc\}|@inheritdoc)$"
)
_FIELD = re.compile(r"^\s*(?::(?:param|type|returns?|rtype|raises?|arg|keyword|yields?)\b[^:]*:|@(?:param|returns?|type|throws|yields|arg|deprecated)\b(?:\s*\{[^}]*\})?(?:\s+\[?[\w.$]+\]?)?)\s*-?\s*(.*)$")
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields|attributes|examples?|notes?|keyword args|keyword arguments)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^\s*\*{0,2}[\w]+(?:\s*\([^)]*\)|\s*:\s*[\w\[\], .|]+(?=\s*$))?\s*(?::|--?)?\s*(.*)$")
_UNFILLED = re.compile(r"^[\W_]*(?:_?(?:type|description|summary)_?|todo|tbd|fixme|none|n/?a|\.\.\.)?[\W_]*$", re.I)


def _stems(word: str) -> set[str]:
    out = {word}
    for tail in ("s", "es", "ed", "d", "ing", "er", "or", "ion"):
        if word.endswith(tail) and len(word) - len(tail) >= 2:
            out.add(word[: -len(tail)])
            out.add(word[: -len(tail)] + "e")
    if word.endswith("ies"):
        out.add(word[:-3] + "y")
    if len(out) > 1:
        out |= {x[:-1] for x in list(out) if len(x) > 3 and x[-1] == x[-2]}
    return out


def _name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", name)]


def trivial(doc: str, name: str) -> bool:
    """Does the documentation say nothing?  Filled-in fields or sections count as saying something."""
    summary, said = [], False
    in_section = False
    for line in doc.split("\n"):
        field = _FIELD.match(line)
        if field:
            said = said or not _UNFILLED.match(field[1])
        elif _SECTION.match(line):
            in_section = True
        elif re.match(r"^\s*[-=~]{3,}\s*$", line):
            continue
        elif in_section and line.strip():
            item = _ITEM.match(line)
            said = said or not _UNFILLED.match(item[1] if item else line)
        elif line.strip() and not said:
            summary.append(line.strip())
    text = " ".join(summary)
    plain = re.sub(r"\s+", " ", text).strip().lower()
    core = plain.strip(" .!?:;-_*`'\"()<>[]{}#/\\…–—~=+|")
    if not core:
        return not said
    if core in _PLACEHOLDERS or _OPENS_PLACEHOLDER.match(core) or re.fullmatch(r"[<{\[_].*[>}\]_]", plain) and len(core.split()) <= 3 or _POINTER.match(core):
        return not said
    if core.isascii():
        own = set().union(*(_stems(w) for w in _name_words(name))) if _name_words(name) else set()
        words = re.findall(r"[a-z]+", core.replace(name.lower(), " "))
        if all(w in _FILLER or _stems(w) & own for w in words):
            return not said
    return False


# ---------------------------------------------------------------- spans

_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?(def)[ \t]+([^\W\d]\w*)[ \t]*(?=[(\[])", re.M)
_GAP = re.compile(r"(?:[ \t\f]|\\\n|\n|#[^\n]*)*+")
_TAIL = re.compile(r"[ \t\f]*(?:;|#[^\n]*|\n|$)")
_BRACKET = re.compile(r"[()\[\]{}:]")


def _python_spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str]]]:
    """(string spans), (function spans: position of ``def``, end of the header's colon, name), independent of each other."""
    strings, quiet_at, quiet_end = [], [], []
    for m in PY_TOKEN.finditer(text):
        if m["string"]:
            strings.append((m.start(), m.end()))
        quiet_at.append(m.start())
        quiet_end.append(m.end())
    functions = []
    for m in _DEF.finditer(text):
        i = bisect.bisect_right(quiet_at, m.start(1)) - 1
        if i >= 0 and quiet_end[i] > m.start(1):
            continue  # within a string or a comment
        depth, at = 0, m.end()
        k = i + 1
        while True:
            b = _BRACKET.search(text, at)
            if b is None:
                break
            at = b.end()
            while k < len(quiet_at) and quiet_end[k] <= b.start():
                k += 1
            if k < len(quiet_at) and quiet_at[k] <= b.start():
                at = quiet_end[k]
                continue
            c = b[0]
            if c in "([{":
                depth += 1
            elif c != ":":
                depth -= 1
            elif depth == 0:
                functions.append((m.start(1), at, m[2]))
                break
    return strings, functions


def _python_ends(text: str, tree: ast.AST) -> dict[int, int]:
    """End of each function by the start of its header's line."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    out, rest = {}, [tree]
    while rest:
        node = rest.pop()
        for field in ("body", "orelse", "finalbody", "handlers", "cases"):  # statements alone can hold functions
            below = getattr(node, field, None)
            if isinstance(below, list):
                rest.extend(below)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            start, line = lines[node.end_lineno - 1]
            col = node.end_col_offset  # in bytes
            out[lines[node.lineno - 1][0]] = start + (col if line.isascii() else len(line.encode()[:col].decode()))
    return out


def _joined_python(text: str, whole: bool, tree: ast.AST | None) -> Iterator[tuple]:
    """As-of join, forward: the first string at or after a header's end, with nothing but space and comments between."""
    strings, functions = _python_spans(text)
    starts = [s for s, _ in strings]
    ends = _python_ends(text, tree) if whole and tree and functions else {}
    for at, end, name in functions:
        i = bisect.bisect_left(starts, end)
        if i == len(starts):
            continue
        opened, gap = 0, _GAP.match(text, end).end()
        while text.startswith("(", gap):  # a docstring may stand in brackets
            opened += 1
            gap = _GAP.match(text, gap + 1).end()
        if gap != starts[i]:
            continue
        parts, stop = [], gap
        while i < len(strings) and strings[i][0] == gap:
            parts.append(text[strings[i][0] : strings[i][1]])
            stop = strings[i][1]
            i += 1
            gap = _GAP.match(text, stop).end() if opened else re.compile(r"(?:[ \t\f]|\\\n)*").match(text, stop).end()
        while opened and text.startswith(")", gap):
            opened -= 1
            stop = gap + 1
            gap = _GAP.match(text, stop).end() if opened else stop
        if opened or not _TAIL.match(text, stop) or any(re.match(r"[rRuU]*[bBfF]", p) for p in parts):
            continue
        try:
            doc = "".join(ast.literal_eval(p) for p in parts)
        except (SyntaxError, ValueError):
            continue
        if not whole:
            yield at, name, inspect.cleandoc(doc)
            continue
        begin = text.rfind("\n", 0, at) + 1
        yield at, name, inspect.cleandoc(doc), text[begin:end].lstrip(), text[end : ends[begin]] if begin in ends else None


def _joined_javascript(text: str, whole: bool) -> Iterator[tuple]:
    """As-of join, backward: the last ``/** */`` that ends before a definition, with only white space between."""
    functions: list[tuple[str, int, int]] = []
    comments: list[tuple[int, int]] = []
    brackets: dict[int, int] | None = {} if whole else None
    if javascript_fault(text, functions, comments, brackets) is not None:
        return
    opens = sorted(brackets or ())
    ends = [e for _, e in comments]
    for name, at, start in functions:
        i = bisect.bisect_right(ends, start) - 1
        if i < 0 or text[ends[i] : start].strip():
            continue
        body = text[comments[i][0] + 3 : comments[i][1] - 2]
        doc = "\n".join(re.sub(r"^\s*\*(?!\*) ?", "", x).strip() for x in body.split("\n")).strip()
        if not whole:
            yield at, name, doc
            continue
        head = brackets[opens[bisect.bisect_left(opens, at + len(name))]]  # end of the parameters
        brace = opens[bisect.bisect_left(opens, head)]
        yield at, name, doc, text[start:brace].rstrip(), text[brace : brackets[brace]]


def pairs_of(ext: str, content: str, whole: bool = False) -> list[tuple]:
    """(line, name, documentation[, signature, body]) of the documented functions of one valid file.

    The signature runs to the header's colon or before the body's bracket; the body
    is all that follows, a docstring included (null where nesting is too deep for the
    exact parser).
    """
    text = line_ends(content)
    if ext in ("py", "pyi"):
        trees: list[ast.AST] = []
        if "def" not in text or python_fault(text) or not _parses(text, lambda x: trees.append(_python(x))):
            return []
        found = _joined_python(text, whole, trees[0] if trees else None)
    else:
        found = _joined_javascript(text, whole)
    out, line, last = [], 1, 0
    for at, name, doc, *code in sorted(found):
        line += text.count("\n", last, at)
        last = at
        if not trivial(doc, name):
            out.append((line, name, doc, *code))
    return out


_PAIRS = "file_id long, start_line int, func_name string, documentation string, signature string, body string"


def documented_functions(files: DataFrame, with_text: bool = True) -> DataFrame:
    """(file_id, start_line, func_name[, documentation, signature, body]) of functions with documentation that says something."""
    kinds = _PAIRS if with_text else ", ".join(_PAIRS.split(", ")[:3])
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        for b in batches:
            ids, rows = [], []
            for i, e, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = pairs_of(e, c, with_text)
                ids.extend([i] * len(found))
                rows.extend(found)
            lines, *texts = list(zip(*rows))[: len(names) - 1] if rows else [()] * (len(names) - 1)
            cols = [pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), *(pa.array(x, pa.string()) for x in texts)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    read = files.select("file_id", extension().alias("ext"), "content").where(F.col("content").isNotNull() & F.col("ext").isin("py", "pyi", "js", "mjs"))
    return spread(read).mapInArrow(run, kinds).distinct()
