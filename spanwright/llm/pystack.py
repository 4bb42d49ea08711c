"""A pushdown recogniser for Python: indentation and block stacks, a bracket stack, operands and operators in turn.

It knows no more grammar than which token may follow which in which frame, what
a line's first word asks for, and which blocks belong together, and so finds
the faults that truncation, other languages and old syntax leave.  It is no
parser: what it passes may still break a rule it does not know.
"""

from __future__ import annotations

import re

_STR = r"""(?:[rRbBuU]|[rR][bB]|[bB][rR])?(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"(?!"")(?:[^"\\\n]|\\[\s\S])*+"|'(?!'')(?:[^'\\\n]|\\[\s\S])*+'|""|'')"""
TOKEN = re.compile(
    rf"""[ \t\f]*+(?:\\\n[ \t\f]*+)*+(?:(?P<name>[^\W\d]\w*+(?!["']))
    |(?P<op>[()\[\]{{}},]|(?:\*\*|//|>>|<<|[+\-*/%&|^@=!<>])=|:=|\.\.\.|->|\*\*|//|>>|<<|[+\-*/%@&|^~<>:;=]|\.(?!\d))|(?P<nl>\n)|(?P<fstr>(?:[fF][rR]?|[rR][fF])(?:\"{{3}}|'{{3}}|"|'))|(?P<str>{_STR})
    |(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
    |(?P<comment>\#[^\n]*)|(?P<word>[^\W\d]\w*)|(?P<end>\Z)|(?P<bad>[\s\S]))""",
    re.X,
)
_PLAIN_STR = re.compile(_STR)
_WORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_VALUES = frozenset(("None", "True", "False"))
_COMPOUND = frozenset("if elif else for while try except finally with def class async match case".split())
_BINARY = frozenset("+ - * / // % @ ** << >> & | ^ < > <= >= == !=".split())
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_AFTER = {"except": ("try", "except"), "finally": ("try", "except", "else-try"), "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except")}
_CLOSER = {")": "(", "]": "[", "}": "{"}


def fstring_end(text: str, at: int, quote: str) -> int:
    """Where an f-string whose opening quote ends at ``at`` ends, -1 if it does not; expressions may hold any quotes and brackets."""
    depth, n, one = 0, len(text), len(quote) == 1
    spec: list[int] = []  # depths at which a format specification has begun
    while at < n:
        c = text[at]
        if depth == 0 or spec and spec[-1] == depth:
            if c == "\\":
                at += 2
                continue
            if text.startswith(quote, at):
                return at + len(quote)
            if c == "\n" and one:
                return -1
            if c == "{":
                if depth == 0 and text[at + 1 : at + 2] == "{":
                    at += 2
                    continue
                depth += 1
            elif c == "}" and depth:
                if spec and spec[-1] == depth:
                    spec.pop()
                depth -= 1
            at += 1
            continue
        if c in "\"'":
            m = _PLAIN_STR.match(text, at)
            if not m:
                return -1
            at = m.end()
            continue
        if c in "fFrR" and (m := re.compile(r"(?:[fF][rR]?|[rR][fF])(\"{3}|'{3}|\"|')").match(text, at)) and not (text[at - 1].isalnum() or text[at - 1] == "_"):
            at = fstring_end(text, m.end(), m[1])
            if at < 0:
                return -1
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and (depth == 1 or spec and depth == spec[-1] + 1):
            spec.append(depth)
        elif c == "#":
            at = text.find("\n", at)
            if at < 0:
                return -1
            continue
        at += 1
    return -1


class _Fault(Exception):
    pass


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out: list[tuple[str, str, int]] = []
    add, at, n = out.append, 0, len(text)
    while True:
        for m in TOKEN.finditer(text, at):
            kind = m.lastgroup
            if kind == "name" or kind == "op" or kind == "nl":
                add((kind, m[kind], m.start(kind)))
            elif kind == "str" or kind == "num":
                add((kind, m[kind], m.start(kind)))
            elif kind == "fstr":
                at = fstring_end(text, m.end(), m[kind].lstrip("fFrR"))
                if at < 0:
                    raise _Fault("unterminated")
                add(("str", "f", m.start(kind)))
                break
            elif kind == "word":
                add(("name", m[kind], m.start(kind)))
            elif kind == "end":
                add(("nl", "", n))
                add(("end", "", n))
                return out
            elif kind == "bad":
                raise _Fault("unterminated" if m[kind] in "\"'" else "premature" if m[kind] == "\\" and m.end() >= n else "char")


def _columns(text: str, start: int) -> tuple[int, int]:
    """Indentation of the line a token begins, with tabs as eight columns and as one."""
    begin = text.rfind("\n", 0, start) + 1
    gap = text[begin:start]
    if not gap or gap.isspace() and "\t" not in gap and "\f" not in gap:
        return len(gap), len(gap)
    col = alt = 0
    for c in gap:
        if c == " ":
            col += 1
            alt += 1
        elif c == "\t":
            col = (col // 8 + 1) * 8
            alt += 1
        elif c == "\f":
            col = alt = 0
        else:
            break
    return col, alt


def _lines(tokens: list[tuple[str, str, int]]):
    """Logical lines: token lists up to a line end outside brackets."""
    line: list[tuple[str, str, int]] = []
    stack: list[str] = []
    for t in tokens:
        kind, s, _ = t
        if kind == "nl":
            if not stack and line:
                yield line
                line = []
            continue
        if kind == "end":
            break
        if kind == "op":
            if s in "([{":
                stack.append(s)
            elif s in _CLOSER:
                if not stack or stack.pop() != _CLOSER[s]:
                    raise _Fault("unbalanced")
        line.append(t)
    if stack:
        raise _Fault("premature")


def _heads_block(line, word: str) -> bool:
    """Is there a colon outside brackets, at the end for ``match``?"""
    depth = 0
    for kind, s, _ in line:
        if kind == "op":
            depth += (s in "([{") - (s in _CLOSER)
            if s == ":" and not depth and word == "case":
                return True
    return line[-1][0] == "op" and line[-1][1] == ":"


def fault(text: str) -> str | None:
    """The kind of the first fault, or None."""
    try:
        return _check(text)
    except _Fault as e:
        return e.args[0]


def _check(text: str) -> str | None:
    if "\x00" in text:
        return "char"
    indents: list[tuple[int, int]] = [(0, 0)]
    last: list[str | None] = [None]  # the compound statement that each open block's last one was
    want_block = decorated = False
    for line in _lines(_tokens(text)):
        start = line[0][2]
        col, alt = _columns(text, start)
        top = indents[-1]
        if want_block:
            if col <= top[0] or alt <= top[1]:
                return "grammar"
            indents.append((col, alt))
            last.append(None)
        elif col != top[0] or alt != top[1]:
            if col > top[0] or alt > top[1] and col == top[0]:
                return "grammar"
            while col < indents[-1][0]:
                if last.pop() == "try":
                    return "grammar"
                indents.pop()
            if (col, alt) != indents[-1]:
                return "grammar"
        first = line[0][1] if line[0][0] == "name" else ""
        head = first if first in _COMPOUND else ""
        if first in ("match", "case"):
            second = line[1] if len(line) > 1 else ("", "", 0)
            soft = _heads_block(line, first) and len(line) > 2 and not (second[0] == "op" and second[1] in (".", "=", ",", ":", ")", "]", ":=") or second[1] in _AUGMENTED)
            head = first if soft else ""
        if head == "async":
            head = line[1][1] if len(line) > 1 and line[1][1] in ("def", "for", "with") else "?"
            if head == "?":
                return "grammar"
        before = last[-1]
        if head in _AFTER:
            if before not in _AFTER[head]:
                return "grammar"
        elif before == "try":
            return "grammar"
        if decorated and not (head in ("def", "class") or line[0][1] == "@"):
            return "grammar"
        decorated = line[0][0] == "op" and line[0][1] == "@"
        last[-1] = ("else-try" if head == "else" and before == "except" else head) or None
        want_block = _statement(line, head, decorated)
    if want_block or decorated:
        return "premature"
    return "grammar" if "try" in last else None


def _statement(line, head: str, decorator: bool) -> bool:
    """Recognise a logical line; does it ask for a block?"""
    at = 0
    if head:
        at = 2 if line[0][1] == "async" else 1
        body = _expression(line, at, head)
        if body < 0:
            raise _Fault("grammar")
        if body == len(line):
            return True
        at = body
    elif decorator:
        at = 1
    while at < len(line):
        at = _simple(line, at)
    return False


def _simple(line, at: int) -> int:
    """One simple statement from ``at``; where the next begins."""
    first = line[at][1] if line[at][0] == "name" else ""
    if first in _COMPOUND - {"match", "case"}:
        raise _Fault("grammar")
    if first == "type" and at + 2 < len(line) and line[at + 1][0] == "name" and line[at + 2][1] in ("=", "["):
        return _expression(line, at + 1, "type")
    if first in ("return", "raise", "del", "assert", "import", "from", "global", "nonlocal", "pass", "break", "continue"):
        return _expression(line, at + 1, first)
    return _expression(line, at, "")


def _expression(line, at: int, stmt: str) -> int:
    """Recognise the rest of a statement of kind ``stmt`` from ``at``.

    Returns the place after its ``;`` or, for a compound head, after its colon; the line's length at its end.
    """
    n = len(line)
    frames: list[str] = []
    compound = stmt in _COMPOUND
    # need: 2 an operand or the end (after a comma or an opener), 1 an operand, 0 an operator
    need = 2 if stmt in ("return", "raise", "pass", "break", "continue", "try", "else", "finally", "except", "") else 1
    if stmt in ("pass", "break", "continue", "try", "else", "finally"):
        need = 0
    prev = stmt or "start"
    imported = stmt != "from"
    start, dots = at, 0
    if stmt in ("def", "class") and (at >= n or line[at][0] != "name" or line[at][1] in _WORDS):
        raise _Fault("grammar")
    while at < n:
        kind, s, _ = line[at]
        at += 1
        frame = frames[-1] if frames else ""
        if kind == "name":
            word = s in _WORDS
            if need:
                if s == "in" and need == 2 and prev == ",":
                    need = 1
                elif not word or s in ("not", "await"):
                    if not word:
                        if prev == "." and s in _VALUES:
                            raise _Fault("grammar")
                        need = 0
                    elif prev == ".":
                        raise _Fault("grammar")
                    else:
                        need = 1
                elif s == "import" and stmt == "from" and not imported and dots and at - 1 > start:
                    imported, need = True, 1
                elif prev == ".":
                    raise _Fault("grammar")
                elif s == "lambda":
                    frames.append("l")
                    need = 2
                elif s == "yield":
                    need = 2
                elif s == "from" and prev == "yield":
                    need = 1
                else:
                    raise _Fault("grammar")
            elif s in ("and", "or", "in", "is"):
                need = 1
            elif s == "not":
                if at >= n or line[at][1] != "in":
                    raise _Fault("grammar")
                at += 1
                s, need = "in", 1
            elif s in ("if", "else"):
                need = 1
                if s == "else" and prev == "if":
                    raise _Fault("grammar")
            elif s == "for" and frame in ("(", "[", "{", "c", "i"):
                need = 1
            elif s == "async" and frame in ("(", "[", "{", "c", "i") and at < n and line[at][1] == "for":
                at += 1
                s, need = "for", 1
            elif s == "as" and (stmt in ("import", "with", "except", "case") or stmt == "from" and imported):
                need = 1
            elif s == "from" and stmt == "raise" and not frames:
                need = 1
            elif s == "import" and stmt == "from" and not imported:
                imported, need = True, 1
            else:
                raise _Fault("grammar")
        elif kind == "str":
            if prev == "." or not need and prev != "str":
                raise _Fault("grammar")
            need, s = 0, "str"
        elif kind == "num":
            if not need or prev == "." or re.fullmatch(r"0[\d_]*[1-9][\d_]*", s):
                raise _Fault("grammar")
            need = 0
        elif s in "([{":
            if prev == ".":
                raise _Fault("grammar")
            if need:
                frames.append("d" if s == "(" and stmt == "def" and not frames and prev == "name?" else s)
            elif s == "(":
                frames.append("d" if stmt == "def" and not frames and "->" not in [t[1] for t in line[start : at - 1]] and sum(t[1] == "(" for t in line[start : at - 1]) == 0 else "c")
            elif s == "[":
                frames.append("i")
            else:
                raise _Fault("grammar")
            need = 2
        elif s in _CLOSER:
            while frames and frames[-1] == "l":
                raise _Fault("grammar")
            if not frames or need == 1:
                raise _Fault("grammar")
            opened = frames.pop()
            if {"(": "(", "c": "(", "d": "(", "[": "[", "i": "[", "{": "{"}[opened] != _CLOSER[s]:
                raise _Fault("unbalanced")
            need = 0
        elif s == ",":
            params = frame in ("d", "l")
            if stmt in ("raise", "while", "if", "elif") and not frames or need and not (params and prev in ("*", "/") or frame == "i" and prev == ":"):
                raise _Fault("grammar")
            need = 2
        elif s == ":":
            if frame == "l":
                if need == 1 and prev != "*":
                    raise _Fault("grammar")
                frames.pop()
                need = 1
            elif frame == "i":
                if need == 1 and prev != ":":
                    raise _Fault("grammar")
                need = 2
            elif frame in ("{", "d"):
                if need:
                    raise _Fault("grammar")
                need = 1
            elif frames:
                raise _Fault("grammar")
            elif compound:
                if need == 1 or need == 2 and prev not in ("except", ",") or prev in ("if", "while", "for", "with", "class", "def") and need:
                    raise _Fault("grammar")
                if stmt in ("for",) and not any(t[1] == "in" for t in line[start:at]) or stmt in ("def",) and not any(t[1] == "(" for t in line[start:at]):
                    raise _Fault("grammar")
                return at
            else:
                if need or stmt:
                    raise _Fault("grammar")
                need = 1
        elif s == "=":
            if need and not (need == 2 and prev == "," and not frames) or frame in ("(", "[", "{") or frame == "i" and stmt not in ("def", "class", "type") or not frames and (compound or stmt not in ("", "type")):
                raise _Fault("grammar")
            need = 1
        elif s in _AUGMENTED:
            if need or frames or stmt:
                raise _Fault("grammar")
            need = 1
        elif s == ":=":
            if need or not (frames or compound):
                raise _Fault("grammar")
            need = 1
        elif s == ";":
            if frames or need == 1 or compound or need == 2 and prev == "start":
                raise _Fault("grammar")
            return at
        elif s == "->":
            if need or frames or stmt != "def":
                raise _Fault("grammar")
            need = 1
        elif s == ".":
            if not imported:
                dots += 1
                need = 2 if need else 1
                if prev != "." and need == 1:
                    pass
            elif need:
                raise _Fault("grammar")
            else:
                need = 1
        elif s == "...":
            if not imported:
                dots += 3
                need = 2
            elif not need:
                raise _Fault("grammar")
            else:
                need = 0
        elif need:
            if s in "+-~" and prev != ".":
                need = 1
            elif s == "*" and stmt == "from" and imported and prev == "import":
                need = 0
            elif s in ("*", "**") and prev in ("(", "[", "{", ",", "=", "start", "return", "yield", "in", "for", "except", "lambda", "case", "del", "start:", ":", "d"):
                need = 1
            elif s == "/" and frame in ("d", "l") and prev == ",":
                need = 0
            else:
                raise _Fault("grammar")
        elif s in _BINARY:
            need = 1
            if s in ("*", "**", "/"):
                s = "op"
        else:
            raise _Fault("grammar")
        prev = s
    if compound:
        raise _Fault("grammar")
    if frames or need == 1 and not (stmt == "from" and not imported):
        raise _Fault("grammar")
    if stmt == "from" and not imported or stmt in ("import", "del", "assert", "global", "nonlocal") and at == start:
        raise _Fault("grammar")
    return n
