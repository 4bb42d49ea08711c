"""Lexers with a pushdown stack for Python, ECMAScript modules, JSON and TOML.

Each ``*_fault`` function returns None for a clean text or the kind of the first
fault: ``conflict`` (merge-conflict marker), ``unterminated`` (literal or comment
that does not end), ``unbalanced`` (a closer that does not match), ``premature``
(the text ends inside something), ``char`` (a character no token starts with) or
``grammar`` (a token where the stack allows none).
"""

from __future__ import annotations

import re

CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|\|{7}(?: .*)?|>{7}(?: .*)?)$", re.M)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def line_ends(text: str) -> str:
    """Without a byte-order mark, every line end as ``\\n``."""
    if text[:1] == "\ufeff":
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _brackets(marks: str) -> str | None:
    stack: list[str] = []
    for c in marks:
        if c in "([{":
            stack.append(c)
        elif not stack or stack.pop() != _CLOSES[c]:
            return "unbalanced"
    return "premature" if stack else None


# ---------------------------------------------------------------- Python

PY_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)
    |(?P<string>(?<![A-Za-z0-9_])(?P<prefix>[rRbBuUfF]{0,2})(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}
      |"(?!"")(?:[^"\\\n]|\\[\s\S])*+"|'(?!'')(?:[^'\\\n]|\\[\s\S])*+'))
    |(?P<loose>["'])""",
    re.X,
)
_NOT_BRACKET = re.compile(r"[^()\[\]{}]+")
_PY_ODD = re.compile(r"[$?!`\u2018-\u201f\ufffd\x00-\x08\x0e-\x1f](?!=)")


def _py_plain(m: re.Match) -> str:
    return "" if m["comment"] else m[0] if m["loose"] else "''"


def python_fault(text: str) -> str | None:
    """Faults the lexer is sure of; a text with nested f-string quotes is never called unterminated."""
    if "\x00" in text:
        return "char"
    rest = PY_TOKEN.sub(_py_plain, text)
    bare = rest.replace("''", "")
    if '"' in bare or "'" in bare:
        return None if re.search(r"[fF][rR]?[\"']|[rR][fF][\"']", text) else "unterminated"
    if ("<<<<<<<" in bare or "=======" in bare or ">>>>>>>" in bare) and CONFLICT.search(bare):
        return "conflict"
    if _PY_ODD.search(bare):
        return "char"
    return _brackets(_NOT_BRACKET.sub("", bare))


# ---------------------------------------------------------------- JSON

_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b)|([{}\[\],:])|($))')


def json_fault(text: str) -> str | None:
    """A complete pushdown recogniser of RFC 8259."""
    at, stack, want, end = 0, [], "value", len(text)
    match = _JSON_TOKEN.match
    while True:
        m = match(text, at)
        if m is None:
            found = text[at:].lstrip()[:1]
            if CONFLICT.search(text, at) and found in "<=>|":
                return "conflict"
            return "unterminated" if found == '"' and '"' not in text[at:].lstrip()[1:] else "grammar" if found.isascii() else "char"
        at, kind = m.end(), m.lastindex
        if kind == 4:
            return None if want == "end" and not stack else "premature"
        if kind in (1, 2):
            if want in ("value", "first") or kind == 1 and want in ("key", "firstkey"):
                want = "colon" if want in ("key", "firstkey") else "comma" if stack else "end"
                continue
            return "grammar"
        c = m[3]
        if c in "{[":
            if want not in ("value", "first"):
                return "grammar"
            stack.append(c)
            want = "firstkey" if c == "{" else "first"
        elif c in "}]":
            if not stack or stack[-1] != _CLOSES[c]:
                return "unbalanced"
            if want not in ("comma", "firstkey" if c == "}" else "first"):
                return "grammar"
            stack.pop()
            want = "comma" if stack else "end"
        elif c == ":" and want == "colon":
            want = "value"
        elif c == "," and want == "comma":
            want = "key" if stack[-1] == "{" else "value"
        else:
            return "grammar"
        if at >= end and stack:
            return "premature"


# ---------------------------------------------------------------- TOML

_TOML_STRING = r'"""(?:[^"\\]|\\[\s\S]|"{1,2}(?!"))*+"{3,5}|\'\'\'(?:[^\']|\'{1,2}(?!\'))*+\'{3,5}|"(?!"")(?:[^"\\\n]|\\[^\n])*+"|\'(?!\'\')[^\'\n]*+\''
_TOML_TOKEN = re.compile(rf"(?P<ws>[ \t]+|\#[^\n]*)|(?P<nl>\n)|(?P<str>{_TOML_STRING})|(?P<bare>[A-Za-z0-9_+.:-]+)|(?P<p>[=\[\]{{}},])|(?P<bad>[\s\S])")
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?|\.")
_TOML_VALUE = re.compile(
    r"true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|\d{4}-\d\d-\d\d(?:[Tt]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
)


def toml_fault(text: str) -> str | None:
    """Lexer and stack for TOML 1.0; what needs the keys seen so far is left to the exact check."""
    if re.search(r"[\x00-\x08\x0b-\x1f\x7f]", text):
        return "char"
    stack: list[str] = []
    want, now = "line", " "  # want: line, key, eq, value, first, comma, end
    for m in _TOML_TOKEN.finditer(text):
        kind, tok = m.lastgroup, m[0]
        if kind == "ws":
            continue
        last, now = now, tok
        if kind == "nl":
            if stack and stack[-1] == "[":
                continue
            if stack or want not in ("line", "end"):
                return "premature"
            want = "line"
        elif kind == "bad":
            if tok in "\"'":
                return "unterminated"
            return "conflict" if CONFLICT.search(text) and tok in "<>|" else "grammar" if tok.isascii() else "char"
        elif want == "line":
            if tok == "[":
                stack.append("h")
                want = "key"
            elif kind == "str" or kind == "bare" and _TOML_KEY.fullmatch(tok):
                want = "eq"
            else:
                return "conflict" if CONFLICT.search(text) and tok[0] in "<=>|" else "grammar"
        elif want == "key":
            if stack and stack[-1] == "h" and tok == "[" and text[m.start() - 1] == "[":
                stack[-1] = "hh"
            elif kind == "str" or kind == "bare" and _TOML_KEY.fullmatch(tok):
                want = "eq"
            elif tok == "}" and stack and stack[-1] == "{":
                stack.pop()
                want = "comma" if stack else "end"
            else:
                return "grammar"
        elif want == "eq":
            if kind in ("str", "bare"):
                if kind == "bare" and not _TOML_KEY.fullmatch(tok) or tok[0] != "." and last[-1] != ".":
                    return "grammar"
            elif stack and stack[-1] in ("h", "hh"):
                if tok != "]":
                    return "grammar"
                if stack[-1] == "hh":
                    stack[-1] = "h"
                else:
                    stack.pop()
                    want = "end"
            elif tok == "=":
                want = "value"
            else:
                return "grammar"
        elif want in ("value", "first"):
            if tok == "[":
                stack.append("[")
                want = "first"
            elif tok == "{":
                stack.append("{")
                want = "key"
            elif tok == "]" and stack and stack[-1] == "[":
                stack.pop()
                want = "comma" if stack else "end"
            elif kind == "str" or kind == "bare" and _TOML_VALUE.fullmatch(tok):
                want = "comma" if stack else "end"
            elif kind == "bare" and re.match(r"\d{4}-\d\d-\d\d", tok):
                want = "comma" if stack else "end"
            else:
                return "grammar"
        elif want == "comma":
            if tok == ",":
                want = "first" if stack[-1] == "[" else "key"
            elif tok in _CLOSES and stack and stack[-1] == _CLOSES[tok]:
                stack.pop()
                want = "comma" if stack else "end"
            else:
                return "unbalanced" if tok in _CLOSES else "grammar"
        else:
            return "grammar"
    if stack or want not in ("line", "end"):
        return "premature"
    return None


# ---------------------------------------------------------------- ECMAScript module

_JS_TOKEN = re.compile(
    r"""[ \t\v\f\u00a0\ufeff]*+(?:(?P<nl>[\n\u2028\u2029])|(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<ws>\Z)
    |(?P<id>\#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)
    |(?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01_]+|0[oO][0-7_]+|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?)n?(?![\w$]))
    |(?P<str>"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')
    |(?P<tpl>`)
    |(?P<op>=>|\.\.\.|\?\.(?!\d)|>>>=|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|===|!==|\*\*|\+\+|--|<<|>>|&&|\|\||\?\?|[=!<>]=|[+\-*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.]))""",
    re.X,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
_JS_NAME = r"(?:[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)"
_JS_SPEC = rf"\{{\s*(?:(?:{_JS_NAME}|\"[^\"\n]*\"|'[^'\n]*')(?:\s+as\s+(?:{_JS_NAME}|\"[^\"\n]*\"|'[^'\n]*'))?\s*(?:,\s*(?=[\w$\"'}}\u0080-\uffff])|(?=\}})))*\}}"
_JS_STR = r"(?:\"[^\"\n]*\"|'[^'\n]*')"
_JS_IMPORT = re.compile(rf"import\s*(?:{_JS_STR}|(?:\s{_JS_NAME}\s*(?:,\s*(?:\*\s*as\s+{_JS_NAME}|{_JS_SPEC}))?|\*\s*as\s+{_JS_NAME}|{_JS_SPEC})\s*from\s*{_JS_STR})")
_JS_EXPORT = re.compile(rf"export\s*(?:\*\s*(?:as\s+{_JS_NAME}\s+)?from\s*{_JS_STR}|{_JS_SPEC}(?:\s*from\s*{_JS_STR})?)")
_PREFIX_WORDS = {"typeof", "void", "delete", "await", "new", "yield"}
_BINARY_WORDS = {"in", "of", "instanceof"}
_HEADED = {"if", "while", "for", "switch", "with", "catch"}
_RESERVED = {"break", "case", "catch", "const", "continue", "debugger", "default", "do", "else", "enum", "export", "extends", "finally", "for", "if", "import", "return", "switch", "throw", "try", "var", "while", "with"}
_BINARY_OPS = frozenset("=> >>>= **= <<= >>= >>> &&= ||= ??= === !== ** << >> && || ?? == != <= >= += -= *= /= %= &= |= ^= < > + - * / % & | ^ =".split())


class _Frame:
    """One open bracket: what it is, what its end makes of it, ternaries open in it, the state to return to."""

    __slots__ = ("kind", "after", "ternary", "sub")

    def __init__(self, kind: str, after: str, sub: str = ""):
        self.kind, self.after, self.sub, self.ternary = kind, after, sub, 0


_JS_BRACKETS = frozenset("()[]{}")


def javascript_fault(text: str, found: list | None = None, comments: list | None = None, brackets: dict | None = None) -> str | None:
    """Pushdown recogniser of the statement and expression skeleton of a module.

    found gets (name, position of the name, position where the definition starts)
    of function declarations and methods; comments gets (start, end) of ``/** */``;
    brackets gets the end of each bracket by its start.
    state: ``stmt`` a statement may start; ``operand``; ``operator``; ``member`` a
    class element or object key may start; ``aftkey`` right after such a key; and
    short ones that expect one particular thing.
    """
    if "\x00" in text:
        return "char"
    at, n, state, newline = 0, len(text), "stmt", True
    frames = [_Frame("block", "stmt")]
    empty_ok = False  # may a closer come although an operand is awaited
    pending = ""  # what a following ( or { belongs to
    start = name_at = 0
    name = ""
    key_mod = False
    opened: list[int] = []
    last_bracket = -1  # some tokens are looked at twice
    match = _JS_TOKEN.match
    if text.startswith("#!"):
        at = (text + "\n").index("\n")
    while at < n:
        if newline and text[at] in "<=>|" and (at == 0 or text[at - 1] == "\n") and CONFLICT.match(text, at):
            return "conflict"
        m = match(text, at)
        kind = m.lastgroup if m else ""
        if kind == "ws":
            break
        if kind == "nl":
            newline = True
            at = m.end()
            continue
        if kind == "line":
            at = m.end()
            continue
        if kind == "block":
            if comments is not None and m["block"].startswith("/**") and len(m["block"]) > 4:
                comments.append((m.start("block"), m.end()))
            newline = newline or "\n" in m[0]
            at = m.end()
            continue
        if not m:
            at += len(text[at:]) - len(text[at:].lstrip(" \t\v\f\u00a0\ufeff"))
            c = text[at]
            if c in "\"'" or c == "/" and text.startswith("/*", at):
                return "unterminated"
            return "grammar" if c.isascii() else "char"
        tok, pos, at = m[kind], m.start(kind), m.end()
        top = frames[-1]
        # a template's middle part ends with the bracket of its substitution
        if tok == "}" and top.kind == "tpl" and state == "operator":
            kind, tok = "tpl", "}`"
            frames.pop()
            top, state = frames[-1], "operand"
        if kind == "tpl":
            if state == "stmt":
                state = "operand"
            elif state == "operator" and tok == "`":
                state = "operand"  # tagged
            elif state != "operand":
                return "grammar"
            t = _JS_TEMPLATE.match(text, at)
            if not t:
                return "unterminated"
            at = t.end()
            if t[1] == "`":
                state = "operator"
            else:
                frames.append(_Frame("tpl", "operator"))
                state, empty_ok = "operand", False
            newline = False
            continue
        if tok in ("/", "/=") and state in ("operand", "stmt"):
            r = _JS_REGEX.match(text, pos)
            if not r:
                return "unterminated"
            at, kind, tok = r.end(), "str", "//"
        if brackets is not None and pos > last_bracket and tok in _JS_BRACKETS:
            last_bracket = pos
            if tok in "([{":
                opened.append(pos)
            elif opened:
                brackets[opened.pop()] = pos + 1
        if kind == "id" and not tok.isascii() and not tok.lstrip("#").replace("$", "_").replace("\u200c", "").replace("\u200d", "").isidentifier():
            return "char"
        was_newline, newline = newline, False

        if state == "name":  # after . or ?.
            if kind == "id":
                state = "operator"
                continue
            if tok in ("(", "[") or kind == "tpl":
                state = "operator"
            else:
                return "grammar"
        if state == "fname":  # after function
            if tok == "*":
                continue
            if kind == "id" and tok not in _RESERVED:
                name, name_at, state = tok, pos, "fparen"
                continue
            name, state = "", "fparen"
        if state == "fparen":
            if tok != "(":
                return "grammar"
            frames.append(_Frame("paren", "fbody", pending))
            if found is not None and name:
                found.append((name, name_at, start))
            state, empty_ok = "operand", True
            continue
        if state == "fbody":
            if tok != "{":
                return "grammar"
            frames.append(_Frame("block", top_after))
            state = "stmt"
            continue
        if state == "head":
            if tok == "await":
                continue
            if tok == "{" and pending == "catch":
                frames.append(_Frame("block", "stmt"))
                state = "stmt"
                continue
            if tok != "(":
                return "grammar"
            frames.append(_Frame("paren", "stmt", "for" if pending == "for" else "head"))
            state, empty_ok = "operand", pending == "for"
            continue
        if state == "cname":
            if kind == "id" and tok not in ("extends",) and tok not in _RESERVED:
                state = "chead"
                continue
            state = "chead"
        if state == "chead":
            if tok == "extends":
                state, empty_ok = "operand", False
                frames.append(_Frame("heritage", class_after))
                continue
            if tok != "{":
                return "grammar"
            frames.append(_Frame("class", class_after))
            state, key_mod = "member", False
            continue
        if state == "bind":
            if kind == "id" and tok not in _RESERVED:
                state = "operator"
                continue
            if tok not in ("[", "{"):
                return "grammar"
            state = "operand"
        if state == "member":
            if tok == "}":
                frames.pop()
                state = top.after
                continue
            if not key_mod:
                start = pos
            if top.kind == "class" and tok == ";":
                key_mod = False
                continue
            if tok == "*":
                key_mod = True
                continue
            if kind == "id" and tok in ("static", "async", "get", "set"):
                name, name_at, state, key_mod = tok, pos, "aftkey", True
                continue
            if kind in ("id", "str", "num"):
                name, name_at, state, key_mod = tok, pos, "aftkey", False
                continue
            if tok == "[":
                frames.append(_Frame("brack", "aftkey", "computed"))
                name, state, empty_ok, key_mod = "", "operand", False, False
                continue
            if top.kind == "obj" and tok == "...":
                state, empty_ok = "operand", False
                continue
            return "grammar"
        if state == "aftkey":
            if tok == "(":
                if found is not None and name and top.kind == "class":
                    found.append((name, name_at, start))
                top_after = "member" if top.kind == "class" else "aftval"
                frames.append(_Frame("paren", "fbody", top_after))
                state, empty_ok, key_mod = "operand", True, False
                continue
            if key_mod and (kind in ("id", "str", "num") or tok in ("*", "[")):  # it was a modifier
                state = "member"
                at = pos
                if name == "static" and tok == "{":
                    pass
                continue
            if key_mod and tok == "{" and name == "static":
                frames.append(_Frame("block", "member"))
                state, key_mod = "stmt", False
                continue
            key_mod = False
            if top.kind == "obj":
                if tok == ":" or tok == "=":
                    state, empty_ok = "operand", False
                    continue
                if tok == ",":
                    state = "member"
                    continue
                if tok == "}":
                    frames.pop()
                    state = top.after
                    continue
                return "grammar"
            if tok == "=":
                state, empty_ok = "operand", False
                continue
            if tok == ";":
                state = "member"
                continue
            if was_newline or tok == "}":
                state, at = "member", pos
                continue
            return "grammar"
        if state == "aftval":  # after an object's method
            if tok == ",":
                state = "member"
                continue
            if tok == "}":
                frames.pop()
                state = top.after
                continue
            return "grammar"

        if state == "stmt":
            start = pos
            empty_ok = False
            if kind == "id":
                if tok == "import":
                    i = _JS_IMPORT.match(text, pos)
                    if i:
                        at, state = i.end(), "operator"
                        continue
                    rest = text[at : at + 200].lstrip()
                    if rest[:1] not in ("(", "."):
                        return "grammar"
                    state = "operator"
                    continue
                if tok == "export":
                    i = _JS_EXPORT.match(text, pos)
                    if i:
                        at, state = i.end(), "operator"
                        continue
                    rest = re.match(r"\s*(default|const|let|var|function|class|async)\b", text[at : at + 400])
                    if not rest:
                        return "grammar"
                    if rest[1] == "default":
                        at += rest.end()
                        if not re.match(r"\s*(?:async\s+function|function|class)\b", text[at : at + 400]):
                            state = "operand"
                            continue
                    keep = pos
                    m = re.compile(r"\s*").match(text, at)
                    at = m.end()
                    nxt = _JS_TOKEN.match(text, at)
                    if nxt is None:
                        return "premature"
                    tok, kind, pos, at = nxt[nxt.lastgroup], nxt.lastgroup, nxt.start(nxt.lastgroup), nxt.end()
                    start = keep
                    if tok not in ("const", "let", "var", "function", "class", "async"):
                        return "grammar"
                if tok == "function":
                    top_after, pending, state = "stmt", "stmt", "fname"
                    continue
                if tok == "async" and (a := re.compile(r"[ \t]+function\b").match(text, at)):
                    at, top_after, pending, state = a.end(), "stmt", "stmt", "fname"
                    continue
                if tok == "class":
                    class_after, state = "stmt", "cname"
                    continue
                if tok in _HEADED:
                    pending, state = tok, "head"
                    continue
                if tok in ("else", "do", "try", "finally"):
                    continue
                if tok in ("var", "let", "const"):
                    state = "bind"
                    continue
                if tok in ("return", "throw"):
                    state, empty_ok = "operand", tok == "return"
                    continue
                if tok in ("break", "continue", "debugger"):
                    state = "operator"
                    lab = re.compile(r"[ \t]+[A-Za-z_$][\w$]*").match(text, at)
                    if lab and tok != "debugger":
                        at = lab.end()
                    continue
                if tok == "case":
                    state = "operand"
                    top.ternary += 1
                    top.sub = "case"
                    continue
                if tok == "default":
                    d = re.compile(r"\s*:").match(text, at)
                    if not d:
                        return "grammar"
                    at = d.end()
                    continue
                if tok in _RESERVED:
                    return "grammar"
                if tok not in _PREFIX_WORDS and tok not in ("this", "super") and (lab := re.compile(r"\s*:(?!:)").match(text, at)):
                    at = lab.end()
                    continue
                state = "operand"
            elif tok == "{":
                frames.append(_Frame("block", "stmt"))
                continue
            elif tok == ";":
                continue
            elif tok == "}":
                if len(frames) == 1:
                    return "unbalanced"
                if top.kind != "block":
                    return "unbalanced"
                frames.pop()
                state = top.after
                if state == "operand":
                    state = "operator"
                continue
            else:
                state = "operand"

        if state == "operand":
            if kind == "id":
                if tok == "function":
                    top_after, pending, name, state = "operator", "operand", "", "fname"
                    continue
                if tok == "async":
                    a = re.compile(r"[ \t]+function\b").match(text, at)
                    if a:
                        at, top_after, pending, state = a.end(), "operator", "operand", "fname"
                        continue
                    if re.compile(r"[ \t]*(?:\(|[A-Za-z_$][\w$]*[ \t]*=>)").match(text, at):
                        continue
                    state = "operator"
                    continue
                if tok == "class":
                    class_after, state = "operator", "cname"
                    continue
                if tok in _PREFIX_WORDS:
                    if tok == "yield":
                        empty_ok = True
                    if tok == "new" and text.startswith(".target", at):
                        at += 7
                        state = "operator"
                    continue
                if tok in ("let", "const", "var") and top.kind == "paren" and top.sub == "for":
                    state = "bind"
                    continue
                if tok in _RESERVED and tok != "import":
                    return "grammar"
                state = "operator"
                continue
            if kind in ("str", "num"):
                state = "operator"
                continue
            if tok in ("!", "~", "+", "-", "++", "--"):
                empty_ok = False
                continue
            if tok == "(":
                frames.append(_Frame("paren", "operator", "group"))
                empty_ok = True
                continue
            if tok == "[":
                frames.append(_Frame("brack", "operator", "array"))
                empty_ok = True
                continue
            if tok == "{":
                if pending == "=>":
                    frames.append(_Frame("block", "arrowend"))
                    state, pending = "stmt", ""
                    continue
                frames.append(_Frame("obj", "operator"))
                state, key_mod = "member", False
                continue
            if tok == "..." and top.kind in ("paren", "brack"):
                continue
            if tok == "*" and re.search(r"yield\s*$", text[max(0, pos - 12) : pos]):
                continue
            if tok == "," and top.kind == "brack" and top.sub == "array":
                empty_ok = True
                continue
            if tok == ";" and top.kind == "paren" and top.sub == "for":
                empty_ok = True
                continue
            if empty_ok and tok in (")", "]", ";", "}", ",", ":"):
                state = "operator"  # nothing here; the closer is treated below
                if tok == ")" and top.kind == "paren" and top.sub == "group" and not re.compile(r"[ \t]*=>").match(text, at):
                    return "grammar"
            else:
                return "unbalanced" if tok in _CLOSES and (top.kind not in ("paren", "brack", "obj", "tpl") and tok != "}" or len(frames) == 1) else "grammar"
        empty_ok = False

        # state is operator (or arrowend)
        if state == "arrowend" and tok not in (")", "]", "}", ",", ";", ":", "(") and not was_newline:
            return "grammar"
        state = "operator"
        if tok in _CLOSES:
            while top.kind == "heritage":
                frames.pop()
                top = frames[-1]
            if tok == ")":
                if top.kind != "paren":
                    return "unbalanced"
                if top.ternary:
                    return "grammar"
                frames.pop()
                state = top.after
                if state == "fbody":
                    top_after = "stmt" if top.sub == "stmt" else "operator" if top.sub == "operand" else top.sub
                if state == "stmt":
                    start = at
            elif tok == "]":
                if top.kind != "brack":
                    return "unbalanced"
                frames.pop()
                state = top.after
            else:
                if top.kind == "obj":
                    frames.pop()
                    state = top.after
                elif top.kind == "class":
                    frames.pop()
                    state = top.after
                elif top.kind == "block" and len(frames) > 1:
                    frames.pop()
                    state = top.after
                else:
                    return "unbalanced"
            continue
        if tok == ";":
            if top.kind == "paren":
                if top.sub != "for":
                    return "grammar"
                state, empty_ok = "operand", True
            elif top.kind == "block":
                if top.ternary:
                    return "grammar"
                state = "stmt"
            elif top.kind == "class":
                state = "member"
            else:
                return "grammar"
            continue
        if tok == ",":
            if top.kind == "obj":
                state = "member"
            else:
                state, empty_ok = "operand", top.kind in ("paren", "brack")
                if top.kind == "block":
                    empty_ok = False
            continue
        if tok == "=>":
            state, pending = "operand", "=>"
            nxt = re.compile(r"\s*\{").match(text, at)
            if not nxt:
                pending = ""
            continue
        if tok == "?":
            top.ternary += 1
            state = "operand"
            continue
        if tok == ":":
            if not top.ternary:
                return "grammar"
            top.ternary -= 1
            if top.sub == "case" and not top.ternary:
                top.sub, state = "", "stmt"
            else:
                state = "operand"
            continue
        if tok in (".", "?."):
            state = "name"
            continue
        if tok == "{" and top.kind == "heritage":
            frames.pop()
            frames.append(_Frame("class", top.after))
            state, key_mod = "member", False
            continue
        if tok == "(" and not (was_newline and False):
            frames.append(_Frame("paren", "operator", "call"))
            state, empty_ok = "operand", True
            continue
        if tok == "[":
            frames.append(_Frame("brack", "operator", "index"))
            state = "operand"
            continue
        if tok in ("++", "--") and not was_newline:
            continue
        if tok in _BINARY_OPS or kind == "id" and tok in _BINARY_WORDS:
            state = "operand"
            continue
        if was_newline and top.kind in ("block", "class"):  # a line end may stand for ;
            if top.ternary:
                return "grammar"
            state, at, newline = ("stmt" if top.kind == "block" else "member"), pos, True
            key_mod = False
            continue
        return "grammar"
    if len(frames) > 1 or state not in ("stmt", "operator", "arrowend") and not (state == "operand" and empty_ok):
        return "premature"
    if frames[0].ternary:
        return "grammar"
    return None
