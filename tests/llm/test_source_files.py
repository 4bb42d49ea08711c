import ast
import json
import tomllib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwright.llm.docpairs import documented_functions, pairs_of, trivial
from spanwright.llm.lexing import javascript_fault, json_fault, python_fault, toml_fault
from spanwright.llm.origin import foreign_files, validation
from spanwright.llm.validity import checked_files, fault, invalid_files, invalid_rates

FILES = "file_id long, library string, file_path string, language string, content string, fault string, ext string"


def strict_json(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
        return True
    except ValueError:
        return False


_json = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(_json, st.data())
def test_json_agrees_with_a_parser(value, data):
    text = json.dumps(value, indent=data.draw(st.sampled_from([None, 2])), ensure_ascii=data.draw(st.booleans()))
    assert json_fault(text) is None
    at = data.draw(st.integers(0, len(text)))
    cut = text[:at] + data.draw(st.sampled_from(["", ",", "}", "]", '"', "x", " ", "\n"])) + text[at + data.draw(st.integers(0, 2)) :]
    assert (json_fault(cut) is None) == strict_json(cut)


@pytest.mark.parametrize("text", ['a = 1\n[x]\nb = "c" # d\n', "[[a.b]]\nk = [1, 2,\n 3]\n", "d = 1979-05-27T07:32:00Z\nx = {a = 1, b.c = 'z'}\n", 't = """\n======= x\n"""\n', "f = +1_0.5e-3\n\"q r\" = inf\n", ""])
def test_toml_valid(text):
    tomllib.loads(text)
    assert toml_fault(text) is None


@pytest.mark.parametrize("text", ["a = ", "a = [1, 2\n", "a = 'x\n", "= 1\n", "a b = 1\n", "[x\n", "a = 1 2\n", "{% if x %}\n", "x = “y”\n", "<<<<<<< HEAD\na = 1\n"])
def test_toml_invalid(text):
    assert toml_fault(text) is not None


@pytest.mark.parametrize(
    "text",
    [
        "import a, { b as c } from './x.js';\nimport * as ns from 'y';\nexport default class A extends B { static #p = 1; get x() { return this.#p; } async *g() { yield 1; } ['k']() {} static { f(); } }\n",
        "const f = async (a, { b = 2 }, ...c) => { for (const [k, v] of Object.entries(a)) { if (k) continue; else v; } };\nlet x = a ? b : c ? d : e\nlet y = /[/]\\/(/g.test(s) / 2\n",
        "label: for (;;) { break label; }\nswitch (x) { case 1: case (a ? b : c): f(); break; default: g() }\ntry { a() } catch { b() } finally { c() }\n",
        "x = `a ${b ? `${c}` : {d: 1}.d} e`;\nvar o = { a, b: 1, 'c': 2, [d]: 3, e() {}, get f() { return 1 }, ...g };\nif (a) b\nelse c\ndo { i++ } while (i < 3)\n",
        "!function(){function q(e,t){var r=0;return r?q.c=e:!0}}();\nexport const z = new Map([[1, 2],]);\nexport { z as w };\nawait import('q');\n",
        "#!/usr/bin/env node\nconst a = 1_000n ?? b?.c?.[d]?.(e)\n;[1,2].map(x => x * 2)\n/** doc */\n",
        "",
    ],
)
def test_javascript_valid(text):
    assert javascript_fault(text) is None


@pytest.mark.parametrize(
    "text",
    ["function f( {", "const a = ;", "class A {\n  f() {\n", "let s = 'abc\n", "x = (1 + 2;\n", "def f(x):\n    return x\n", "<<<<<<< HEAD\nlet a = 1\n=======\n", "a = `b ${c", "/* x", "if (a) }", "const a = “b”;", "function f(a: number) {}", "let a b = 1", "# Notes\n\n* a", "foo(]\n", "class A { const x = 1 }"],
)
def test_javascript_invalid(text):
    assert javascript_fault(text) is not None


@pytest.mark.parametrize("text", ["x = (1,\n", "s = 'abc\n", "'''open\n", "a = [1)\n", "<<<<<<< a\nx = 1\n", "x = “y”\n", "a = 1\x00"])
def test_python_faults(text):
    assert python_fault(text) is not None


@pytest.mark.parametrize("text", ["x = '''a\n=======\n(''' # ]\n", "f'{a[\"b\"]}'\n", "x = r'\\\\'\n", "# (\n", "s = \"\\\"(\"\n", ""])
def test_python_clean(text):
    ast.parse(text)
    assert python_fault(text) is None


def test_fault_by_extension_and_marks():
    assert fault("py", "\ufeffx = 1\r\n") is None and fault("py", "if x:\n") == "premature" and fault("json", "") == "premature" and fault("toml", "a = 1\na = 2\n") == "parser"
    assert fault("mjs", "\ufeffexport const a = 1;\r") is None


def test_files(spark):
    data = [(1, "l", "a/b.py", None, "x = (", "x", None), (1, "l", "a/b.py", None, "x = (", "x", None), (2, "l", "a\\c.JSON", None, "{}", None, None), (3, None, "d.toml", "x", None, None, None), (4, "l", "README", None, "(", None, None), (5, "m", None, None, "(", None, None), (6, "m", "q.js", None, "x = " + "(" * 5000 + "1" + ")" * 5000, None, None)]
    df = spark.createDataFrame(data, FILES)
    assert [r.file_id for r in invalid_files(df).collect()] == [1]
    assert {tuple(r) for r in invalid_rates(df).collect()} == {("l", "python", 1, 1, 0, 1.0), ("l", "json", 1, 0, 0, 0.0), ("m", "javascript", 1, 0, 0, 0.0)}
    assert checked_files(df.where("false")).count() == 0 and invalid_rates(df.where("false")).count() == 0


def test_pairs_python():
    src = '''
def a(x):
    """Adds one to x, or two on Sundays."""

class K:
    async def b(self, y: dict = {"k": ")"}) -> "t:u":  # note
        # comment
        ("Reads at most ten bytes "
         'and stops.')
    def c(self): "Walks the tree."; return 1
    def d(self):
        x = 1
        """not a docstring"""
    def e(self):
        "abc".strip()
    def f(self):
        b"bytes"
    def g(self):
        """def h(): pass"""
        def h():
            r"""Writes \\d to the log."""
s = """
def z():
    'No.'
"""
'''
    got = {(n, d) for _, n, d in pairs_of("py", src)}
    assert got == {("a", "Adds one to x, or two on Sundays."), ("b", "Reads at most ten bytes and stops."), ("c", "Walks the tree."), ("g", "def h(): pass"), ("h", "Writes \\d to the log.")}
    assert [r[0] for r in pairs_of("py", src) if r[1] == "a"] == [2]
    assert pairs_of("py", src + "(") == []


def test_pairs_javascript():
    src = """/** File header. */
import a from 'a';
/** Closes the file after use. */
export async function one(x) { return 1; }
/** Opens it. */
const t = 1;
function two() {}
class K {
  /**
   * Turns left twice.
   * @param {number} a angle
   */
  three(a) {}
  /* Not documentation. */
  four() {}
  /** TODO */
  static five() {}
}
"""
    assert pairs_of("js", src) == [(4, "one", "Closes the file after use."), (13, "three", "Turns left twice.\n@param {number} a angle")]


def test_pairs_carry_signature_and_body(spark):
    py = "class K:\n    async def f(self, a={'é': 1}) -> int:  # ü\n        'Walks the whole tree.'\n        s = 'é'; return 'ü'  # end\n\n    def g(self): 'Reads at most ten bytes.'\n\nx = 1\n"
    js = "class K {\n  /** Turns left twice. */\n  static three(a = {b: ')'}, c = (1)) /* { */ {\n    if (/[}]/.test(`${a}`)) { return () => { return 1; }; }\n  }\n}\n/** Closes the file after use. */\nexport async function one([x]) { return {x}; }\n"
    files = [(1, "l", "a.py", None, py, None, None), (2, "l", "a.js", None, js, None, None)]
    got = {r.func_name: (r.signature, r.body) for r in documented_functions(spark.createDataFrame(files, FILES)).collect()}
    assert got == {
        "f": ("async def f(self, a={'é': 1}) -> int:", "  # ü\n        'Walks the whole tree.'\n        s = 'é'; return 'ü'"),
        "g": ("def g(self):", " 'Reads at most ten bytes.'"),
        "three": ("static three(a = {b: ')'}, c = (1)) /* { */", "{\n    if (/[}]/.test(`${a}`)) { return () => { return 1; }; }\n  }"),
        "one": ("export async function one([x])", "{ return {x}; }"),
    }


@pytest.mark.parametrize("doc", ["", "  ", "TODO", "TODO: write this", "_summary_", "<description>", "...", "-", "See above.", "Same as other.", "Method load_tile.", "Loads the tile.", "This function loads the tile.", "load_tile()", ":param x:\n:returns:", "Args:\n    x (_type_): _description_", "N/A", "Docstring for load_tile.", "Inherited from base.", "Please document this function before the next release!"])
def test_trivial(doc):
    assert trivial(doc, "load_tile")


@pytest.mark.parametrize("doc", ["Loads the tile from disk.", "See above for the format; this end decodes it.", "TODO markers are kept as they are.", "Returns -1 on a closed tile.", "若队列为空则立即返回", "Same as the plain one but twice as fast on large tiles.", ":param x: the width in metres", "None of the entries is touched."])
def test_not_trivial(doc):
    assert not trivial(doc, "load_tile")


def test_documented_functions_nulls_and_repeats(spark):
    data = [(1, "l", "a.py", None, "def f():\n    'Walks it all.'\n", None, None)] * 2 + [(2, "l", "a.py", None, None, None, None), (3, "l", "a.json", None, "{}", None, None), (4, "l", None, None, "x", None, None)]
    df = spark.createDataFrame(data, FILES)
    assert [tuple(r) for r in documented_functions(df, with_text=False).collect()] == [(1, 1, "f")]
    assert documented_functions(df.where("false")).count() == 0


def test_origin(spark, small):
    files, libs, pats = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("source_files", "libraries", "exclude_patterns"))
    v = validation(files, libs, pats).first()
    assert v.n_held_out > 0
    found = foreign_files(files, libs, pats)
    n = found.count()
    assert 0 < n < files.count() and found.distinct().count() == n
    extra = files.select("file_id", "file_path", "content", "library").where("false")
    assert foreign_files(extra, libs, pats).count() == 0


def test_origin_nulls_long_texts_and_repeats(spark):
    libs = spark.createDataFrame([(1, "lib"), (2, "other")], "lib_int int, library string")
    pats = spark.createDataFrame([("lib", "vendor/", "dir"), ("lib", None, "file")], "library string, pattern string, pattern_kind string")
    gen = "# @generated from x.proto\n" + "".join(f"_F{i} = _Field(name='f{i}', number={i}, wire=0)\n" for i in range(60))
    own = "import lib.core\n\n\ndef walk(path):\n    return [p for p in path if p]\n"
    rows = [(i, "lib", f"lib/a{i}.py" if i % 3 else None, "python", gen if i % 2 else own, None, "x") for i in range(60)]
    rows += [(100, None, None, None, None, None, None), (101, "lib", "lib/e.py", None, "", None, None), (102, "lib", "lib/l.js", None, "//\n" * 50_000 + "x", None, None), rows[1], rows[1]]
    found = [r.file_id for r in foreign_files(spark.createDataFrame(rows, FILES), libs, pats).collect()]
    assert len(found) == len(set(found)) and {i for i in range(60) if i % 2} <= set(found) and not {100, 101} & set(found) and not {i for i in range(0, 60, 2)} & set(found)
