import json

from spanwright.sources import files as S
from spanwright.sources.html import html_to_text, pages_to_text
from spanwright.sources.pysource import components, resolve_relative, rows_of, signature_variants


def test_source_tree_and_sinks(spark, tmp_path):
    root = tmp_path / "repo.d"
    (root / "pkg" / "build").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("x = 1\n")
    (root / "pkg" / "a.py").write_text("def f(): pass\n")
    (root / "pkg" / "build" / "b.py").write_text("")
    (root / "pkg" / "n.txt").write_text("no")
    df = S.source_tree(spark, str(root), exclude="/build/")
    assert {r.module: r.content for r in df.collect()} == {"pkg": "x = 1\n", "pkg.a": "def f(): pass\n"}
    keyed = df.withColumn("cache_key", S.cache_key("module", "content"))
    assert S.not_cached(keyed, keyed.where("module = 'pkg'")).count() == 1
    out = spark.createDataFrame([(1, ["a"], {"k": "v"})], "id int, xs array<string>, m map<string,string>")
    S.write_csv(out, str(tmp_path / "csv"))
    S.write_json(out, str(tmp_path / "json"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first().id == "1"
    assert spark.read.json(str(tmp_path / "json")).first().xs == ["a"]
    assert S.append_new(out.union(out), out.where("false"), "id").count() == 1


def test_rows_of_source():
    src = 'import os.path as p\nfrom ..m import *\n__all__ = ["A"]\nclass A(B, metaclass=M):\n    """Doc."""\n    y: int = 1\n    @d\n    async def f(self, a, /, b: int = 2, *c, k="z", **kw) -> str:\n        pass\ntry:\n    import q\nexcept ImportError:\n    q = None\n'
    got = [(r[0], r[1], r[2]) for r in rows_of("﻿" + src)]
    assert got == [("import", "p", None), ("import", "*", None), ("exports", "__all__", None), ("class", "A", None), ("variable", "y", "A"), ("function", "f", "A"), ("import", "q", None), ("variable", "q", None)]
    detail = next(r[6] for r in rows_of(src) if r[1] == "f")
    assert detail["signatures"] == {
        "full": "f(a, /, b: int=2, *c, k='z', **kw) -> str", "no_types": "f(a, /, b=2, *c, k='z', **kw)", "no_defaults": "f(a, /, b: int, *c, k, **kw) -> str", "names": "f(a, b, *c, k, **kw)",
        "no_slash": "f(a, b: int=2, *c, k='z', **kw) -> str", "no_types_no_slash": "f(a, b=2, *c, k='z', **kw)",
    }
    assert rows_of("x = (")[0][:2] == ("error", "SyntaxError") and rows_of("") == []
    assert signature_variants("g", [], None) == {"full": "g()"}


def test_components_table(spark):
    df = spark.createDataFrame([(1, "def f():\n    'Doc.'\n"), (2, None), (3, "x = (")], "file_id long, content string")
    assert {(r.file_id, r.kind, r.name, r.doc) for r in components(df).collect()} == {(1, "function", "f", "Doc."), (3, "error", "SyntaxError", None)}
    assert components(df.where("false")).count() == 0


def test_relative_imports():
    assert resolve_relative("a.b.c", 0, "x") == "x" and resolve_relative("a.b.c", 1, "x") == "a.b.c.x" and resolve_relative("a.b.c", 3, None) == "a" and resolve_relative("a", 2, "x") is None


def test_html(spark):
    html = "<html><head><style>p{}</style></head><body><nav>menu</nav><h2>Title</h2><p>Some <b>bold</b>  text &amp; <a href='x.html#f'>link</a></p><ul><li>one<li>two</ul><pre>a\n  b</pre><table><tr><td>1</td><td>2</td></tr></table><script>x()</script></body></html>"
    text, links = html_to_text(html, "https://h.example/d/")
    assert text == "## Title\n\nSome bold text & link\n\n- one\n- two\n\n```\na\n  b\n```\n\n| 1 | 2 |" and links == ["https://h.example/d/x.html#f"]
    df = spark.createDataFrame([(1, "https://h/", html), (2, None, None)], "id int, url string, html string")
    got = {r.id: (r.text[:8], len(r.links)) for r in pages_to_text(df).collect()}
    assert got == {1: ("## Title", 1), 2: ("", 0)}
