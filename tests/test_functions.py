from pyspark.sql import functions as F

from spanwright.functions import columns as C
from spanwright.functions import text as X
from spanwright.functions import types as T
from spanwright.functions import urls as U


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("x")).first().x


def test_presence(spark):
    for v in (None, "", "  ", "n/a", " None ", "TBD"):
        assert not one(spark, v, F.coalesce(C.is_present("v"), F.lit(False)))
    assert one(spark, "0", C.is_present("v")) and one(spark, "na!", C.is_present("v"))


def test_names_and_paths(spark):
    assert one(spark, "a.b.c", C.name_prefixes("v")) == ["a.b.c", "a.b", "a"]
    assert [one(spark, v, C.access_modifier("v")) for v in ("__x", "_x", "__x__", "x")] == ["private", "protected", "public", "public"]
    assert [one(spark, v, C.module_from_path("v")) for v in ("./a//b\\c.py", "a/b/__init__.py", "__init__.pyi", "a/b.mjs")] == ["a.b.c", "a.b", "", "a.b"]


def test_text(spark):
    assert one(spark, " A \n b\t", C.normalize_for_match("v")) == "a b"
    assert [one(spark, v, C.token_count("v")) for v in (None, "", " x  y\nz ")] == [0, 0, 3]
    assert one(spark, "aaaa", C.occurrences("v", F.lit("aa"))) == 2 and one(spark, "aaaa", C.occurrences("v", F.lit(""))) == 0


def test_types(spark):
    # pairs worked out from the rules by hand
    got = {v: one(spark, v, T.normalize("v")) for v in ("Optional[int]", "Union[str, None]", "List[String]", "int | str", "bool, optional", "[Tensor](https://x/y)", "dict[str, list[int]]", "Union[int, Optional[str]]", "N/A", "array-like")}
    assert got == {"Optional[int]": "int or none", "Union[str, None]": "str or none", "List[String]": "list of str", "int | str": "int or str", "bool, optional": "bool or none", "[Tensor](https://x/y)": "tensor", "dict[str, list[int]]": "dict of str, list of int", "Union[int, Optional[str]]": "int or str or none", "N/A": "", "array-like": "array_like"}
    df = spark.createDataFrame([("list of int", "list[int]"), ("int", "str"), (None, "N/A"), ("int", None), ("int or str", "Union[str, int]")], "a string, b string")
    assert [r.x for r in df.select(T.equivalent(T.normalize("a"), T.normalize("b")).alias("x")).collect()] == [True, False, True, False, True]
    assert one(spark, "list[int]", T.is_builtin(T.normalize("v"))) and not one(spark, "Tensor", T.is_builtin(T.normalize("v"))) and not one(spark, None, T.is_builtin(T.normalize("v")))


def test_addresses(spark):
    urls = ["https://h/1.0/api/a.b.html", "https://h/1.0/x-y/z.html", "https://h/1.0/p.html#a-b.C%5F1", "https://h/1.0/index.html", "https://h/1.0/9a/2.html", None]
    assert [one(spark, u, U.api_name("v", "/1.0")) for u in urls] == ["a.b", "x.y.z", "a.b.C_1", None, None, None]
    fits = [("https://h/m.C.html", "m.C"), ("https://h/m.C.html", "m.C.f"), ("https://h/m.C.html", "m.C.a.b.c"), ("https://h/m_x.html", "m.x.f"), ("https://h/C.html", "pkg.c.f"), ("https://h/C.html", "c")]
    df = spark.createDataFrame(fits, "u string, r string")
    assert [r.x for r in df.select(U.anchor_fits("u", "r").alias("x")).collect()] == [True, True, False, True, True, False]
    assert [one(spark, v, U.retry_after("v")) for v in ("3", " 2.5 ", "soon", "Wed, 21 Oct 2015 07:28:00 GMT")] == [3.0, 2.5, None, 0.0]
    assert [one(spark, v, U.is_relevant("v", F.lit("https://h/d"), F.lit("api"))) for v in ("https://h/d", "https://h/d/api/x.html#a", "https://h/d/api/x/y.html", "https://h/d/api/search.html", "https://g/d/api/x.html")] == [True, True, False, False, False]


def test_placeholders_and_cleaning(spark):
    text = "a (https://x/1) b (#page=3) " + " ".join(f"(https://y/{i})" for i in range(12))
    row = spark.createDataFrame([(text,), ("none",), (None,)], "v string").select(X.with_placeholders("v").alias("p"), "v").select("p.*", X.restored(F.col("p.text"), F.col("p.urls")).alias("back"), "v").collect()
    assert row[0].text.startswith("a (url_placeholder_0) b (url_placeholder_1) (url_placeholder_2)") and len(row[0].urls) == 14
    assert [r.back for r in row] == [text, "none", ""]
    assert one(spark, "exam-\n  ple non-\nzero “x” … ", X.joined_words(X.plain_typography("v"))) == 'example non-zero "x" ... '
    assert one(spark, "a\n\n\n\n\nb", X.squeezed_blank_lines("v")) == "a\n\n\nb"
    assert [one(spark, v, X.failure_cause("v")) for v in ("_a.b", "a._b", "a.tests.c", "a.demo", "a.MAX_X", "a.TYPE_x", "a.b", None)] == ["private_api", "internal_module", "test_code", "example_code", "type_alias_or_constant", "type_alias_or_constant", "unknown", "unknown"]


def test_means(spark):
    row = spark.range(1).select(C.weighted_mean([(F.lit(1.0), 0.2), (F.lit(None).cast("double"), 0.5), (F.lit(0.0), 0.2)]).alias("a"), C.weighted_mean([(F.lit(None).cast("double"), 1.0)], 1.0).alias("b"), C.ratio(F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(row) == (0.5, 1.0, 0.0)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.x for r in df.select(C.cosine("a", "b").alias("x")).collect()] == [1.0, 0.0, None]


def test_raw_documentation_is_whole(spark, monkeypatch):
    from spanwright.plans import catalogue

    rows = spark.createDataFrame([(1, "raw", "x" * 5000)], "id long, doc_format string, docstring string")
    monkeypatch.setattr(catalogue, "cur", lambda s, d, *names: rows)
    assert catalogue.documentation_by_format(spark, "").first().raw_text == "x" * 5000


def test_english_in_every_spelling(spark, monkeypatch):
    from spanwright.plans import prose

    langs = ["en", "EN", "en-XX", "en_GB", "enm", "fr", None]
    docs = spark.createDataFrame([(i, x, "Call lib.load_tile.") for i, x in enumerate(langs)], "doc_id long, lang string, text string")
    monkeypatch.setattr(prose, "table", lambda s, d, name: docs)
    assert sorted(r.doc_id for r in prose.xref_candidates(spark, "").collect()) == [0, 1, 2, 3]
