"""Leaf blocks of HTML pages."""

from spanwright.llm import boilerplate


def test_leaf_blocks_of_html():
    html = "<html><body><nav class='top bar'><a>Home</a></nav>\n<main><h1>lib.Thing</h1>\n<p>It <b>does</b>\n things.</p><ul><li>one</li><li>two</li></ul><script>x()</script></main><footer>(c) us</footer></body></html>"
    got = boilerplate.dom_blocks(html)
    assert [(line, text) for line, text, _ in got] == [(0, "Home"), (1, "lib.Thing"), (2, "It does things."), (3, "one"), (3, "two"), (3, "(c) us")]
    assert "nav.top" in got[0][2] and got[1][2][-1] == "h1" and got[3][2][-1] == "li" and "main" in got[3][2]
    page = boilerplate.Page(html, None, "lib.Thing", "lib")
    assert page.title == [False, True, False, False, False, False] and len(boilerplate.features(page)) == 6
    assert boilerplate.dom_blocks("") == [] and boilerplate.dom_blocks("<p>open") == [(0, "open", ("p",))]


def test_html_pages_learn_from_their_tags(spark):
    rows = [(i, f"<body><nav><a>Home</a><a>Word{i}</a></nav><main><h1>Name{i}</h1><p>Sentence {i} about it.</p><p>More of {i} here.</p></main><footer><p>Sentence of all pages.</p></footer></body>", f"https://h/lib.Name{i}.html", f"lib.Name{i}", "lib") for i in range(60)]
    df = spark.createDataFrame(rows, "scrape_id long, scraped_doc string, url string, member_fqn string, library string")
    assert boilerplate.main_lines(df).select("scrape_id").distinct().count() == 60
