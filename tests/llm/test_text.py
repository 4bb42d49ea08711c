import numpy as np
import pytest

from spanwright.llm import sentences as S
from spanwright.llm.boilerplate import MAIN, Furniture, Page, features, label_page, main_lines
from spanwright.llm.crf import LinearChain

DOCS = "doc_id long, text string, library string, start_char long, extra string"


def units(text, stops=None, names=(), library="velgrid"):
    return [text[s:e] for s, e in S.sentences(text, library, S.Knowledge(stops or {}, set(names)))]


ABBR = {"etc.": (True, True), "Mr.": (True, False), "Fig.": (True, False), "a.m.": (True, True), "z.": (True, False), "B.": (True, False), "т.": (True, False), "д.": (True, True), "usw.": (True, True)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("One is here. Two is there.", ["One is here.", "Two is there."]),
        ("Use a, b, etc. with care. Call Mr. Fen at 9 a.m. The end.", ["Use a, b, etc. with care.", "Call Mr. Fen at 9 a.m.", "The end."]),
        ("It is v3.8. Set x to .5 now.\nIt wraps\nhere.", ["It is v3.8.", "Set x to .5 now.", "It wraps\nhere."]),
        ('"Keep it open!" says he. (Old ones stay.) They read "done." Then go.', ['"Keep it open!" says he.', "(Old ones stay.)", 'They read "done."', "Then go."]),
        ("Type q! to leave. Is it? velgrid.x raises. Wait ... it is on.", ["Type q! to leave.", "Is it?", "velgrid.x raises.", "Wait ... it is on."]),
        ("## Title here\nBody one. Body two.", ["## Title here", "Body one.", "Body two."]),
        ("1. First thing. More of it.\n2. Second thing\n* third", ["1. First thing.", "More of it.", "2. Second thing", "* third"]),
        ("日志显示“就绪”……随后停止。“为什么？”他问道。（旧的保留。）完了！", ["日志显示“就绪”……随后停止。", "“为什么？”他问道。", "（旧的保留。）", "完了！"]),
        ("「準備完了。」値は約1.5倍になる．手引きには「先に閉じる。」と書かれている。", ["「準備完了。」", "値は約1.5倍になる．", "手引きには「先に閉じる。」と書かれている。"]),
        ("क्या यह चलेगा? dtype को खाली न छोड़ें! परिणाम लिखा है। अंत", ["क्या यह चलेगा?", "dtype को खाली न छोड़ें!", "परिणाम लिखा है।", "अंत"]),
        ("هل يعمل؟ نعم، يعمل. انتهى", ["هل يعمل؟", "نعم، يعمل.", "انتهى"]),
        ("คลาส RaggedWindow ใช้สำหรับจัดเรียง ขั้นตอนนี้ใช้เวลา 3 นาที", ["คลาส RaggedWindow ใช้สำหรับจัดเรียง", "ขั้นตอนนี้ใช้เวลา 3 นาที"]),
        ("Im 19. Durchlauf wurde es leer. Er fragte: „Wozu?“, bekam nichts. Das gilt z. B. hier.", ["Im 19. Durchlauf wurde es leer.", "Er fragte: „Wozu?“, bekam nichts.", "Das gilt z. B. hier."]),
        ("« Pourquoi ? » demande-t-il. Il dit « prêt. » Puis rien !", ["« Pourquoi ? » demande-t-il.", "Il dit « prêt. »", "Puis rien !"]),
        ("¿Y si falta? ¡No cierres! Fin.", ["¿Y si falta?", "¡No cierres!", "Fin."]),
        ("Там плитки и т. д. Очередь ждёт... и пуста.", ["Там плитки и т. д.", "Очередь ждёт... и пуста."]),
        ("   \n\n ", []), ("", []), ("...", ["..."]), ("x", ["x"]),
    ],
)
def test_sentences(text, want):
    assert units(text, ABBR, ["Fen"]) == want


def test_every_visible_character_is_in_one_sentence(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spans = {}
    for r in S.split_sentences(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for r in docs.select("doc_id", "text").collect():
        at = 0
        for s, e in sorted(spans.get(r.doc_id, [])):
            assert s >= at and not r.text[at:s].strip() and r.text[s:e] == r.text[s:e].strip() != ""
            at = e
        assert not (r.text or "")[at:].strip()


def test_sentences_table_and_join_route(spark, monkeypatch):
    text = "See Fig. 3 now. See Fig. 4 now. Use it, etc. and go. Use it, etc. and go. We use etc.\n\nAll is well."
    data = [(1, text, "l", 1, "x"), (1, text, "l", 1, "x"), (2, None, None, None, None), (3, "", "l", 0, ""), (None, "a", "l", 0, "")] + [(k, text, "l", 0, "") for k in range(4, 9)]
    df = spark.createDataFrame(data, DOCS)
    first = sorted(map(tuple, S.split_sentences(df).collect()))
    assert [text[s:e] for d, s, e in first if d == 1] == ["See Fig. 3 now.", "See Fig. 4 now.", "Use it, etc. and go.", "Use it, etc. and go.", "We use etc.", "All is well."]
    monkeypatch.setattr(S, "DICTIONARY_LIMIT", -1)
    assert sorted(map(tuple, S.split_sentences(df).collect())) == first
    assert S.split_sentences(df.where("false")).count() == 0


def test_crf_learns_a_chain():
    rng = np.random.default_rng(0)
    pages, labels = [], []
    for _ in range(150):
        state, page, gold = 0, [], []
        for _ in range(20):
            state = state if rng.random() < 0.95 else 1 - state
            page.append([1, 10 + (state if rng.random() < 0.75 else 1 - state)])
            gold.append(state)
        pages.append(page)
        labels.append(gold)
    model = LinearChain(2, 64).fit(pages[:100], labels[:100], epochs=5)
    right = sum(a == b for p, g in zip(pages[100:], labels[100:]) for a, b in zip(model.decode(p), g)) / 1000
    alone = sum((p[1] == 11) == g for page, gold in zip(pages[100:], labels[100:]) for p, g in zip(page, gold)) / 1000
    assert right > alone + 0.05
    assert model.decode([]) == []


def test_boilerplate_held_out(spark, small):
    pages = spark.read.parquet(f"{small}/scraped_docs.parquet")
    got = {}
    for r in main_lines(pages).collect():
        got.setdefault(r.scrape_id, set()).add(r.line_no)
    rows = {r[0]: tuple(r)[1:] for r in pages.select("scrape_id", "scraped_doc", "url", "member_fqn", "library").where("trim(scraped_doc) <> ''").collect()}
    parsed = {k: Page(*v) for k, v in rows.items()}
    furniture = Furniture(list(parsed.values()))
    hit = said = want = 0
    for k, page in parsed.items():
        truth = {page.at[i] for i, x in enumerate(label_page(page, furniture)) if x == MAIN}
        mine = got.get(k, set())
        assert all(rows[k][0].split("\n")[i].strip() for i in mine)
        hit, said, want = hit + len(truth & mine), said + len(mine), want + len(truth)
    assert hit / said > 0.95 and hit / want > 0.95


def test_boilerplate_nulls_and_repeats(spark):
    schema = "scrape_id long, scraped_doc string, url string, member_fqn string, library string, line_no int"
    data = [(1, "Home\n\nlib.A\n\nIt walks.\n\nImprint", "https://x/lib.m.A_1.html", None, "lib", 0)] * 2 + [(2, None, None, None, None, None), (3, " \n ", None, None, None, None), (4, "Home\nImprint", None, None, None, None)]
    out = main_lines(spark.createDataFrame(data, schema)).collect()
    assert len(out) == len({tuple(r) for r in out}) and {r.scrape_id for r in out} <= {1, 4}
    assert main_lines(spark.createDataFrame([], schema)).count() == 0
    page = Page("a\r\nlib.A", "u/lib.m.A_9z.html", None, "lib")
    assert page.title == [False, True] and len(features(page)) == 2


@pytest.mark.parametrize("text,known", [
    ("The first one ends. numpyx is another library.", [("^numpyx", "name")]),
    ("He met Prof. Abc in town. Abc saw Abc again, with Abc there, and left it.", [("Prof.", "end"), ("Abc.", "mid"), ("Abc", "name")]),
    ("It lies (in “cf. Abc) and ('vgl. Abc) so.", [("cf.", "mid"), ("vgl.", "end"), ("Abc", "name")]),
    ("これは例です。cf. Abc is there.", [("cf.", "mid")]),
])
def test_a_documents_keys_stand_for_the_dictionary(text, known):
    keys = S.keys_of(text)
    assert {t for t, _ in known} <= keys
    assert S.sentences(text, None, S._knowledge(known)) == S.sentences(text, None, S._knowledge([x for x in known if x[0] in keys]))


def test_lower_case_names_start_sentences_on_both_paths(spark, monkeypatch):
    rows = [(i, f"numpyx {w} it. The array {w}. numpyx is fast.") for i, w in enumerate(["reads", "keeps", "sorts", "finds"])]
    docs = spark.createDataFrame([(i, t, "lib") for i, t in rows], "doc_id long, text string, library string")
    first = sorted(map(tuple, S.split_sentences(docs).collect()))
    monkeypatch.setattr(S, "DICTIONARY_LIMIT", -1)
    assert sorted(map(tuple, S.split_sentences(docs).collect())) == first and len(first) == 12


def test_names_are_decided_by_share(spark):
    texts = ["We use Lazysensor here."] * 40 + ["Lazysensor is new.", "We meet Often here.", "Often it rains.", "They went often."]
    docs = spark.createDataFrame([(i, x, "lib") for i, x in enumerate(texts)], "doc_id long, text string, library string")
    names = {r.token for r in S.corpus_decisions(docs).collect() if r.verdict == "name"}
    assert "Lazysensor" in names and "Often" not in names
