import random
from collections import defaultdict

from spanwright.llm.mixing import mix_report, mixed_documents
from spanwright.llm.packing import best_fit, packed, packing_report
from spanwright.llm.tokens import sized_documents

SIZED = "doc_id long, source string, n_tokens long, copy_of long"
RUNS = "run_id int, capacity int, source string"
MIX = "mix_id int, source string, target_weight double, max_repeats int, total_factor double"


def test_best_fit_takes_the_tightest_compatible_bin():
    assert best_fit([6, 5, 4, 3], ["a"] * 4, [1, 2, 3, 4], 10) == [0, 1, 0, 1]
    assert best_fit([6, 4, 4], ["a"] * 3, [1, 1, 2], 10) == [0, 1, 0]  # a copy may not join its twin
    assert best_fit([6, 4], ["a", "b"], [1, 2], 10, frozenset({frozenset({"a", "b"})})) == [0, 1]
    assert best_fit([6, 4], ["a", None], [None, None], 10) == [0, 0]
    assert best_fit([], [], [], 10) == []


def brute_best_fit(sizes, copies, capacity):
    bins = []
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [(b[0] - sizes[k], i) for i, b in enumerate(bins) if b[0] >= max(sizes[k], 1) and copies[k] not in b[1]]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set()])
        bins[i][0] -= sizes[k]
        bins[i][1].add(copies[k])
        out[k] = i
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 80)
        sizes, copies = [rng.randrange(0, 30) for _ in range(n)], [rng.randrange(20) for _ in range(n)]
        assert best_fit(sizes, ["s"] * n, copies, 30) == brute_best_fit(sizes, copies, 30)


def test_packing_is_whole_and_within_capacity(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice(["a", "b", None]), rng.choice([0, 5, 40, 99, 100, 101, 730]), k // 2) for k in range(600)]
    sized = spark.createDataFrame(docs, SIZED)
    runs = spark.createDataFrame([(1, 100, None), (2, 64, "A "), (3, None, None), (4, 10, "none")], RUNS)
    fill, pieces, inside = defaultdict(int), defaultdict(list), defaultdict(list)
    size = {d[0]: d[2] for d in docs}
    copy = {d[0]: d[3] for d in docs}
    cap = {1: 100, 2: 64}
    for r in packed(sized, runs).collect():
        fill[r.run_id, r.bin_id] += r.n_tokens
        pieces[r.run_id, r.doc_id].append((r.start_token, r.n_tokens))
        inside[r.run_id, r.bin_id].append(r.doc_id)
    assert {k[0] for k in fill} == {1, 2}
    assert all(v <= cap[k[0]] for k, v in fill.items())
    assert {d for r, d in pieces if r == 1} == set(size) and {d for r, d in pieces if r == 2} == {d[0] for d in docs if d[1] == "a"}
    for (run, doc), parts in pieces.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == size[doc] and (len(parts) == 1 or size[doc] > cap[run])
    for docs_in in inside.values():
        assert len({copy[d] for d in docs_in}) == len(docs_in)
    report = {r.run_id: r for r in packing_report(sized, runs).collect()}
    assert report[1].n_docs == 600 and report[1].fill > 0.9
    assert packed(sized.where("false"), runs).count() == 0


def test_mix_meets_its_budgets(spark):
    rng = random.Random(3)
    docs = [(k, "big" if k < 800 else "small" if k < 830 else None, rng.randrange(0, 60), k) for k in range(900)]
    sized = spark.createDataFrame(docs, SIZED)
    targets = spark.createDataFrame([(1, "Big", 3.0, 2, 0.5), (1, "small", 1.0, 3, 0.5), (1, "none", 1.0, 3, 0.5), (2, "small", 1.0, 50, 0.3), (2, "big", None, 1, 0.3)], MIX)
    total = sum(d[2] for d in docs)
    per = defaultdict(int)
    for r in mixed_documents(sized, targets).collect():
        assert 1 <= r.n_uses <= {(1, "big"): 2, (1, "small"): 3, (2, "small"): 50}[r.mix_id, r.source]
        per[r.mix_id, r.source] += r.n_uses * r.n_tokens
    small = sum(d[2] for d in docs if d[1] == "small")
    assert abs(per[1, "big"] - 0.6 * 0.5 * total) <= 31
    assert abs(per[1, "small"] - min(3 * small, 0.2 * 0.5 * total)) <= 31
    assert abs(per[2, "small"] - 0.3 * total) <= 31
    report = {(r.mix_id, r.source): r for r in mix_report(sized, targets).collect()}
    assert report[1, "none"].tokens == 0 and report[2, "big"].tokens == 0 and report[1, "big"].tokens == per[1, "big"]
    assert mixed_documents(sized.where("false"), targets).count() == 0


def test_sizes(spark):
    rows = [(1, "A few words of text for a start", "User-Guide "), (1, "A few words of text for a start", "User-Guide "), (2, "a few  words of TEXT for a start", None), (3, None, "faq"), (4, "", "faq"), (None, "x", "faq"), (5, "word " * 30_000, "faq")]
    got = {r.doc_id: r for r in sized_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].source == "user_guide" and got[1].copy_of == got[2].copy_of and got[3].n_tokens == got[4].n_tokens == 0 and got[4].copy_of is None
    assert got[5].n_tokens >= 30_000


def test_sources_kept_apart_never_share(spark, small):
    from spanwright.llm.queries import p7_apart

    rows = p7_apart(spark, small).collect()
    assert rows and all(r.n_mixed == 0 and r.n_bins > 0 for r in rows)
