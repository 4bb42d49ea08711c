"""Finding members in documentation texts: needles, definition lines, anchors, stops and the spans between them.

Texts become lines, members become needles, and the two meet on a word (the
last part of a name) instead of each line with each needle.  Scores are column
expressions; what is left over is ranked by similarity in Arrow batches.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.functions.columns import coalesce_text, col

# fixed values: what a definition line may begin with, bullets, scores
KEYWORDS = "property|class|classmethod|staticmethod|method|function|attribute"
BULLET = r"^[-*•►▪]\s+\w"
VARIANTS = ["full", "no_types", "defaults_only", "no_special", "no_slash", "no_asterisk", "no_types_no_slash", "no_types_no_asterisk"]
DENSITY_MOST, TITLE_BONUS, REFERENCE_PENALTY = 10.0, 15.0, 20.0
MOST_CHARS = 25_000  # of one extracted text: the operator's bound


def squeezed(c: str | Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def without_noise(c: Column) -> Column:
    for p in (r"\(#page=[0-9]+\)", r"\s*\(Keyword-only parameters separator\s*\(PEP 3102\)\)", r"\(https?://[^)]*\)", "¶"):
        c = F.regexp_replace(c, p, "")
    return c


def looks_like_code(line: Column) -> Column:
    """A prompt, a bulleted item, or an assignment before any bracket."""
    eq, br = F.instr(line, "="), F.instr(line, "(")
    return line.startswith(">>>") | line.startswith("...") | line.rlike(BULLET) | ((eq > 0) & ((br == 0) | (eq < br)))


def context_score(line: str | Column) -> Column:
    """How much a line looks like a definition by what surrounds a name: -30 and nothing else for a bulleted item; keywords, a
    closing link and a return type up, a closing page reference down."""
    t = F.trim(col(line))
    keyword = F.when(t.rlike(r"(?i)^(class|property)\s+\w"), 20).when(t.rlike(r"(?i)^(method|function|attribute)\s+\w"), 15).when(t.rlike(r"(?i)^(classmethod|staticmethod)\s+\w"), 10).otherwise(0)
    link = F.when(t.rlike(r"\(https?://[^\s)]+\)\s*$"), 15).otherwise(0)
    arrow = F.when(t.rlike(r"\)\s*->\s*\w"), 10).otherwise(0)
    page = F.when(t.rlike(r"\(#page=\d+\)\s*$"), -25).otherwise(0)
    return F.when(t.rlike(BULLET), -30).otherwise(keyword + link + arrow + page)


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, stripped, norm, start_char, fenced): the lines of each text; fence lines themselves are left out of none."""
    l = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("stripped", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    fence = F.col("stripped").startswith("```").cast("int")
    start = F.sum(F.length("line") + 1).over(w) - F.length("line") - 1
    return l.withColumn("start_char", start).withColumn("fenced", F.sum(fence).over(w) % 2 == 1).withColumn("is_fence", fence == 1).withColumn("norm", squeezed(without_noise(F.col("stripped"))))


# needles


def _spelt(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def no_user_parameters(member_type: Column, variants: Column) -> Column:
    """A variable, or a member one of whose signatures asks for nothing but self."""
    inner = lambda s: F.regexp_replace(F.regexp_extract(s, r"^[^(]*\((.*)\)", 1), r"\bself\b,?\s*", "")
    bare = F.exists(F.map_values(variants), lambda s: ~s.contains("(") | (F.regexp_replace(F.trim(inner(s)), r"^[,\s]+|[,\s]+$", "") == ""))
    return (member_type == "variable") | variants.isNull() | (F.size(variants) <= 0) | bare


def needles(members: DataFrame) -> DataFrame:
    """(id, member_type, tier, needle, place): what to look for of (id, api_name, member_type, variants): ``exact`` spellings of
    the signature in the forms documentation uses, and ``anchor`` names; the most telling first."""
    api, kind, v = F.col("api_name"), F.col("member_type"), F.coalesce(F.col("variants"), F.create_map().cast("map<string,string>"))
    p = F.split(api, "[.]")
    short = F.element_at(p, -1)
    owner = F.when(F.size(p) > 1, F.element_at(p, -2))
    rest = F.array_except(F.array_sort(F.map_keys(v)), F.array(*[F.lit(x) for x in VARIANTS]))
    order = F.concat(F.array(*[F.lit(x) for x in VARIANTS]), rest)
    texts = F.filter(F.transform(order, lambda k: F.trim(F.try_element_at(v, k))), lambda s: s.isNotNull() & s.contains("("))
    tail = lambda s: F.substring(s, F.instr(s, "("), F.length(s))
    of_class = F.flatten(F.transform(texts, lambda s: F.array(F.concat(F.lit("class "), api, tail(s)), F.concat(api, tail(s)), F.concat(F.lit("class "), short, tail(s)), F.concat(short, tail(s)))))
    of_method = F.flatten(F.transform(texts, lambda s: F.array(s, F.concat_ws(".", owner, F.concat(short, tail(s))), F.concat(api, tail(s)))))
    of_function = F.flatten(F.transform(texts, lambda s: F.array(s, F.concat(api, tail(s)))))
    plain = F.exists(texts, lambda s: F.regexp_extract(s, r"^[^(]*\((.*)\)", 1).rlike(r"\S"))
    heads = F.when((kind == "class") & ~plain, F.array(F.concat(F.lit("class "), api), F.concat(F.lit("class "), short))).otherwise(F.array().cast("array<string>"))
    exact = F.when(kind == "variable", F.array().cast("array<string>")).when(kind == "class", F.concat(heads, of_class)).when(kind == "method", of_method).otherwise(of_function)
    anchors = F.filter(F.concat(F.when(no_user_parameters(kind, v), F.array(short)).otherwise(F.array().cast("array<string>")), F.array(api), F.array(F.when((kind == "method") & owner.isNotNull(), F.concat_ws(".", owner, short)))), lambda x: x.isNotNull())
    clean = lambda xs: F.array_distinct(F.transform(xs, _spelt))
    both = members.select("id", "member_type", short.alias("short"), clean(exact).alias("e"), clean(anchors).alias("a"))
    one = lambda tier, c: both.select("id", "member_type", "short", F.lit(tier).alias("tier"), F.posexplode(c).alias("place", "needle"))
    return one("exact", "e").unionByName(one("anchor", "a")).where("needle <> ''").withColumn("needle_norm", squeezed("needle"))


def _prefix_ok(prefix: Column) -> Column:
    return (prefix == "") | prefix.rlike(rf"^(?:{KEYWORDS})(?:\s+[\w.]+\.)?\s*$")


def line_matches(lines: DataFrame, found: DataFrame, scope: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, id, line_no, pos, score, tier, is_code, early): every line that holds a needle, with its score as a definition of the member.

    Lines meet needles on the last part of the name as a word (within ``scope``
    where both have such a column), so the work follows the matches there are.
    """
    words = lines.where("not is_fence and length(norm) >= 3").withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all("norm", F.lit(r"(\w+)"), 1))))
    on = ["word", scope] if scope else ["word"]
    n = found.withColumn("word", F.lower("short"))
    j = words.join(n, on).withColumn("at", F.instr(F.col("norm"), F.col("needle_norm")))
    exact = F.col("tier") == "exact"
    anchor_at = F.regexp_instr(F.col("norm"), F.concat(F.lit(r"\b\Q"), F.col("needle_norm"), F.lit(r"\E\b")))
    short_name = (F.length("needle_norm") <= 2) & ~F.col("needle_norm").contains(".")
    j = j.withColumn("pos", F.when(exact, F.col("at")).otherwise(F.when(short_name, 0).otherwise(anchor_at)) - 1).where("pos >= 0")
    ctx, start = context_score("stripped"), F.when(F.col("pos") < 20, 10).otherwise(0)
    prefix = F.trim(F.substring(F.col("norm"), F.lit(1), F.col("pos")))
    suffix = F.trim(F.substring(F.col("norm"), F.col("pos") + F.length("needle_norm") + 1, F.length("norm")))
    alone = F.when((F.col("pos") == 0) & ((suffix == "") | suffix.startswith(":")), 15).otherwise(0)
    at_class = (F.col("member_type") != "class") | suffix.startswith("(") | (prefix == "class")
    placed = (F.col("pos") <= 80) & _prefix_ok(prefix) & ((suffix == "") | suffix.startswith(":") | suffix.startswith("(")) & at_class
    code = F.col("fenced") | looks_like_code(without_noise(F.col("stripped"))) | F.when(exact, ~_prefix_ok(prefix)).otherwise(~placed)
    score = F.when(exact, 100 + start + ctx).otherwise(50 + start + ctx + alone)
    keep = [key] + ([scope] if scope else [])
    return j.select(*keep, "id", "line_no", "start_char", "pos", score.cast("double").alias("score"), "tier", code.alias("is_code"), (exact & ~code & (F.col("pos") < 20) & (ctx >= 0)).alias("early"))


def best_lines(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, line_no, start_char, pos, score, tier): the line that defines each member in each text.

    The first clear definition (an exact spelling near the start, nothing against
    it) counts; else the best definition, else what code or prose mentions, at a
    score of 1 at most; the later of equals.
    """
    place = F.struct("score", "line_no", "pos", "tier", "start_char")
    best = matches.groupBy(key, "id").agg(
        F.min_by(place, F.when(F.col("early"), F.struct("line_no", -F.col("score")))).alias("first"), F.max_by(place, F.when(~F.col("is_code"), place)).alias("definition"), F.max_by(place, F.when(F.col("is_code"), place)).alias("code")
    )
    low = F.col("code").withField("score", F.least(F.col("code.score"), F.lit(1.0)))
    return best.select(key, "id", F.coalesce("first", "definition", low).alias("b")).select(key, "id", "b.line_no", "b.start_char", "b.pos", "b.score", "b.tier")


def reference_only(text: Column, name: Column) -> Column:
    """Is a name only referred to (see X, X on page n) and never defined in a text?"""
    q = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    short = q(F.element_at(F.split(name, "[.]"), -1))
    defined = F.regexp(text, F.concat(F.lit("(?im)^(?:class\\s+)?"), short, F.lit(r"\s*\("))) | F.regexp(text, F.concat(F.lit(r"(?im)^\s*"), short, F.lit(r"\s*\("))) | F.regexp(text, F.concat(F.lit(r"(?im)^class\s+"), q(name), F.lit(r"\b")))
    refers = F.regexp(text, F.concat(F.lit(r"(?i)see\s+"), short, F.lit(r"\b"))) | F.regexp(text, F.concat(F.lit("(?i)"), short, F.lit(r"\s*\(\s*#?page[=\s]\s*\d+\)"))) | F.regexp(text, F.concat(F.lit("(?i)"), short, F.lit(r"\s+on\s+page\s+\d+")))
    return ~defined & refers


def section_scores(docs: DataFrame, best: DataFrame, found: DataFrame, key: str = "doc_id", title: str = "title") -> DataFrame:
    """(key, id, score): the line's score plus half a point per further mention (ten at most) and 15 for a title that has the name, less 20 where it is only referred to."""
    names = found.where("tier = 'anchor'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "needle", "needle_norm"))).alias("anchors"))  # three at most
    j = best.join(names, "id").join(docs.select(key, "text", title), key)
    norm = squeezed("text")
    count = lambda n: F.floor((F.length(norm) - F.length(F.replace(norm, n, F.lit("")))) / F.length(n))
    density = F.aggregate("anchors", F.lit(0.0), lambda a, x: a + F.greatest(count(x["needle_norm"]) - 1, F.lit(0)) * 0.5)
    titled = F.exists("anchors", lambda x: F.lower(coalesce_text(title)).contains(F.lower(x["needle"])))
    refers = F.exists("anchors", lambda x: reference_only(F.col("text"), x["needle"]))
    total = F.col("score") + F.least(density, F.lit(DENSITY_MOST)) + F.when(titled, TITLE_BONUS).otherwise(0.0) - F.when(refers, REFERENCE_PENALTY).otherwise(0.0)
    return j.select(key, "id", "line_no", total.alias("score"))


def partial_ratio(needle: str, line: str) -> float:
    """Best ratio (0..100) of the shorter text with a stretch of the longer one."""
    a, b = (needle, line) if len(needle) <= len(line) else (line, needle)
    if not a:
        return 0.0
    if a in b:
        return 100.0
    best = 0.0
    for m in difflib.SequenceMatcher(None, b, a, autojunk=False).get_matching_blocks():
        start = max(0, m.a - m.b)
        best = max(best, difflib.SequenceMatcher(None, b[start : start + len(a)], a, autojunk=False).ratio())
    return 100 * best


def fuzzy_scores(pairs: DataFrame, top: int = 5) -> DataFrame:
    """(id, fuzzy) of (id, text, needles): the mean of the best line scores over all needles, lines under five characters left out."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text, ns in zip(pdf["text"], pdf["needles"]):
                lines = [x.strip() for x in (text or "").split("\n") if len(x.strip()) >= 5]
                scores = sorted((partial_ratio(n, x) for x in lines for n in (ns if ns is not None else ()) if n), reverse=True)[:top]
                out.append(round(sum(scores) / len(scores), 6) if scores else 0.0)
            yield pd.DataFrame({"id": pdf["id"], "fuzzy": out})

    return pairs.select("id", "text", "needles").mapInPandas(run, "id long, fuzzy double")


def similar_names(wanted: DataFrame, known: DataFrame, top: int = 3, least: float = 60.0) -> DataFrame:
    """(name, match, score, rank): of each name of a stated query set the known names most like it, above ``least`` of 100.

    The queries go to all tasks in blocks of 200.  The letters two names share bound
    their ratio, so within a batch names are compared in the order of that bound,
    and only while it is above what the query has found already.
    """
    names = [r[0] for r in wanted.where("name is not null and name <> ''").select("name").distinct().orderBy("name").toLocalIterator()]
    out = None
    for at in range(0, max(1, len(names)), 200):
        block = names[at : at + 200]

        def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            def letters(words: list[str]) -> np.ndarray:
                m = np.zeros((len(words), 96), np.int16)
                for i, w in enumerate(words):
                    np.add.at(m[i], np.frombuffer(w.encode("utf-8", "replace"), np.uint8) % 96, 1)
                return m

            mine = letters(block)
            best: dict[str, list[tuple[float, str]]] = {q: [] for q in block}
            for pdf in frames:
                words = pdf["match"].tolist()
                theirs = letters(words)
                sizes = np.array([len(w) for w in words])
                for q, row in zip(block, mine):
                    bound = 200.0 * np.minimum(theirs, row).sum(1) / (len(q.encode()) + np.maximum(sizes, theirs.sum(1)))
                    bound = np.maximum(bound, 200.0 * np.minimum(theirs, row).sum(1) / (len(q) + sizes))
                    floor = best[q][-1][0] if len(best[q]) == top else least
                    for i in np.argsort(-bound, kind="stable"):
                        if bound[i] < floor or bound[i] <= least:
                            break
                        score = round(100 * difflib.SequenceMatcher(None, q, words[i], autojunk=False).ratio(), 6)
                        if score > least:
                            best[q] = sorted([*best[q], (score, words[i])], key=lambda x: (-x[0], x[1]))[:top]
                            floor = best[q][-1][0] if len(best[q]) == top else least
            rows = [(q, w, s) for q, found in best.items() for s, w in found]
            yield pd.DataFrame(rows, columns=["name", "match", "score"])

        part = known.where("name is not null and name <> ''").select(F.col("name").alias("match")).distinct().mapInPandas(run, "name string, match string, score double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "match"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


# stops and spans


def definition_name(line: Column) -> Column:
    """The name a line would define (its last part, lower case), null if it looks like no definition."""
    clean = F.trim(without_noise(line))
    name = F.regexp_extract(clean, rf"(?i)^(?:(?:{KEYWORDS})\s+)?((?:\w+\s*\.\s*)*\w+)\s*[(:]", 1)
    return F.nullif(F.lower(F.element_at(F.split(F.regexp_replace(name, r"\s+", ""), "[.]"), -1)), F.lit(""))


def peer_kind(target_type: Column, target_owner: Column, peer: Column) -> Column:
    """Is a peer a stop for a target: ``primary``, ``fallback`` (where no primary one occurs), or ``never``?

    Classes stop at classes and qualified functions, methods at methods of their own class; methods of other classes never stop one.
    """
    p = F.split(F.split(peer, r"\(")[0], "[.]")
    short, owner = F.element_at(p, -1), F.when(F.size(p) > 1, F.element_at(p, -2))
    is_class, is_method = short.rlike("^[A-Z]"), short.rlike("^[a-z_]")
    for_class = F.when(is_class | ((F.size(p) > 1) & is_method), "primary").otherwise("fallback")
    for_method = F.when(is_class, "fallback").when(is_method & (target_owner.isNull() | owner.isNull() | (owner == target_owner)), "primary").when(is_method & owner.rlike("^[A-Z]"), "never").otherwise("fallback")
    return F.when(target_type == "class", for_class).when(target_type == "method", for_method).otherwise("primary")


def spans(anchors: DataFrame, lines: DataFrame, peers: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, id, start_line, end_line, stopped): from each member's line to before the next member's or the first peer's definition, to the end else.

    anchors: (key, id, line_no); peers: (id, short, kind).  A primary peer's line
    stops it; where none occurs the first fallback one does; lines of code do not stop.
    """
    nxt = F.lead("line_no").over(W.partitionBy(key).orderBy("line_no", "id"))
    a = anchors.select(key, "id", "line_no").withColumn("next_line", nxt)
    ends = lines.groupBy(key).agg(F.max("line_no").alias("last_line"))
    out = a.join(ends, key)
    if peers is None:
        return out.select(key, "id", F.col("line_no").alias("start_line"), F.greatest("line_no", F.coalesce(F.col("next_line") - 1, F.col("last_line"))).alias("end_line"), F.col("next_line").isNotNull().alias("stopped"))
    defs = lines.where("not fenced and not is_fence").select(key, F.col("line_no").alias("at"), definition_name(F.col("stripped")).alias("short"), looks_like_code(F.col("stripped")).alias("code")).where("short is not null and not code")
    hit = out.select(key, "id", "line_no").join(peers, "id").join(defs, [key, "short"]).where("at > line_no")
    stops = hit.groupBy(key, "id").agg(F.min(F.when(F.col("kind") == "primary", F.col("at"))).alias("p"), F.min(F.when(F.col("kind") == "fallback", F.col("at"))).alias("f"))
    stop = F.coalesce("p", "f")
    j = out.join(stops, [key, "id"], "left").withColumn("stop", F.least("next_line", stop))
    return j.select(key, "id", F.col("line_no").alias("start_line"), F.greatest("line_no", F.coalesce(F.col("stop") - 1, F.col("last_line"))).alias("end_line"), F.col("stop").isNotNull().alias("stopped"))


def span_texts(docs: DataFrame, found: DataFrame, key: str = "doc_id", most: int = MOST_CHARS) -> DataFrame:
    """The spans with their text, of at most ``most`` characters."""
    j = found.join(docs.select(key, F.split("text", "\n").alias("rows")), key)
    text = F.array_join(F.slice("rows", F.col("start_line") + 1, F.col("end_line") - F.col("start_line") + 1), "\n")
    return j.select(*found.columns, F.substring(text, 1, most).alias("text"))


def scoped(anchors: DataFrame, scopes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Anchors of methods that lie within their class's scope: anchors (key, id, class_id, line_no), scopes (key, class_id, start_line, end_line)."""
    return anchors.join(scopes, [key, "class_id"]).where("line_no between start_line and end_line").select(*anchors.columns)


# windows and similarity


def line_windows(text: str, size: int = 3000, stride: int = 2000) -> list[tuple[int, int]]:
    """Overlapping windows that begin and end with lines: about ``size`` characters each, a new one begins with the first line after ``stride``."""
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    out, at, n = [], 0, len(starts) - 1
    while at < n:
        end = at + 1
        while end < n and starts[end] - starts[at] < size:
            end += 1
        out.append((starts[at], starts[end]))
        if end >= n:
            break
        nxt = at + 1
        while nxt < n and starts[nxt] < starts[at] + stride:
            nxt += 1
        at = nxt
    return out


def windows(docs: DataFrame, key: str = "doc_id", size: int = 3000, stride: int = 2000) -> DataFrame:
    """(key, window_no, start_char, end_char) over lines of each text; empty texts have none."""
    @F.udf("array<struct<a:long,b:long>>", useArrow=True)
    def cut(text: str):
        return [{"a": a, "b": b} for a, b in line_windows(text, size, stride)]

    each = docs.where("text <> ''").select(key, F.posexplode(cut("text")).alias("window_no", "w"))
    return each.select(key, F.col("window_no").cast("long").alias("window_no"), F.col("w.a").alias("start_char"), F.col("w.b").alias("end_char"))


def hashed_vector(text: str, size: int = 256) -> np.ndarray:
    """A vector of length 1 for a text: its words and their letter triples, hashed; stands in for a trained model."""
    v = np.zeros(size)
    for word in re.findall(r"\w+", text.lower()):
        for g in {word, *(word[i : i + 3] for i in range(max(1, len(word) - 2)))}:
            h = crc32(g.encode())
            v[h % size] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def similar_lines(pairs: DataFrame, encode=hashed_vector) -> DataFrame:
    """(doc_id, id, line_no, score): of each (doc_id, id, text, query, signature, name, api_name) the line most like the member.

    Windows of the text are ranked by likeness to the query (long ones a little
    down, those that have the name up); in the best three the line that is most
    like the signature wins, with its part of the query's likeness and 0.30 for the name.
    """
    # fixed values: penalties and bonuses of the two stages
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, member, text, query, sig, name in zip(pdf["doc_id"], pdf["id"], pdf["text"], pdf["query"], pdf["signature"], pdf["name"]):
                q, s, low = encode(query or ""), encode(sig or query or ""), (name or "").lower()
                spans_ = line_windows(text or "")
                rank = lambda w: float(q @ encode(text[w[0] : w[1]])) - min(max((w[1] - w[0] - 500) / 14500 * 0.15, 0.0), 0.15) + 0.05 * (low in text[w[0] : w[1]].lower())
                best = (-1.0, -1)
                for a, b in sorted(spans_, key=rank, reverse=True)[:3]:
                    first = text.count("\n", 0, a)
                    for i, line in enumerate(text[a:b].split("\n")):
                        if line.strip():
                            v = encode(line)
                            best = max(best, (round(float(q @ v) + 0.08 * float(s @ v) + 0.30 * (low != "" and low in line.lower()), 6), -(first + i)))
                if best[0] >= 0:
                    rows.append((doc, member, -best[1], best[0]))
            yield pd.DataFrame(rows, columns=["doc_id", "id", "line_no", "score"])

    return pairs.select("doc_id", "id", "text", "query", "signature", "name").mapInPandas(run, "doc_id long, id long, line_no long, score double")


def semantic_query(api: Column, kind: Column, docstring: Column, signature: Column, model: str = "") -> Column:
    """The text to look for a member by: its kind and names, its first sentence, its signature; models of one family want a prefix."""
    p = F.split(api, "[.]")
    short = F.element_at(p, -1)
    word = F.when(kind.isin("class", "function", "method", "variable"), kind).otherwise("API")
    module = F.regexp_replace(api, r"\.[^.]*$", "")
    method = F.concat(F.lit("API reference documentation for the "), short, F.lit(" "), word, F.lit(" of "), F.element_at(p, -2), F.lit(" with fully qualified name "), api)
    other = F.concat(F.lit("API reference documentation for "), short, F.lit(" "), word, F.when(api.contains("."), F.concat(F.lit(" in "), module, F.lit(" with fully qualified name "), api)).otherwise(""))
    first = F.trim(F.split(F.trim(coalesce_text(docstring)), r"\.(?:\s|$)")[0])
    said = F.when(F.length(first) > 10, F.concat(F.lit(" : "), first)).otherwise("")
    hint = F.when((kind != "variable") & (coalesce_text(signature) != ""), F.concat(F.lit(" (signature: "), signature, F.lit(")"))).otherwise("")
    head = F.when((kind == "method") & (F.size(p) > 1), method).otherwise(other)
    return F.concat(F.lit("query: " if "e5" in model.lower() else ""), head, said, hint)


def signature_query(api: Column, kind: Column, signature: Column, model: str = "") -> Column:
    sig = F.coalesce(F.nullif(_spelt(coalesce_text(signature)), F.lit("")), F.concat(api, F.lit("()")))
    what = F.when(kind == "class", "definition").otherwise("signature")
    return F.concat(F.lit("query: " if "e5" in model.lower() else ""), F.coalesce(kind, F.lit("function")), F.lit(" with API name "), api, F.lit(" starting "), what, F.lit(" line: "), sig)


def signature_prefix(sig: Column, most: int = 3) -> Column:
    """The name and the first parameters of a signature, brackets one level deep kept whole."""
    inner = F.regexp_extract(sig, r"^[^(]*\((.*)$", 1)
    items = F.transform(F.slice(F.regexp_extract_all(F.regexp_replace(inner, r"\)[^)]*$", ""), F.lit(r"((?:[^,\[\](){}]|\[[^\]]*\]|\([^)]*\)|\{[^}]*\})+)"), 1), 1, most), lambda x: F.trim(x))
    return F.when(sig.contains("("), F.concat(F.substring_index(sig, "(", 1), F.lit("("), F.array_join(items, ", "))).otherwise(sig)


def tolerant_pattern(name: Column) -> Column:
    """A regex for a dotted name before a bracket that lets white space stand around dots and for underscores."""
    part = lambda x: F.regexp_replace(x, "_", r"[_\\s]*")
    return F.concat(F.lit(r"(?is)\b"), F.array_join(F.transform(F.split(name, "[.]"), part), r"\s*\.\s*"), F.lit(r"\s*\("))


def joined_signatures(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, n_lines, text): lines in whose middle brackets stay open joined with those that close them.

    A joined line ends where the open brackets balance, at a blank line or a fence; other lines stay as they are.
    """
    order = W.partitionBy(key).orderBy("line_no")
    opens = F.regexp_count("line", F.lit(r"[(\[]")) - F.regexp_count("line", F.lit(r"[)\]]"))
    starts = F.col("stripped").rlike(r"^(?:class\s+)?[A-Za-z_][\w.]*\s*\(") & (opens > 0)
    hard = (F.col("stripped") == "") | F.col("is_fence")
    l = lines.withColumn("d", F.when(hard, 0).otherwise(opens)).withColumn("block", F.sum(F.when(hard | starts, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inside = W.partitionBy(key, "block").orderBy("line_no")
    l = l.withColumn("head", F.first(starts).over(inside)).withColumn("before", F.coalesce(F.sum("d").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    l = l.withColumn("open", F.col("head") & (F.col("before") > 0))
    l = l.withColumn("broken", F.sum(F.when(F.col("open"), 0).otherwise(1)).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    unit = F.concat_ws("-", "block", "broken")
    return l.groupBy(key, unit.alias("unit")).agg(F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "stripped", "line"))), lambda x, i: F.when(i == 0, F.rtrim(x["line"])).otherwise(x["stripped"])), " ").alias("text")).drop("unit")


def list_item(line: Column) -> Column:
    return line.rlike(r"^\s*([-*•►▪]\s|\d+[.)]\s|\(\d+\)\s|:[a-z_]+:)")


def prose_with_call(line: Column) -> Column:
    """A sentence that holds a call: brackets balance and it ends with a stop after a word, a digit or a bracket without a default."""
    t = F.trim(line)
    balanced = F.regexp_count(t, F.lit(r"\(")) == F.regexp_count(t, F.lit(r"\)"))
    return balanced & t.rlike(r"[\w)]\s*\.$") & ~(t.contains("=") & t.rlike(r"[\d)]\s*\.$")) & ~t.rlike(r"\w+\.\w+\.$")


def signature_start(line: Column) -> Column:
    t = F.trim(line)
    return t.rlike(r"^(?:class\s+)?[A-Za-z_][\w.]*\s*\(") & ~prose_with_call(t)


# sections


def title_paths(sections: DataFrame) -> DataFrame:
    """(doc_id, line_no, path array<string>): the titles above each heading and its own; levels are at most six, so one running column per level carries them."""
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = sections
    for k in range(1, 7):
        s = s.withColumn(f"l{k}", F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(w)).withColumn(f"t{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(w))
    titles = []
    for k in range(1, 7):
        newer = [F.col(f"l{j}") > F.col(f"l{k}") for j in range(1, k)]
        hidden = F.lit(False)
        for c in newer:
            hidden = hidden | F.coalesce(c, F.lit(False))
        titles.append(F.when((F.col("level") >= k) & ~hidden & ((F.col("level") != k) | (F.col(f"l{k}") == F.col("line_no"))), F.col(f"t{k}")))
    return s.select("doc_id", "line_no", F.array_compact(F.array(*titles)).alias("path"))


def section_texts(docs: DataFrame, tree: DataFrame, most: int = 5000) -> DataFrame:
    """(doc_id, line_no, text): each section's own lines, of at most ``most`` characters (what a model is shown)."""
    j = tree.join(docs.select("doc_id", F.split("text", "\n").alias("rows")), "doc_id")
    body = F.array_join(F.slice("rows", F.col("line_no") + 1, F.col("end_line") - F.col("line_no") + 1), "\n")
    return j.select("doc_id", "line_no", F.substring(body, 1, most).alias("text"))


def candidate_sections(tree: DataFrame, words: list[str], depth: int = 2) -> DataFrame:
    """Sections whose title holds one of the words, at the least level such titles have in the document, and those at most ``depth`` levels below them."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("title").contains(w.lower())
    t = tree.withColumn("hit", hit)
    doc = W.partitionBy("doc_id")
    t = t.withColumn("top", F.min(F.when(F.col("hit"), F.col("level"))).over(doc)).where("top is not null")
    order = doc.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("under", F.last(F.when(F.col("level") <= F.col("top"), F.col("hit") & (F.col("level") == F.col("top"))), ignorenulls=True).over(order))
    return t.where(F.col("under") & (F.col("level") <= F.col("top") + depth)).select("doc_id", "line_no", "level", "title")


def not_covered(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, id, level, first_page, last_page) that have a page no deeper section has."""
    pages = sections.select("doc_id", "id", "level", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    deepest = pages.groupBy("doc_id", "page").agg(F.max("level").alias("deepest"))
    keep = pages.join(deepest, ["doc_id", "page"]).where("level = deepest").select("doc_id", "id").distinct()
    return sections.join(keep, ["doc_id", "id"], "left_semi")


# names and aliases


def alias_index(members: DataFrame) -> DataFrame:
    """(alias, id, exact): every public name of (id, api_name, names) as it is, and in lower case where no name is spelt so; the least id of equals."""
    each = members.select("id", F.explode(F.array_distinct(F.concat(F.array("api_name"), F.coalesce("names", F.array().cast("array<string>"))))).alias("alias")).where("alias is not null")
    exact = each.groupBy("alias").agg(F.min("id").alias("id")).withColumn("exact", F.lit(True))
    low = each.groupBy(F.lower("alias").alias("alias")).agg(F.min("id").alias("id")).join(exact.select("alias"), "alias", "left_anti").withColumn("exact", F.lit(False))
    return exact.unionByName(low)


def extraction_list(fragments: DataFrame, index: DataFrame, done: DataFrame) -> DataFrame:
    """(name, id, exact): the members that page fragments (name) ask for: dotted, no module anchors, not extracted yet; exact names before lower-case ones."""
    asked = fragments.where("name like '%.%' and not startswith(name, 'module-')").select("name").distinct()
    direct = asked.join(index.where("exact").withColumnRenamed("alias", "name"), "name")
    rest = asked.join(direct.select("name"), "name", "left_anti").withColumn("alias", F.lower("name")).join(index, "alias").withColumn("exact", F.lit(False)).select("name", "id", "exact")
    return direct.select("name", "id", "exact").unionByName(rest).join(done.select("id"), "id", "left_anti").select("name", "id", "exact")


def first_not_empty(*frames: DataFrame) -> DataFrame:
    """The rows of the first of the frames that has any."""
    for f in frames[:-1]:
        if not f.isEmpty():
            return f
    return frames[-1]


def score_profile(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n, mean, deviation, best, second): the cosine scores of a stated query set against all vectors, as sums of each batch that are added up."""
    from spanwright.operators.textsearch import query_blocks

    out = None
    for ids, unit in query_blocks(queries):
        def run(frames: Iterator[pd.DataFrame], ids=ids, unit=unit) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf) and len(ids):
                    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    s = unit @ np.divide(x, n, out=np.zeros_like(x), where=n > 0).T
                    s[pdf["vec_id"].to_numpy()[None, :] == ids[:, None]] = np.nan
                    top = -np.sort(-np.nan_to_num(s, nan=-2.0), axis=1)
                    yield pd.DataFrame({"query_id": ids, "n": np.isfinite(s).sum(1), "s1": np.nansum(s, 1), "s2": np.nansum(s * s, 1), "a": top[:, 0], "b": top[:, 1] if top.shape[1] > 1 else -2.0})

        part = vectors.where("embedding is not null").select("vec_id", "embedding").mapInPandas(run, "query_id long, n long, s1 double, s2 double, a double, b double")
        out = part if out is None else out.unionByName(part)
    tops = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list(F.array("a", "b"))))), 1, 2)  # two numbers per batch of vectors
    g = out.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), tops.alias("t"))
    mean = F.col("s1") / F.col("n")
    return g.select("query_id", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("deviation"), F.col("t")[0].alias("best"), F.col("t")[1].alias("second"))


def acceptance(profile: DataFrame, sigma: float = 0.25, margin: float = 0.20) -> DataFrame:
    """(query_id, threshold, unsure): mean less a quarter deviation; unsure unless the best is well above the mean and well ahead of the second."""
    d = F.col("deviation") + 1e-6
    clear = (F.col("best") >= F.col("mean") + sigma * d) & (F.col("best") - F.col("second") >= margin * F.greatest(F.lit(1e-6), F.col("best")))
    return profile.select("query_id", (F.col("mean") - 0.25 * d).alias("threshold"), (~clear).alias("unsure"))
