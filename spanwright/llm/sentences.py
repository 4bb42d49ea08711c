"""Sentence boundaries across languages and scripts.

Document-centred disambiguation: whether a token that ends with a full stop is an
abbreviation, whether it can end a sentence, and whether a capitalised word is a
proper name is read off its unambiguous occurrences, first in the document
itself, then in the whole corpus.  Unambiguous are: a stop before a lower-case
word or a comma (the token is an abbreviation), a stop at the end of a block (it
can end a sentence), a capitalised word at the start of a block or in lower case
(it is no proper name).  Scripts have terminators of their own; Thai, which has
none, is cut at spaces between Thai letters.

Blocks come first: blank lines part paragraphs, a heading is one block, a list
entry ends with its line.  Line ends within a paragraph count as spaces.

Defined results: null, empty and blank texts have no sentences; every other
character that is not white space lies in exactly one sentence; offsets count
code points; repeated doc_ids give equal rows, which are merged; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.runtime import spread, written

#: The corpus tables go to the executors as one broadcast dictionary up to this many entries; beyond, they are joined per document.
DICTIONARY_LIMIT = 1_000_000

_MARKER = re.compile(r"[ \t]*(?:[-*•‣◦–]|\d{1,3}[.)]|[a-zA-Z]\))[ \t]+")
_BULLET = re.compile(r"[ \t]*[-*•‣◦][ \t]+")
_HEAD = re.compile(r"[ \t]*#{1,6}[ \t]")
_RUN = re.compile(r"[.!?…]+|[。！？｡．]+|[।॥]+|[؟۔]+[!؟]*")
_CLOSER = "\"”’»«›“」』）)]}】》〉]"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "“": "”", "«": "»", "„": "“”", "‹": "›"}
_OPENS_OF: dict[str, str] = {}
for _open, _closers in _PAIRS.items():
    for _c in _closers:
        _OPENS_OF[_c] = _OPENS_OF.get(_c, "") + _open
_MARKS = re.compile("[\"()\\[\\]{}（）「」『』【】《》“”„«»‹›]")
_OPENERS = "\"'“„«‹([{「『（【《¿¡‘"
_CJK = re.compile(r"[぀-ヿ㐀-鿿＀-￯　-〿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[ \t \n]+(?=[฀-๿])")
_NEXT = re.compile(r"\S{1,120}")
_CASELESS = re.compile(r"[\u0590-\u08ff\u0900-\u0dff\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
_CODE = re.compile(r"[\w$]*(?:[._:/\\(]\w|_|[a-z0-9][A-Z])|v\d|\w+\(\)|https?:|\w+@\w")
_NUMBER = re.compile(r"[\W_]*v?\d[\d.,:/-]*%?")
_ORDINAL_BEFORE = {"im", "am", "der", "die", "das", "dem", "den", "des", "vom", "zum", "beim", "ab", "bis", "seit", "jeder", "jede", "und", "oder", "dieser", "ein", "einem", "einen", "kein"}  # fixed values: words before a German ordinal
_JA_GOES_ON = "とってはがのにをもで、"  # fixed values: particles that tie a quotation to what follows
_ZH_SAYS = re.compile(r"[一-鿿\w]{0,6}?[问說说道答写想喊叫]")


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, where the first word begins) of headings, list entries and paragraphs."""
    at, n = 0, len(text)
    para: list[tuple[int, int]] = []
    lines = []
    while at <= n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        lines.append((at, end))
        at = end + 1
    for s, e in [*lines, (n, n)]:
        if not text[s:e].strip():
            if para:
                yield from _paragraph(text, para)
                para = []
            continue
        para.append((s, e))


def _paragraph(text: str, lines: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    s0, e0 = lines[0]
    if _MARKER.match(text, s0, e0):
        for s, e in lines:
            m = _MARKER.match(text, s, e)
            yield s, e, m.end() if m else s
        return
    begin = s0
    for k, (s, e) in enumerate(lines):
        if _HEAD.match(text, s, e):
            if s > begin:
                yield begin, s - 1, begin
            yield s, e, _HEAD.match(text, s, e).end()
            begin = e + 1
        elif k and s > begin and _BULLET.match(text, s, e) and text[: s - 1].rstrip()[-1:] in ".!?:;。！？…":
            yield begin, s - 1, begin
            yield from _paragraph(text, lines[k:])
            return
    if begin < lines[-1][1]:
        yield begin, lines[-1][1], begin


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Matched quotation marks and brackets of a block; what has no partner is no pair."""
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()  # kinds on the stack, so that a mark without a partner costs no search
    out = []

    def close(k: int, p: int) -> None:
        out.append((stack[k][1], p))
        opened.subtract(x for x, _ in stack[k:])
        del stack[k:]

    for m in _MARKS.finditer(text, start, end):
        c, p = m[0], m.start()
        if c == '"':
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == '"'), None) if opened['"'] > 0 else None
            if k is not None and not text[p - 1].isspace():
                close(k, p)
            elif p == start or text[p - 1].isspace() or text[p - 1] in _OPENERS or _CJK.match(text[p - 1]):
                stack.append((c, p))
                opened[c] += 1
            continue
        k = next((i for i in range(len(stack) - 1, -1, -1) if c in _PAIRS.get(stack[i][0], "")), None) if any(opened[o] > 0 for o in _OPENS_OF.get(c, "")) else None
        if k is not None:
            close(k, p)
        elif c in _PAIRS:
            stack.append((c, p))
            opened[c] += 1
    return sorted(out)


def _token_before(text: str, start: int, at: int) -> str:
    i = at
    while i > start and not text[i - 1].isspace() and text[i - 1] not in "([{\"“„«‹「（'":
        i -= 1
    return text[i:at]


class Evidence:
    """Counts of unambiguous occurrences: stops[token] = [before lower case or comma, before a number, at a block's end, other, without the stop];
    words[word] = [in lower case or at a block's start, capitalised within a sentence];
    words["^" + word] = [lower-case word at a block's start, elsewhere]."""

    def __init__(self) -> None:
        self.stops: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
        self.words: dict[str, list[int]] = defaultdict(lambda: [0, 0])


def _starts_low(word: str) -> bool:
    """A plain lower-case word: no code, no version."""
    return word[:1].islower() and not _CODE.match(word)


def observe(text: str, library: str | None, into: Evidence) -> None:
    """Add the unambiguous occurrences of one text."""
    for start, end, first in _blocks(text):
        body = text[first:end]
        words = body.split()
        for k, w in enumerate(words):
            if k and (w[-1] in ".…" or len(w) > 1 and w[-2] in ".…" and w[-1] in ",;:"):
                token = w.rstrip(",;:").lstrip("([{\"“„«‹「（'")
                token, stop = (token[:-1], token[-1]) if token and token[-1] in ".…" else ("", "")
                if not token or _NUMBER.fullmatch(token) or token[-1] in ".…":
                    continue
                if k + 1 < len(words) and words[k + 1][0] in "»”’":
                    continue
                c = into.stops[token + stop]
                nxt = words[k + 1].lstrip(_OPENERS) if k + 1 < len(words) else None
                if w[-1] not in ".…" or nxt is not None and _starts_low(nxt) and nxt.rstrip(".,!?") != library:
                    c[0] += 1
                elif nxt is None:
                    c[2] += 1
                elif nxt[:1].isdigit():
                    c[1] += 1
                else:
                    c[3] += 1
            elif k == 0 and w[-1] in ".…" and len(w) > 1 and len(words) > 1 and w[-2] not in ".…" and not _NUMBER.fullmatch(w[:-1]):
                nxt = words[1].lstrip(_OPENERS)
                c = into.stops[w]
                c[0 if _starts_low(nxt) else 1 if nxt[:1].isdigit() else 3] += 1
        for k, w in enumerate(words):
            core = w.strip("()[]{}\"“”„«»‹›'’.,;:!?…")
            if not core.isalpha():
                continue
            if len(core) <= 8 and w[-1] not in ".…" and w[-2:-1] not in (".", "…"):
                into.stops[core + "."][4] += 1
            if core[0].isupper():
                if k == 0:
                    into.words[core][0] += 1
                elif words[k - 1][-1].isalpha() or words[k - 1][-1] == ",":
                    into.words[core][1] += 1
            elif core[0].islower():
                into.words[core[0].upper() + core[1:]][0] += 1
                into.words["^" + core][k > 0] += 1


def is_abbreviation(token: str, c: list[int] | None, enough: int) -> tuple[bool, bool] | None:
    """(is an abbreviation, can end a sentence) of a token with its stop, by its counts; None if they do not tell."""
    core, stop = token[:-1], token[-1]
    letters = core.replace(".", "")
    formed = stop == "." and letters.isalpha() and (len(core) == 1 or "." in core and max(map(len, core.split("."))) <= 2)
    total = sum(c[:4]) if c else 0
    if total < enough and not (c and c[0] and c[2]):
        return (True, bool(c and c[2])) if formed and total >= enough else None
    ends = c[2] >= max(1, 0.02 * total)
    if formed:
        return True, ends
    if stop == "…":
        return True, ends
    if c[0] >= 0.2 * total or c[1] >= 0.5 * total and len(core) <= 8 or not c[2] and total >= 30 and len(core) <= 8 and 4 * c[4] <= total:
        return True, ends
    return False, True


class Knowledge:
    """Looks a token or word up in the document's evidence, then in the corpus's."""

    def __init__(self, stops: dict[str, tuple[bool, bool]], names: set[str]):
        self.stops, self.names = stops, names
        self.own = Evidence()

    def stop(self, token: str) -> tuple[bool, bool]:
        mine = self.own.stops.get(token)
        told = is_abbreviation(token, mine, 6) if mine and mine[0] and mine[2] else None
        if told is None:
            told = self.stops.get(token)
        if told is None and mine and mine[0] > 1 and not mine[2] and not mine[3]:
            told = True, False
        if told is None:
            core = token[:-1]
            told = (True, False) if len(core) == 1 and core.isalpha() or re.fullmatch(r"(?:\w\.)+\w", core) and not core[-1].isdigit() else (False, True)
        return told

    def name(self, word: str) -> bool:
        mine = self.own.words.get(word)
        if mine and mine[0]:
            return False
        return word in self.names or bool(mine and mine[1]) and word + "." not in self.stops

    def starts(self, word: str) -> bool:
        """Is the lower-case word a name that starts sentences as it is?"""
        return "^" + word in self.names


def _bare(word: str) -> str:
    return word.rstrip(".,;:!?…\"”»)")


def _goes_on(text: str, start: int, end: int, sent: int, run: re.Match, close: int, opened: int | None, know: Knowledge, library: str | None) -> bool:
    """Does the sentence from ``sent`` go on after a terminator whose closing marks end at ``close``?"""
    last = run[0][-1]
    nxt = text[close] if close < end else ""
    if last in "。！？｡．":
        if last == "．" and run.start() > start and text[run.start() - 1].isdigit() and nxt.isdigit():
            return True
        if opened is None:
            return nxt in ",、，；：;:"
        if opened > sent:
            return True
        if text[opened] in "（([【":
            return False
        rest = text[close : min(end, close + 40)].lstrip()
        return bool(rest[:1] in _JA_GOES_ON or re.match(r"[一-鿿]", rest) and _ZH_SAYS.match(rest[:8]) and not re.search(r"[぀-ヿ]", text[sent : min(end, close + 40)]))
    if not nxt.isspace():
        return True
    m = _NEXT.search(text, close, end)
    if m is None:
        return False
    word = m[0]
    plain = word.lstrip(_OPENERS)
    while not plain and (m := _NEXT.search(text, m.end(), end)):  # « with a space after it
        plain = m[0].lstrip(_OPENERS)
    bare = _bare(plain)
    if word[0] in "—–-,;:" or word[:1] in "»”’":
        return True
    if last in "।॥؟۔":
        return opened is not None and opened > sent
    cased = plain[:1].isupper() or plain[:1].islower()
    low = _starts_low(plain) and bare != library and word[0] not in "¿¡" and not know.starts(bare)
    caseless = run.start() > start and _CASELESS.match(text[run.start() - 1])
    if low and (caseless or (then := _NEXT.search(text, m.end(), end)) and _CASELESS.match(then[0])):
        low, caseless = False, True
    if opened is not None and opened > sent and not cased and not plain[:1].isdigit() and not _CJK.match(plain[:1] or " "):
        return True
    if run[0] == "." or run[0] == "…" or set(run[0]) == {"."} or run[0].startswith("…"):
        if low:
            return True
        before = text[run.start() - 1] if run.start() > start else " "
        if _CJK.match(before) and "…" in run[0]:
            return True
        if "ऀ" <= before <= "ॿ":
            return True
        if before.isspace():  # a free-standing ellipsis
            return not (plain[:1].isupper() and not know.name(bare))
        token = _token_before(text, sent, run.start())
        if _NUMBER.fullmatch(token):
            if len(token) <= 2 and token.isdigit() and plain[:1].isupper() and not _CODE.match(plain):
                prior = text[max(start, run.start() - 40) : run.start() - len(token)].split()
                return bool(prior) and prior[-1].lower() in _ORDINAL_BEFORE
            return False
        abbreviation, ends = know.stop(token + ("." if run[0] == "." else "…"))
        if run[0] != "." and not token.isalpha():
            return not plain[:1].isupper()
        if not abbreviation:
            return False
        if not ends:
            return True
        if plain[:1].isdigit():
            return True
        return bare.isalpha() and plain[:1].isupper() and not _CODE.match(plain) and know.name(bare)
    return low


def _split(text: str, start: int, end: int, first: int, know: Knowledge, library: str | None) -> Iterator[tuple[int, int]]:
    pairs = _pairs(text, start, end)
    opens = {}
    for o, c in pairs:
        opens[c] = o
    sent = start
    while sent < end and text[sent].isspace():
        sent += 1
    at, k, reach = first, 0, -1
    while True:
        run = _RUN.search(text, at, end)
        if run is None:
            break
        close, opened = run.end(), None
        while close < end:
            c = close
            if text[c].isspace() and c + 1 < end and text[c + 1] in "»" and c + 1 in opens:
                c += 1
            if text[c] in _CLOSER and (c in opens or text[c] not in '"“«'):
                if c in opens:
                    if opens[c] > run.start():
                        break
                    opened = opens[c]
                close = c + 1
            elif opened is not None and (more := _RUN.match(text, close, end)):
                close = more.end()
            else:
                break
        at = max(close, run.end())
        while k < len(pairs) and pairs[k][0] < run.start():
            reach = max(reach, pairs[k][1])  # how far the pairs opened so far extend
            k += 1
        if reach >= close:
            continue
        if close < end and _NEXT.search(text, close, end) and _goes_on(text, start, end, sent if first <= sent or sent > first else first, run, close, opened, know, library):
            continue
        if close > sent:
            yield sent, close
        sent = close
        while sent < end and text[sent].isspace():
            sent += 1
    stop = end
    while stop > sent and text[stop - 1].isspace():
        stop -= 1
    if stop > sent:
        yield sent, stop


def sentences(text: str | None, library: str | None, know: Knowledge) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text."""
    if not text or not text.strip():
        return []
    know.own = Evidence()
    observe(text, library, know.own)
    out: list[tuple[int, int]] = []
    for start, end, first in _blocks(text):
        for s, e in _split(text, start, end, first, know, library):
            at = s
            for gap in _THAI_GAP.finditer(text, s, e):
                out.append((at, gap.start()))
                at = gap.end()
            out.append((at, e))
    return out


# ---------------------------------------------------------------- corpus

_COUNTS = "kind string, token string, a long, b long, c long, d long, e long"


def corpus_evidence(docs: DataFrame) -> DataFrame:
    """(kind, token, a .. e): the whole corpus's counts, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(e: Evidence) -> pa.RecordBatch:
            rows = [("stop", t, *c) for t, c in e.stops.items()] + [("word", w, *c, 0, 0, 0) for w, c in e.words.items()]
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(cols)], names=["kind", "token", "a", "b", "c", "d", "e"])

        found = Evidence()
        for batch in batches:
            for text, library in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                observe(text, library, found)
            if len(found.stops) + len(found.words) > 200_000:
                yield out(found)
                found = Evidence()
        yield out(found)

    read = docs.select("text", "library").where("text is not null")
    return spread(read).mapInArrow(run, _COUNTS).groupBy("kind", "token").agg(*[F.sum(x).alias(x) for x in "abcde"])


def corpus_decisions(docs: DataFrame) -> DataFrame:
    """(token, verdict): abbreviations (``end`` if they can end a sentence, else ``mid``), plain words with a stop (``word``) and proper ``name``s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, verdicts = [], []
            for kind, token, *c in zip(*(x.to_pylist() for x in batch.columns)):
                if kind == "stop":
                    told = is_abbreviation(token, c, 3)
                    if told is None or not told[0]:
                        continue
                    tokens.append(token)
                    verdicts.append("end" if told[1] else "mid")
                elif c[0] >= max(2, 0.05 * (c[0] + c[1])) if token[0] == "^" else c[1] > 0 and c[0] <= 0.05 * (c[0] + c[1]):
                    tokens.append(token)
                    verdicts.append("name")
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(verdicts, pa.string())], names=["token", "verdict"])

    return corpus_evidence(docs).mapInArrow(run, "token string, verdict string")


def _knowledge(rows) -> Knowledge:
    return Knowledge({t: (True, v == "end") for t, v in rows if v != "name"}, {t for t, v in rows if v == "name"})


def keys_of(text: str) -> set[str]:
    """All that the splitter can look up while it splits the text, and more: no other entry of the dictionary can matter."""
    keys: set[str] = set()
    for m in _NEXT.finditer(text):
        bare = _bare(m[0].lstrip(_OPENERS))
        keys |= {bare, bare + ".", "^" + bare}
    for m in re.finditer(r"\S+", text):
        word = m[0]
        last = max((i for i, c in enumerate(word) if c.isalnum()), default=-1)
        for run in _RUN.finditer(word, last + 1):
            stop, head = "." if run[0] == "." else "…", word[: run.start()]
            keys.add(head + stop)
            keys.update(head[i + 1 :] + stop for i, c in enumerate(head) if not c.isalnum())  # a token or a sentence may start there
    return keys


def split_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence of ``documents``.

    One pass over all texts gathers the corpus's evidence, a second one splits.
    The decided tokens (abbreviations and names only) are broadcast while there
    are at most DICTIONARY_LIMIT of them; beyond, every document gets by a join those
    that its text can ask for (``keys_of``).
    """
    spark = docs.sparkSession
    decided = written(corpus_decisions(docs), "sentences")
    schema = "doc_id long, start_char long, end_char long"

    def rows(ids: list[int], found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        flat = [(i, s, e) for i, f in zip(ids, found) for s, e in f]
        cols = list(zip(*flat)) if flat else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start_char", "end_char"])

    read = docs.select("doc_id", "text", "library").where("text is not null and doc_id is not null")
    if decided.count() <= DICTIONARY_LIMIT:
        known = spark.sparkContext.broadcast([tuple(r) for r in decided.collect()])  # at most DICTIONARY_LIMIT short tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            know = _knowledge(known.value)
            for b in batches:
                ids, texts, libs = (c.to_pylist() for c in b.columns)
                yield rows(ids, [sentences(t, x, know) for t, x in zip(texts, libs)])

        return spread(read).mapInArrow(run, schema).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [(i, t) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in keys_of(x)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in flat], pa.int64()), pa.array([t for _, t in flat], pa.string())], names=["doc_id", "token"])

    own = read.select("doc_id", "text").mapInArrow(tokens, "doc_id long, token string").distinct().join(decided, "token")
    per_doc = own.groupBy("doc_id").agg(F.collect_list(F.struct("token", "verdict")).alias("known"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, libs, known = (c.to_pylist() for c in b.columns)
            yield rows(ids, [sentences(t, x, _knowledge([(r["token"], r["verdict"]) for r in k or []])) for t, x, k in zip(texts, libs, known)])

    return read.join(per_doc, "doc_id", "left").select("doc_id", "text", "library", "known").mapInArrow(each, schema).distinct()
