"""Source files that nobody wrote by hand for their library: generated, minified, vendored, data as code.

A linear support-vector classifier over hashed features: character 4-grams of
the body, path components, words of the leading comment, and the shape of the
text.  The names of libraries are masked by role (the file's own, or another's),
so a copy is told by whose names it bears and not by which.  Giveaway headers are
masked in one of the two versions that each training row is shown in, so the
model must do without them but uses them where they stand.

Training rows are a bounded sample (``SAMPLE_FILES``) labelled by ``label``:
declared origins (a header with a verb of origin, or that forbids editing),
tool-specific names, the names of other libraries where the file's own is not
borne, and contents that hardly a person types.  A masked copy of a row keeps the row's label.
``exclude_patterns`` are one such hint: a path they cover counts as a feature
only, as they are too wide in places and incomplete in others.  Validation splits
by library (``validation``).

Defined results: null content is no case; empty content is hand-written; null
paths have no path features; repeated rows count once; whether a file is valid
does not matter; extra columns are ignored.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.sampling import bounded_sample
from spanwright.runtime import spread

#: Labelled rows used for fitting; the cost of fitting does not grow with the input.
SAMPLE_FILES = 5000
_BITS = 18
_MASK = (1 << _BITS) - 1
_EPOCHS = 6
_C = 1.0

_WORD = re.compile(r"[a-z][a-z0-9]{3,30}")
_LEAD = re.compile(r"(?:\s*(?:#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|--[^\n]*)[ \t]*(?:\n|$))+")
_DOCSTRING = re.compile(r"\s*(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})")
_IMPORT = re.compile(r"^[ \t]*(?:from|import)[ \t]+([A-Za-z_]\w*)", re.M)
# fixed values: verbs of origin with what follows them, prohibitions, and marks that tools write; of any project, none of a data set
_DECLARED = re.compile(
    r"\b(?:auto|machine)[- ]?(?:generated|written|made)\b|@generated\b|\bgenerated\b.{0,40}\b(?:by|from|with|file|code)\b|\b(?:do not|don't|never)\b.{0,30}\b(?:edit|modify|change)\b|\bedit\b.{0,60}\binstead\b|\bwritten by\b.{0,40}(?:\.\w+\b|/)"
    r"|\b(?:vendored|copied|taken|adapted|imported|mirrored|forked|derived|extracted|bundled|synced|kept in sync)\b.{0,40}\b(?:from|of|with|unchanged|verbatim)\b|\b(?:third|3rd)[- ]party\b|\bupstream\b|\bcode generator\b|^[^\w\n]*(?:plugin|source|protoc?|bundle)\b[: ]",
    re.I | re.M,
)
_NOT_DECLARED = re.compile(r"\bnot\b.{0,20}\bgenerated\b|\bby hand\b|\bhand[- ]written\b", re.I)
_TOOL_NAME = re.compile(r"(?:_pb2(?:_grpc)?|(?:^|_)parsetab(?:_\w+)?|[._]gen(?:erated)?|\.min|\.bundle|_manifest|^generated_\w+)\.(?:py|pyi|js|mjs|json)$")
_COPY_DIR = {"vendor", "_vendor", "vendors", "third_party", "thirdparty", "extern", "external", "node_modules", "deps", "_bundled", "imported", "contrib"}  # fixed values: usual homes of copies
# fixed values: what tables of parsers, of message formats and of package managers look like
_TABLES = re.compile(r"wire: ?\d|wire=\d|_goto = |_action_items|_table_version|_invoke\(\d|\"integrity\"|\"lockfileVersion\"|_DESCRIPTOR = ")
_LITERAL = re.compile(r"\"{3}(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|`(?:[^`\\]|\\[\s\S])*+`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'")


def masked(text: str, library: str | None, libraries: frozenset[str]) -> str:
    """The text with library names replaced by their role."""
    text = text.removeprefix("\ufeff")
    names = set(_WORD.findall(text)) & libraries
    if library and library in text:
        text = text.replace(library, "LIBOWN")
        names.discard(library)
    for name in sorted(names, key=len, reverse=True):
        text = text.replace(name, "LIBOTHER")
    return text


def _shape(body: str) -> list[str]:
    n = max(1, len(body))
    lines = body.split("\n")
    longest = max(map(len, lines))
    letters = np.frombuffer(body.encode("latin-1", "replace"), np.uint8)
    count = np.bincount(letters, minlength=256)
    digits, spaces, upper = count[48:58].sum() / n, (count[32] + count[10] + count[9]) / n, count[65:91].sum() / n
    punct = (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / n
    return [
        f"s:long{min(14, longest.bit_length())}", f"s:mean{min(12, (n // len(lines)).bit_length())}", f"s:dig{int(digits * 10)}", f"s:sp{int(spaces * 12)}", f"s:up{int(upper * 8)}", f"s:pu{int(punct * 10)}",
        f"s:lsp{min(14, longest.bit_length())}-{int(spaces * 12)}", f"s:n{min(14, n.bit_length())}",
    ]


def _path_parts(path: str | None, library: str | None, libraries: frozenset[str]) -> tuple[list[str], str]:
    parts = [p for p in re.split(r"[\\/]+", path or "") if p not in ("", ".")]
    roles = ["OWN" if p == library else "OTHER" if p in libraries else p for p in parts]
    return roles[:-1], roles[-1] if roles else ""


def _grams(body: str) -> np.ndarray:
    """Distinct hashed character 4-grams of the whole body (over its UTF-8 bytes, numbers as one sign)."""
    b = np.frombuffer(re.sub(r"\d+", "0", body).encode(), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64)
    h = b[:-3] * np.uint32(2654435761) ^ b[1:-2] * np.uint32(2246822519) ^ b[2:-1] * np.uint32(3266489917) ^ b[3:] * np.uint32(668265263)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    seen = np.zeros(1 << _BITS, bool)
    seen[(h >> np.uint32(32 - _BITS))] = True
    return np.flatnonzero(seen)


def features(path: str | None, content: str, library: str | None, libraries: frozenset[str], patterns: list[tuple[str, str]], header: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, values): the 4-grams together have norm 1, the named features 0.35 each."""
    text = masked(content, library, libraries)
    lead = _LEAD.match(text)
    head, body = (lead[0], text[lead.end() :]) if lead else ("", text)
    grams = _grams(body)
    dirs, name = _path_parts(path, library, libraries)
    named = [f"d:{d}" for d in dirs] + [f"dd:{a}/{b}" for a, b in zip(dirs, dirs[1:])] + [f"n:{w}" for w in re.split(r"[\W_\d]+", name) if w]
    named += [f"m:{bool(_TOOL_NAME.search(name))}", f"e:{name.rsplit('.', 1)[-1]}"]
    if any(d == "OTHER" for d in dirs):
        named += ["p:other", "p:other/" + ("copy" if any(d in _COPY_DIR for d in dirs) else "plain")]
    named += _shape(body)
    roots = set(_IMPORT.findall(body))
    named += [f"i:{'LIBOWN' in roots}{'LIBOTHER' in roots}", f"o:{'LIBOWN' in body}{'LIBOTHER' in body}"]
    full = (path or "").replace("\\", "/").removeprefix("./")
    for pattern, kind in patterns:
        if kind == "dir" and ("/" + full).find("/" + pattern) >= 0 or kind != "dir" and fnmatch.fnmatchcase(name, pattern):
            named.append("x:" + pattern)
    if header:
        words = re.findall(r"[A-Za-z@]{3,}", head)
        named += [f"h:{w.lower()}" for w in set(words)] + [f"hh:{a.lower()} {b.lower()}" for a, b in zip(words, words[1:])]
    extra = np.fromiter({crc32(x.encode()) & _MASK for x in named}, np.int64)
    return np.concatenate([grams, extra]), np.concatenate([np.full(len(grams), 1 / max(1.0, np.sqrt(len(grams)))), np.full(len(extra), 0.35)])


def _declared(head: str) -> bool:
    """Does a leading comment (library names masked) say that the file comes from elsewhere?"""
    lines = [x for x in head.split("\n") if not _NOT_DECLARED.search(x)]
    if any(map(_DECLARED.search, lines)):
        return True
    return "LIBOWN" not in head and any(re.search(r"(?i)\b(?:copyright|licen[cs]ed?|part of|manual|project)\b.{0,60}LIBOTHER|LIBOTHER.{0,60}\b(?:copyright|licen[cs]ed?|authors?|manual)\b", x) for x in lines)


def _is_data(body: str) -> bool:
    """Is most of a text digits, or literals of characters without words?"""
    n = len(body)
    if sum(c.isdigit() for c in body) > 0.35 * n:
        return True
    coded = sum(len(x) for x in _LITERAL.findall(body) if len(x) > 40 and x.count(" ") < 0.04 * len(x))
    return coded > 0.5 * n


def label(path: str | None, content: str, library: str | None, libraries: frozenset[str]) -> bool:
    """Training label: is the file's origin declared, in its tool's naming, or plain from contents no one types?"""
    text = masked(content, library, libraries)
    lead = _LEAD.match(text)
    head, body = (lead[0], text[lead.end() :]) if lead else ("", text)
    dirs, name = _path_parts(path, library, libraries)
    if _declared(head) or _declared((_DOCSTRING.match(body) or [""])[0]):
        return True
    if "OTHER" in dirs or _TOOL_NAME.search(name) and not re.search(r"generator", name):
        return True
    if len(_TABLES.findall(body)) > 1:
        return True
    roots = set(_IMPORT.findall(body))
    if "LIBOTHER" in roots and "LIBOWN" not in roots:
        return True
    if body and not name.endswith((".json", ".toml")):
        longest = max(body.split("\n"), key=len)
        if len(longest) > 300 and len(longest) > 0.5 * len(body) and longest.count(" ") < 0.14 * len(longest):
            return True
        return len(body) > 100 and _is_data(body)
    return False


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[bool], c: float = _C, epochs: int = _EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of a linear SVM (hinge loss, L2) by dual coordinate descent; the last entry is the bias."""
    w = np.zeros((1 << _BITS) + 1)
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    square = [float(v @ v) + 1 for _, v in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, values = rows[k]
            y = 1.0 if labels[k] else -1.0
            g = y * (values @ w[ids] + w[-1]) - 1
            new = min(max(alpha[k] - g / square[k], 0.0), c)
            if new != alpha[k]:
                step = (new - alpha[k]) * y
                w[ids] += step * values
                w[-1] += step
                alpha[k] = new
    return w


def _versions(sample: list[tuple], libraries: frozenset[str], patterns: dict) -> tuple[list, list[bool]]:
    rows, labels = [], []
    for path, content, library in sample:
        y = label(path, content, library, libraries)
        known = patterns.get(library, [])
        rows += [features(path, content, library, libraries, known), features(path, content, library, libraries, known, header=False)]
        labels += [y, y]
    return rows, labels


def _small_tables(libraries: DataFrame, patterns: DataFrame) -> tuple[frozenset[str], dict[str, list[tuple[str, str]]]]:
    """The library names and patterns: fixed tables that do not grow (60 and about 320 rows)."""
    names = frozenset(r[0] for r in libraries.select("library").distinct().collect() if r[0])
    by: dict[str, list[tuple[str, str]]] = {}
    for lib, pattern, kind in patterns.select("library", "pattern", "pattern_kind").distinct().collect():
        if pattern:
            by.setdefault(lib, []).append((pattern, kind))
    return names, by


def _read(files: DataFrame) -> DataFrame:
    return files.select("file_id", "file_path", "content", "library").where("content is not null and file_id is not null")


def foreign_files(files: DataFrame, libraries: DataFrame, patterns: DataFrame, sample_files: int = SAMPLE_FILES) -> DataFrame:
    """(file_id): files that were not written by hand for their library."""
    spark = files.sparkSession
    names, by = _small_tables(libraries, patterns)
    read = _read(files)
    sample = {r[0]: tuple(r)[1:] for r in bounded_sample(read, "file_id", sample_files)}
    weights = train(*_versions(list(sample.values()), names, by)) if sample else np.zeros((1 << _BITS) + 1)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**18 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            found = []
            for key, path, content, library in zip(*(c.to_pylist() for c in b.columns)):
                ids, values = features(path, content, library, names, by.get(library, []))
                if content.strip() and values @ w[ids] + w[-1] > 0:
                    found.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["file_id"])

    return spread(read).mapInArrow(run, "file_id long").distinct()


def validation(files: DataFrame, libraries: DataFrame, patterns: DataFrame, sample_files: int = SAMPLE_FILES) -> DataFrame:
    """(n_train, n_held_out, precision, recall, masked_recall) on libraries the model was not fitted on.

    masked_recall: of the held-out files that declare their origin in a header, the
    share found when the model does not see the header: there the label's evidence is none of the features.
    """
    names, by = _small_tables(libraries, patterns)
    sample = list({r[0]: tuple(r)[1:] for r in bounded_sample(_read(files), "file_id", sample_files)}.values())
    order = sorted({r[2] or "" for r in sample})
    held = set(order[::5])
    fit_on, test = [r for r in sample if (r[2] or "") not in held], [r for r in sample if (r[2] or "") in held]
    w = train(*_versions(fit_on, names, by)) if fit_on else np.zeros((1 << _BITS) + 1)
    tp = fp = fn = seen = told = 0
    for path, content, library in test:
        said, truth = _says(w, features(path, content, library, names, by.get(library, []))), label(path, content, library, names)
        tp, fp, fn = tp + (said and truth), fp + (said and not truth), fn + (truth and not said)
        lead = _LEAD.match(masked(content, library, names))
        if lead and _declared(lead[0]):
            seen += 1
            told += _says(w, features(path, content, library, names, by.get(library, []), header=False))
    share = lambda a, b: round(float(a / b), 6) if b else None
    row = (len(fit_on), len(test), share(tp, tp + fp), share(tp, tp + fn), share(told, seen))
    return files.sparkSession.createDataFrame([row], "n_train long, n_held_out long, precision double, recall double, masked_recall double")


def _says(w: np.ndarray, row: tuple[np.ndarray, np.ndarray]) -> bool:
    return bool(row[1] @ w[row[0]] + w[-1] > 0)
