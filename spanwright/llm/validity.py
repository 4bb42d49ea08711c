"""Source files that do not parse: lexers with a pushdown stack, then an exact check where one exists.

Every file goes through the lexer of its extension's language (``lexing``; for
Python ``pystack``, with stacks of brackets, indents and blocks).  What they fault is
invalid.  Exact parsers follow: a Python file that the recogniser faults must be
refused by the compiler too, and what the Python and TOML lexers pass is parsed
once more; what that alone finds is of the kind ``parser`` and counted apart in the rates.

Defined results: null content is no case; an unknown extension is no case; a
byte-order mark and any line end are no fault; an empty text is valid Python,
ECMAScript and TOML and invalid JSON; repeated rows count once; texts too deep
for the exact parser (RecursionError, MemoryError) are left as the lexer found
them; extra columns are ignored.
"""

from __future__ import annotations

import ast
import tomllib
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm import pystack
from spanwright.llm.lexing import javascript_fault, json_fault, line_ends, python_fault, toml_fault
from spanwright.runtime import spread

LANGUAGE = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "json": "json", "toml": "toml"}


def extension(path: str = "file_path"):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _parses(text: str, parse) -> bool:
    try:
        parse(text)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        pass
    return True


def _python(text: str) -> ast.AST:
    return compile(text, "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)


def fault(ext: str, content: str) -> str | None:
    """The kind of fault of one file, or None."""
    text = line_ends(content)
    if ext == "json":
        return json_fault(text)
    if ext == "toml":
        return toml_fault(text) or (None if _parses(text, tomllib.loads) else "parser")
    if ext not in ("py", "pyi"):
        return javascript_fault(text)
    found = pystack.fault(text)
    if _parses(text, _python):
        return None
    return (python_fault(text) or found) if found else "parser"  # the plain lexer names the fault more closely


def checked_files(files: DataFrame) -> DataFrame:
    """(file_id, library, language, fault) per row of a file with content and a known extension; fault null if valid.

    One pass over the scan without a shuffle; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        for b in batches:
            ext = b.column(2).to_pylist()
            kinds = [fault(e, c) for e, c in zip(ext, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([LANGUAGE[e] for e in ext], pa.string()), pa.array(kinds, pa.string())], names=["file_id", "library", "language", "fault"])

    read = files.select("file_id", "library", extension().alias("ext"), "content").where(F.col("content").isNotNull() & F.col("ext").isin(*LANGUAGE))
    return spread(read).mapInArrow(run, "file_id long, library string, language string, fault string")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id): the invalid files, each once."""
    return checked_files(files).where("fault is not null").select("file_id").distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """(library, language, n_files, n_invalid, n_parser_only, rate) with a file counted once; null libraries form one group.

    n_parser_only: those of the invalid files that no lexer faults.
    """
    once = checked_files(files).groupBy("file_id").agg(F.first("library").alias("library"), F.first("language").alias("language"), F.max("fault").alias("fault"))
    rates = once.groupBy("library", "language").agg(F.count("*").alias("n_files"), F.count("fault").alias("n_invalid"), F.count_if(F.col("fault") == "parser").alias("n_parser_only"))
    return rates.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
