"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.runtime import spread, tokenizer_path, written

#: Vocabulary file within the tokenizer folder; its path is a parameter of ``sized_documents``.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# fixed value: the pre-tokenization pattern published with the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, made once per Python process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _copy_of(text: str) -> int | None:
    words = text.lower().split()
    if len(words) < 5 and sum(map(len, words)) < 24:
        return None  # too short to be a copy of anything
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def source_name(column: str = "source"):
    """One spelling per source: lower case, no outer space, ``_`` between words."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "_")


def sized_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copy_of): a written table, one row per doc_id.

    source in one spelling or null; n_tokens 0 for null and empty texts; copy_of
    is the hash of the text without regard to case and white space, so copies
    under several ids share it; texts of under five words (or 24 letters) have none.  Rows with a null doc_id are left out.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes = [len(encode(t)) if t else 0 for t in texts]
            copies = [_copy_of(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(copies, pa.int64())], names=["doc_id", "source", "n_tokens", "copy_of"])

    read = docs.where("doc_id is not null").select("doc_id", source_name().alias("source"), "text")
    sized = spread(read).mapInArrow(run, "doc_id long, source string, n_tokens long, copy_of long")
    return written(sized.groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens", "copy_of")).alias("r")).select("doc_id", "r.*"), "sized")
