"""Sizes of texts in tokens of a public tokenizer, read from a folder given by path."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabularies are on every executor, unless a call says otherwise.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts a text before the byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The byte-level encoder of a vocabulary file, loaded once for each worker; special tokens are ordinary text."""
    path = os.path.join(folder, vocabulary)
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_sizes(docs: DataFrame, keys: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keys`` columns and ``tokens`` of every row of docs; null and empty texts have none."""
    kept = docs.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", tokens long"

    def count(batches):
        encode = encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(n, pa.int64())], [*keys, "tokens"])

    return kept.mapInArrow(count, schema)
