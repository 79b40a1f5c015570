"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; every executor must see it.
FOLDER = os.environ.get("TRACEWELL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = f"{FOLDER}/{VOCABULARY}") -> Column:
    """Tokens of a text; strings of special tokens are ordinary text; null and empty texts have none."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encode = encoding(path).encode_ordinary
        return pa.array([len(encode(x)) if x else 0 for x in texts.to_pylist()], type=pa.int64())

    return count(text)
