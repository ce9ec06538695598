"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from argentum.session import ship

#: The vocabulary that sizes are counted with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    """The encoder of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(documents: DataFrame, path: str = TOKENIZER, form: Callable[[str], str] = str) -> DataFrame:
    """doc_id, source, tokens, digest of each document: its size in tokens and a hash of its whole text in a form.

    A null text has no tokens and a null digest, an empty one no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts = pa.array([len(encode(t)) if t else 0 for t in texts], type=pa.int64())
            digests = pa.array([None if t is None else hashlib.blake2b(form(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, digests], names=["doc_id", "source", "tokens", "digest"])

    ship(documents.sparkSession)
    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint, digest binary")
