"""Sizes of texts in tokens of a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("CORPUSKILN_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how the tokenizer's texts are cut before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file of base64 tokens and ranks, loaded once for each process."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, *others: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``others`` and ``n_tokens`` of the documents with at least one token.

    Null and empty texts have none and are left out; whole texts are counted.
    """
    kept = documents.select("doc_id", *others, "text").filter("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *others)), sizes], names=["doc_id", *others, "n_tokens"])

    types = dict(documents.dtypes)
    return kept.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("doc_id", *others)) + ", n_tokens long")
