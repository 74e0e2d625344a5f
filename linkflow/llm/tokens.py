"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.session import spread

#: Vocabulary file (byte-level BPE ranks); every executor must see it under this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):
    """The tokenizer of a vocabulary file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(texts: list[str | None], path: str = VOCABULARY) -> list[int]:
    """Tokens of each text; 0 for null and empty texts."""
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def sized(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of documents (``doc_id, source, text``); one narrow stage over whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "tokens": count(f["text"].tolist(), path)})

    texts = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), "doc_id")
    return texts.mapInPandas(run, "doc_id long, source string, tokens long")
