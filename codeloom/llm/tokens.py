"""Sizes and token counts of texts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str) -> int:
    return encoding(path).max_token_value + 1


VECTOR = "doc_id long, source string, n_tokens int, ids binary, counts binary"


def token_table(documents: DataFrame, path: str) -> DataFrame:
    """Per document its tokens as counts: (doc_id, source, n_tokens, ids, counts), ids and counts as little-endian uint32.

    Whole texts are encoded.  Null and empty texts have no tokens; the source is in lower case and trimmed.
    Rows of one doc_id are taken to be one text and kept once; rows without an id are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids, counts = np.unique(np.array(own.encode_ordinary(text or ""), dtype=np.uint32), return_counts=True)
                rows.append((int(counts.sum()), ids.tobytes(), counts.astype(np.uint32).tobytes()))
            sizes = pd.DataFrame(rows, columns=["n_tokens", "ids", "counts"], index=batch.index)
            yield pd.concat([batch[["doc_id", "source"]], sizes], axis=1)

    own = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return spread(own).mapInPandas(run, VECTOR)


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many of all documents each token occurs; ``size`` entries, whatever the number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(np.frombuffer(b"".join(batch["ids"]), dtype=np.uint32), minlength=size)
        filled = np.flatnonzero(total)
        yield pd.DataFrame({"id": filled, "n": total[filled]})

    found = vectors.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out
