"""Token counts of whole texts with a public byte-level BPE vocabulary.

The library's pre-tokenizer never joins what stands before a single blank with
what stands after it, if neither neighbour of the blank is white space. Such
blanks are safe boundaries: a text has the tokens of its pieces, one after the
other. Texts are gathered into batches of about equal bytes; longer ones are cut at
safe boundaries into pieces of bounded size.

Ordinary pieces go to the rank form of the same vocabulary, which gives the same
ids four times as fast; unbroken runs beyond ``LONGEST_RANKED`` and pieces that may
hold a special string go to the library of the vocabulary file itself.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import whole_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of a batch, and characters of a piece of a longer text where a safe boundary allows it.
BATCH_BYTES = 1 << 18
BATCH_CHARS = 1 << 18
LONGEST_RANKED = 1 << 19

_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def ranked(vocabulary: str):
    """The rank form of a vocabulary, if a file beside it has it."""
    path = re.sub(r"\.json$", ".tiktoken", vocabulary)
    if path == vocabulary or not os.path.exists(path):
        return None
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_balanced(texts: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Pieces of all texts with their text's number, in lists of about ``most`` bytes, or of one longer piece."""
    batch: list[tuple[int, str]] = []
    held = 0
    for number, text in enumerate(texts):
        for piece in pieces(text):
            size = len(piece.encode("utf-8", "surrogatepass"))
            if batch and held + size > most:
                yield batch
                batch, held = [], 0
            batch.append((number, piece))
            held += size
    if batch:
        yield batch


def pieces(text: str, most: int = BATCH_CHARS) -> Iterator[str]:
    """A text cut before the first safe blank beyond every ``most`` characters."""
    start = 0
    while len(text) - start > most:
        found = _SAFE_BLANK.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Encoder:
    """Ids of whole texts, as the library of the vocabulary file gives them by default."""

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.ranks = ranked(vocabulary)

    def _ids(self, piece: str) -> list[int]:
        if self.ranks is None or len(piece) > LONGEST_RANKED or "<|" in piece:
            return self.library.encode(piece, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(piece)

    def ids(self, text: str) -> list[int]:
        if len(text) <= BATCH_CHARS:
            return self._ids(text)
        return [i for piece in pieces(text) for i in self._ids(piece)]

    def lengths(self, batch: list[str]) -> list[int]:
        """Numbers of tokens of a batch of pieces, each of the two libraries called once."""
        ranked = [self.ranks is not None and len(p) <= LONGEST_RANKED and "<|" not in p for p in batch]
        plain = iter(self.ranks.encode_ordinary_batch([p for p, r in zip(batch, ranked) if r], num_threads=1) if any(ranked) else ())
        rest = [p for p, r in zip(batch, ranked) if not r]
        other = iter(self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        return [len(next(plain)) if r else len(next(other).ids) for r in ranked]


def count_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each text, special strings handled as the library does by default.

    A NULL or empty text has none. Only lengths leave the workers.
    """

    def lengths(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary)
        for texts in series:
            counts = np.zeros(len(texts), np.int64)
            for batch in byte_balanced(texts.fillna("")):
                numbers, parts = zip(*batch, strict=True)
                np.add.at(counts, list(numbers), encoder.lengths(list(parts)))
            yield pd.Series(counts)

    lengths.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(lengths, "long")(text)


def token_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Bytes and tokens per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    One row per input row, repeated rows included; a NULL text counts as empty and
    other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    counted = rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        count_tokens(F.col("text"), vocabulary).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
