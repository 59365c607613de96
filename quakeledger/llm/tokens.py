"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this many characters are cut after single line breaks between visible characters. The pattern divides
#: there in any case and no token of any vocabulary reaches over what it divides, so the count is that of the whole text.
LONG = 50_000
_BREAK = re.compile(r"(?<=\S\n)(?=\S)")


def encoder_of(ranks: bytes):
    """The encoder of a vocabulary file's content."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    with open(vocabulary, "rb") as f:
        return encoder_of(f.read())


def count_tokens(text: str, enc) -> int:
    """Tokens of the whole text; marks of special tokens in it are ordinary text."""
    if len(text) <= LONG:
        return len(enc.encode_ordinary(text))
    n, start, last = 0, 0, 0
    for m in _BREAK.finditer(text):
        if m.start() - start > LONG and last > start:
            n, start = n + len(enc.encode_ordinary(text[start:last])), last
        last = m.start()
    if len(text) - start > LONG and last > start:
        n, start = n + len(enc.encode_ordinary(text[start:last])), last
    return n + len(enc.encode_ordinary(text[start:]))


def with_tokens(docs: DataFrame, keep: tuple[str, ...], text: str, out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep + the number of tokens of each text; null and empty texts have 0. One narrow pass, the text isn't returned."""
    if out in keep:
        raise ValueError(f"column {out} is named twice")
    got = docs.select(*keep, F.col(text).alias("__text"))
    with open(vocabulary, "rb") as f:  # the driver's copy goes to all executors: about 1 MB
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for b in batches:
            enc = enc or encoder_of(ranks.value)
            sizes = [count_tokens(t, enc) if t else 0 for t in b["__text"]]
            yield b[list(keep)].assign(**{out: pd.Series(sizes, index=b.index, dtype="int64")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.select(*keep).schema) + f", `{out}` long"
    return got.mapInPandas(run, schema)
