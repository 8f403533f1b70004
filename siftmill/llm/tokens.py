"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter.

The default file and the split pattern come from the installed package ``public_tokenizers``; without it, sizes need
the path of a file of ranks and the pattern is ``PATTERN``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: File of the installed vocabulary package that is used when no path is given.
DEFAULT = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level vocabularies of this kind split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer text is encoded in parts of about this many characters, which bounds the memory of its tokens.
PART = 100_000
#: Where a text may be cut: behind a letter that no letter follows. No piece of the pattern goes on there, and none
#: looks back, so the parts have the tokens of the whole.
_END = re.compile(r"[^\W\d_](?![^\W\d_])")

_encoders: dict[str | None, object] = {}


def encoder(path: str | None = None):
    """The byte-pair encoder of the ranks in ``path``, once per process."""
    if path not in _encoders:
        import tiktoken

        if path is None:
            try:
                import public_tokenizers
            except ModuleNotFoundError as e:
                raise RuntimeError("no vocabulary: install public_tokenizers or name a file of ranks by `path`") from e
            path_ = public_tokenizers.path(DEFAULT)
        else:
            path_ = path
        with open(path_, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _parts(text: str) -> Iterator[str]:
    """A text cut at places of ``_END``, as soon as a part has ``PART`` characters."""
    at = 0
    while len(text) - at > PART:
        m = next((m for m in _END.finditer(text, at + PART) if m.group().isalpha() and not text[m.end() : m.end() + 1].isalpha()), None)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def count_tokens(text: str, path: str | None = None) -> int:
    encode = encoder(path).encode_ordinary
    return len(encode(text)) if len(text) <= PART else sum(len(encode(t)) for t in _parts(text))


def token_count(text: Column | str, path: str | None = None) -> Column:
    """Tokens of a text column, 0 for null; one Arrow batch at a time."""

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count_tokens(t, path) if t else 0 for t in texts], dtype="int64")

    sizes.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(sizes, "bigint")(text)
