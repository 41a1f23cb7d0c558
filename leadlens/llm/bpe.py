"""Byte-level BPE ids of whole texts, as one encoder for a task."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# Below this code point, letters, digits and spaces are the same in every Unicode version,
# so that the two libraries cut texts into words alike; other texts go to the slower one.
STABLE = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=2)
def library(vocabulary: str = "byte_bpe_50k"):
    """The tokenizers library's own encoder, with its default settings."""
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@lru_cache(maxsize=2)
def added_tokens(vocabulary: str = "byte_bpe_50k") -> re.Pattern:
    """The strings that the library takes out of a text before it cuts words: each is one id."""
    return re.compile("|".join(re.escape(t.content) for t in library(vocabulary).get_added_tokens_decoder().values()) or "(?!)")


@lru_cache(maxsize=2)
def encoder(vocabulary: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32): the library's with ``add_special_tokens=False``.

    Texts that hold an added token's string go to the library itself."""
    import public_tokenizers
    import tiktoken

    slow, added = library(vocabulary), added_tokens(vocabulary)
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if STABLE.search(text) or added.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode
