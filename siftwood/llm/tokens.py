"""Token ids of whole texts under a public byte-level BPE vocabulary.

The reference ids are those of the `tokenizers` library for the vocabulary's JSON file.  The same vocabulary as ranks
runs several times faster under `tiktoken`; both split texts by the same pattern, so the ids agree wherever both agree
on character classes.  That is tested for every code point below U+0250, and texts with any other character go through
`tokenizers` itself.  Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Characters for which the two libraries' classes are compared one by one in the tests.
COMMON = re.compile("[^\x00-ɏ]")


class Encoder:
    """Made once per Python worker; ids(text) gives a numpy array of unsigned 32-bit ids."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path(f"{VOCABULARY}.json")
        self._exact = None
        with open(ranks_path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding(
            "siftwood", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def exact(self, text: str) -> np.ndarray:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.json_path)
            self._exact.encode_special_tokens = True
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if COMMON.search(text):
            return self.exact(text)
        return np.array(self._fast.encode_ordinary(text), np.uint32)


_encoder: Encoder | None = None


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """The worker's encoder; loading the vocabulary takes a noticeable part of a second, so it is kept."""
    global _encoder
    if _encoder is None or json_path not in (None, _encoder.json_path):
        _encoder = Encoder(json_path, ranks_path)
    return _encoder
