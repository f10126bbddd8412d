"""Byte-level BPE ids of whole texts, with the byte place of every token.

Ids are those of ``tokenizers`` for the given file.  The same vocabulary, read
from that file as merge ranks, serves a faster encoder for texts of common
scripts; texts that hold a special token's string, or any character beyond
``_COMMON``, go to ``tokenizers`` itself.  The tests hold both against each other.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

#: Characters on which both pre-tokenizers' tables agree.
_COMMON = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏͰ-ͳΈ-ϿЀ-ҁҊ-ӿ‐-‧‰-⁞₠-₿]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by their rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        stand_in = _byte_of_char()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.n_bytes = np.zeros(size, np.int64)
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                ranks[bytes(stand_in[c] for c in token)] = i
                self.n_bytes[i] = len(token)
        for token, i in self.special.items():
            self.n_bytes[i] = len(token.encode())
        self.fast = self._fast(ranks)

    @cached_property
    def whole(self):
        """Loaded with the first text that needs it: most workers never do, and it is the larger part."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _fast(ranks):
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:  # the slower encoder does all the work then
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def ids(self, text: str) -> array:
        if self.fast and not _COMMON.search(text) and not any(s in text for s in self.special):
            return array("I", self.fast(text))
        return array("I", self.whole.encode(text, add_special_tokens=False).ids)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the first and last character (exclusive) that each token touches.

        A byte-level token may hold part of a character: then both tokens touch it.
        """
        ids = np.frombuffer(self.ids(text), np.uint32)
        ends = np.cumsum(self.n_bytes[ids])
        starts = ends - self.n_bytes[ids]
        if text.isascii():
            return ids, starts, ends
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        return ids, char[starts], char[ends - 1] + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One at a time in a Python worker; ``forget`` frees it when a task ends (loading takes a tenth of a second)."""
    return Encoder(path)


def forget() -> None:
    encoder.cache_clear()
