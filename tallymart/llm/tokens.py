"""Byte-level BPE ids from a public tokenizer file, with the ids of frequent words kept at hand."""

from __future__ import annotations

import array
import functools
import json
import re
from collections.abc import Callable

import public_tokenizers
import tiktoken

#: Words whose ids a worker keeps, at most; the first ones seen, so that frequent words are among them.
MEMO = 500_000
#: White space but space and newline.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _joined(text: str) -> bool:
    """Whether a space stands next to other white space, or there is white space but space and newline: such texts are not cut into words."""
    return "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text) is not None


class _Memo(dict):
    """Ids of words behind a space."""

    def __init__(self, whole: Callable[[str], bytes]):
        super().__init__()
        self._whole = whole

    def __missing__(self, word: str) -> bytes:
        ids = self._whole(" " + word)
        if len(self) < MEMO and len(word) < 64:
            self[word] = ids
        return ids


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others count up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for a ``tokenizers`` file of a byte-level BPE whose ids are in merge order.

    Control strings in a text are ordinary text. Ids come as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {
            bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special
        }
        self.size = max(spec["model"]["vocab"].values()) + 1
        self._bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._memo = _Memo(self._whole)

    def _whole(self, text: str) -> bytes:
        return array.array("I", self._bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        # No piece of the pattern spans a lone space, but for starting with it, so words can be encoded one by one.
        if _joined(text):
            return self._whole(text)
        first, *words = text.split(" ")
        return self._whole(first) + b"".join(map(self._memo.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        return self._bpe.decode_bytes(ids).decode("utf-8")


@functools.lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def public_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)
