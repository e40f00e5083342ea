"""How a byte-level vocabulary cuts text, and a cache over the cuts.

A space that follows a non-space always begins a pre-token, so a text without
long white-space runs may be cut at its spaces and each piece handled alone.
Pieces repeat, so a piece is worked out once per worker and then looked up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

# The pre-token pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White-space runs that may cross a cut: three or more anywhere, two or more at the end.
_UNEVEN = re.compile(r"\s\s(?:\s|\Z)")

CACHE_ENTRIES = 1_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file.

    Bytes that print stand for themselves; the others take code points from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """(token to id, merges in order, special string to id) of a tokenizer JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is not a byte-level BPE without prefix space")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return model["vocab"], merges, special


class PieceCache(dict):
    """piece -> value, worked out on first use; ``trim`` keeps it bounded."""

    def __init__(self, work: Callable[[str], object], most: int = CACHE_ENTRIES):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, piece: str):
        value = self[piece] = self.work(piece)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


class CutText:
    """Cuts a text into special strings and pieces that encode independently."""

    def __init__(self, special: list[str]):
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def spans(self, text: str) -> list[str]:
        """Alternately plain text and special strings, beginning with plain text."""
        if self.split is None or not any(s in text for s in self.special):
            return [text]
        return self.split.split(text)

    @staticmethod
    def simple(text: str) -> bool:
        """Whether cutting at every space is exact."""
        return _UNEVEN.search(text) is None
