"""Splitting of texts into the pre-tokens of a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re

import numpy as np

#: The split pattern of the vocabulary, as its description states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts of _COMMON characters alone, where the standard library's faster engine has the same classes:
#: letters are word characters other than digits and the underscore.
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")

#: Other characters: controls that only one engine takes for white space, superscripts and fractions (numbers, but not
#: decimal digits), and all that lies beyond Latin letters and general punctuation.
_UNCOMMON = re.compile("[^\\t\\n\\r -~ -±´-¸º»¿-ɏ‐-‧‰-›€]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the
    others in order from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Numbers(dict):
    """Numbers words as they come; new ones are listed in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def taken(self) -> list[str]:
        """The new words since the last time."""
        out, self.new = self.new, []
        return out


class PreTokenizer:
    """Splits texts at special strings, as the library does by default, and then by the pattern."""

    def __init__(self, path: str | None = None):
        import regex

        with open(path or vocabulary_path(), encoding="utf-8") as f:
            self.description = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.description["added_tokens"]}
        self._any = regex.compile(PATTERN).findall
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        return (_FAST.findall if not _UNCOMMON.search(text) else self._any)(text)

    def split(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens of a text in order, special strings among them, and those special strings."""
        found = self._cut.findall(text) if self._cut else []
        if not found:
            return self.words(text), found
        out: list[str] = []
        for part, special in zip(self._cut.split(text), [*found, None], strict=True):
            out += self.words(part)
            if special is not None:
                out.append(special)
        return out, found
