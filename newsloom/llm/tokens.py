"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex

#: Vocabulary file; rank files (.tiktoken), tokenizer files (.json) and sentencepiece models (.model) are read.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The pattern that splits text before the merges of the rank files; its matches add up to the text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_UNITS = regex.compile(PATTERN)


class Tokenizer:
    """Counts tokens of texts, and cuts texts into pieces of at most so many tokens."""

    def __init__(self, path: str = TOKENIZER):
        self.path = path
        self._units: dict[str, int] = {}
        #: Whether the parts that ``units`` gives are tokenized independently of each other.
        self.additive = path.endswith(".tiktoken")
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.count = lambda text: len(encoding.encode_ordinary(text))
        elif path.endswith(".json"):
            from tokenizers import Tokenizer as Reader

            reader = Reader.from_file(path)
            reader.encode_special_tokens = True
            self.count = lambda text: len(reader.encode(text, add_special_tokens=False).ids)
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(processor.encode(text))

    def _unit(self, unit: str) -> int:
        n = self._units.get(unit)
        if n is None:
            if len(self._units) > 200_000:
                self._units.clear()
            n = self._units[unit] = self.count(unit)
        return n

    def units(self, text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of parts that add up to the text, none of more than ``most`` tokens unless it is one character."""
        parts = _UNITS.findall(text)
        known = self._units.get
        sizes = [known(u) for u in parts]
        if None in sizes or max(sizes, default=0) > most:
            done: list[tuple[int, int]] = []
            todo = parts[::-1]
            while todo:
                unit = todo.pop()
                n = self._unit(unit)
                if n <= most or len(unit) == 1:
                    done.append((len(unit), n))
                else:
                    todo += [unit[len(unit) // 2 :], unit[: len(unit) // 2]]
            return np.array([x for x, _ in done], np.int64), np.array([n for _, n in done], np.int64)
        return np.array([len(u) for u in parts], np.int64), np.array(sizes, np.int64)

    def pieces(self, text: str, units: tuple[np.ndarray, np.ndarray], capacity: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of consecutive pieces of at most ``capacity`` tokens; characters count."""
        ends, sums = np.cumsum(units[0]), np.cumsum(units[1])
        found, i, start, before = [], 0, 0, 0
        while i < len(sums):
            j = max(i + 1, int(np.searchsorted(sums, before + capacity, side="right")))
            end, n = int(ends[j - 1]), int(sums[j - 1]) - before
            # blanks at a piece's end may join up, and other tokenizers look across parts
            if not self.additive or text[end - 1].isspace():
                n = self.count(text[start:end])
                while n > capacity and j > i + 1:
                    j -= 1
                    end = int(ends[j - 1])
                    n = self.count(text[start:end])
            found.append((start, end, n))
            i, start, before = j, end, int(sums[j - 1])
        return found


@lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER) -> Tokenizer:
    """One tokenizer of a file for each Python worker."""
    return Tokenizer(path)
