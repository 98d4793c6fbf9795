"""Text primitives that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Chinese and Japanese characters (fixed values: Unicode blocks).
CJK = "々〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"

#: A Chinese or Japanese character, a run of letters, digits and underscores, or any other visible character.
TOKEN = re.compile(rf"[{CJK}]|[^\W{CJK}]+|[^\w\s\x00-\x1f\x7f-\x9f​-‏‪-‮⁠-⁤﻿]")
#: A run of letters or digits.
WORD = re.compile(r"[^\W_]+")
#: A run of letters or digits; a Chinese or Japanese character is a word.
WORD_CJK = re.compile(rf"[{CJK}]|[^\W_{CJK}]+")
DIGITS = re.compile(r"\d+")
OPEN_FENCE = re.compile(r"(`{3,}|~{3,})")


def fenced(lines: list[str]) -> Iterator[tuple[int, str, bool]]:
    """(number, line, inside a fence) of each line; the lines that open and close a fence are inside.

    A fence that is never closed reaches to the end of the text.
    """
    mark = ""
    for n, line in enumerate(lines):
        if mark:
            yield n, line, True
            bare = line.rstrip()
            if len(bare) >= len(mark) and bare == mark[0] * len(bare):
                mark = ""
        elif (line.startswith("```") or line.startswith("~~~")) and (m := OPEN_FENCE.match(line)):
            mark = m[1]
            yield n, line, True
        else:
            yield n, line, False


class WordHash(dict):
    """64-bit hash of a word, kept for words seen before; emptied when it grows past a bound."""

    BOUND = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n words, by position."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))
