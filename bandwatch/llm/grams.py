"""Counts of hashed byte n-grams, by numpy, block by block so that long texts stay bounded."""

from __future__ import annotations

from operator import eq

import numpy as np

BLOCK = 1 << 20
# Odd multipliers of the hash.
_STEP = np.uint32(0x9E3779B1)


def _shapes() -> np.ndarray:
    """Letters and digits become one sign for each kind; other ASCII signs stay."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = ord("a")
    t[0x80:] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    return t


SHAPES = _shapes()


def gram_counts(text: np.ndarray, n: int, slots: int) -> np.ndarray:
    """How often each slot (a power of two of them) is hit by the text's n-grams of bytes."""
    out = np.zeros(slots, np.int64)
    shift = np.uint32(32 - int(slots).bit_length() + 1)
    for begin in range(0, max(0, len(text) - n + 1), BLOCK):
        part = text[begin : begin + BLOCK + n - 1].astype(np.uint32)
        count = len(part) - n + 1
        h = np.zeros(count, np.uint32)
        for i in range(n):
            h = (h + part[i : i + count] + np.uint32(1)) * _STEP
        out += np.bincount((h ^ (h >> np.uint32(15))) * _STEP >> shift, minlength=slots)
    return out


def collapsed(text: np.ndarray) -> np.ndarray:
    """The shapes of a text, each run of one sign taken once."""
    s = SHAPES[text]
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def as_bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def repeats(text: bytes) -> tuple[int, int]:
    """Words that equal the word before them, or the one before that."""
    words = text.split()
    return sum(map(eq, words, words[1:])), sum(map(eq, words, words[2:]))
