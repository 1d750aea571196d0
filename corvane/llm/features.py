"""Hashed features of texts, shared by the linear models. All are functions of the text alone."""

from __future__ import annotations

import numpy as np
import xxhash

from corvane.llm.arrow import Memo

#: Odd 64-bit multipliers of the hash combinations.
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * D
    return x ^ (x >> np.uint64(29))


def clean_id(raw: str) -> int:
    """Hash of the token in lower case without punctuation around it; 0 if nothing is left."""
    a, b = 0, len(raw)
    while a < b and not raw[a].isalnum():
        a += 1
    while b > a and not raw[b - 1].isalnum():
        b -= 1
    return xxhash.xxh3_64_intdigest(raw[a:b].lower()) | 1 if b > a else 0


def shape_id(raw: str) -> int:
    """Hash of a token's shape: case, digits, its run of marks at the end."""
    k = len(raw)
    while k and not raw[k - 1].isalnum():
        k -= 1
    case = "U" if raw.isupper() and k > 1 else "d" if any(c.isdigit() for c in raw) else "l"
    return xxhash.xxh3_64_intdigest(f"{case}{raw[k:][:3]}{min(k, 1)}") | 1


class NGrams:
    """Distinct hashed word n-grams and skip-grams of a text, as sorted indexes under 2**bits."""

    def __init__(self, bits: int, skips: tuple[int, ...] = (1, 2, 3)):
        self.shift, self.skips = np.uint64(64 - bits), skips
        self.ids = Memo(clean_id)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").split()
        ids = np.fromiter((self.ids[w] for w in raw), np.uint64, len(raw))
        ids = ids[ids != 0]
        if not len(ids):
            return np.zeros(0, np.int64)
        parts = [mixed(ids * A)]
        for k in self.skips:
            if len(ids) > k:
                parts.append(mixed(ids[:-k] * B + ids[k:] * C + np.uint64(k)))
        return np.unique((np.concatenate(parts) * A >> self.shift).astype(np.int64))


class TextShape:
    """Hashed words with values that sum to a unit norm, and shares of token shapes, repeats and line forms."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.ids, self.shapes = Memo(clean_id), Memo(shape_id)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").split()
        if not raw:
            return np.zeros(1, np.int64), np.ones(1, np.float32)
        ids = np.fromiter((self.ids[w] for w in raw), np.uint64, len(raw))
        words = np.unique(mixed(ids * A) * B >> self.shift).astype(np.int64)
        shapes = np.fromiter((self.shapes[w] for w in raw), np.uint64, len(raw))
        s, n = np.unique(mixed(shapes * C) * B >> self.shift, return_counts=True)
        same = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
        bars = text.count("|") / len(raw)
        extra = mixed(np.array([1, 2], np.uint64) * D) * B >> self.shift
        index = np.concatenate([words, s.astype(np.int64), extra.astype(np.int64)])
        value = np.concatenate([np.full(len(words), len(words) ** -0.5), 2 * n / len(raw), [2 * same, 2 * bars]])
        return index, value.astype(np.float32)
