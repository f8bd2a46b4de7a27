"""64-bit hashes of words and word windows, over whole slices of documents at once with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from unitflow.llm.common import Memo

GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def step(k: int) -> np.uint64:
    return np.uint64(k * int(GOLDEN) & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs, in this order."""
    return mix(a * MIX_B + (b ^ GOLDEN))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Element i: a hash of words i to i + width - 1. Widths are put together from powers of two."""
    if len(words) < width:
        return words[:0]
    out, done, power, size = None, 0, words, 1
    while True:
        if width & size:
            n = len(words) - done - size + 1
            out = power[:n] if out is None else join(power[: n], out[size:][:n])
            done += size
        size *= 2
        if size > width:
            return out[: len(words) - width + 1]
        power = join(power[: len(power) - size // 2], power[size // 2 :])


def word_memo() -> Memo:
    import xxhash

    return Memo(xxhash.xxh3_64_intdigest)


_memo: list[Memo] = []


def hash_words(words: list[bytes]) -> np.ndarray:
    if not _memo:
        _memo.append(word_memo())
    return np.fromiter(map(_memo[0].__getitem__, words), np.uint64, len(words))
