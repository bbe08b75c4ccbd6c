"""64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_M = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MEMO = 1 << 17


class _Memo(dict):
    """Hashes of words already seen; emptied when full, so its memory is bounded."""

    def __missing__(self, word):
        if len(self) >= _MEMO:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_memo = _Memo()


def word_hashes(words: list) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def distinct_word_hashes(words: list) -> np.ndarray:
    """``word_hashes`` without the memo: half the time where many words are seen once (numbers, names, identifiers)."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8")


def window_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A mixed hash of each run of ``n`` word hashes; ``which`` picks one of two independent ones."""
    size = max(0, len(h) - n + 1)
    x = h[:size].copy()
    with np.errstate(over="ignore"):
        if which:
            x ^= x >> np.uint64(29)
        for k in range(1, n):
            x *= np.uint64(_M[which])
            x += h[k : k + size]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return x
