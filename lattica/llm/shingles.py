"""Word shingles of whole texts as 64-bit hashes, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: The bytes that part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashed shingles of `k` words; a text with fewer words is one shingle of them all."""

    def __init__(self, k: int = 4) -> None:
        self.k = k
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE, np.uint64))])

    def _words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words: of A-Z in lower case, else of the bytes as they are."""
        b = np.frombuffer(raw.lower(), np.uint8)
        self._powers(len(b) + 1)
        blank = BLANK.take(b)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE.take(b) * self.up[: len(b)])])
            return start, mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def sets(self, texts: list[str | None], piece: int = 1 << 19) -> list[np.ndarray]:
        """The sorted distinct shingles of each text; none for a null text or one without words."""
        out: list[np.ndarray] = []
        hold: list[bytes] = []
        size = 0
        for t in texts:
            raw = (t or "").encode()
            if hold and size + len(raw) > piece:
                out += self._piece(hold)
                hold, size = [], 0
            hold.append(raw)
            size += len(raw) + 1
        return out + (self._piece(hold) if hold else [])

    def _piece(self, raws: list[bytes]) -> list[np.ndarray]:
        start, words = self._words(b"\n".join(raws))
        first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]))
        with np.errstate(over="ignore"):
            grams = np.zeros(max(0, len(words) - self.k + 1), np.uint64)
            for j in range(self.k):
                grams = grams * BASE + words[j : j + len(grams)]
            grams = mix(grams, self.k)
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= self.k:
                    out.append(np.unique(grams[a : b - self.k + 1]))
                elif b > a:
                    g = np.uint64(0)
                    for w in words[a:b]:
                        g = g * BASE + w
                    out.append(mix(np.array([g]), b - a))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set, as two signed longs."""
    return tuple(int(mix(s, 100 + i).sum(dtype=np.uint64).astype(np.int64)) for i in range(2))
